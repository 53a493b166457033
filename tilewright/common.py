"""Shared helpers: table access, text normalisation and cutting lineage in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as outer blanks of a key.
BLANKS = " \t\n\r\f\u000b "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(column: Column | str) -> Column:
    """A key in lower case and without outer blanks; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's spark.checkpoint.dir. Only a local session may go without: it gets
    a folder of its own, and a cluster session without the setting raises ValueError.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="tilewright-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_written: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused path for a written table in the shared folder; release() deletes it."""
    _written.append(path := f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has written to the shared folder, and say how many
    there were. Results that still read them can't be used after that."""
    n = len(_written)
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that no later step
    recomputes it and the loss of an executor costs nothing."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as parquet to the shared folder and read back: smaller on disk than
    cut(), and later scans prune columns and push filters down."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, *columns: str) -> None:
    """ValueError unless df has all the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
