"""Incremental processing of a landing folder.

The stream has no windows and no state of its own: a part of new files is handed to the batch
code, and what is done already is left out by an anti-join with the output, so that a part that
comes again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at `path` doesn't have; of repeats one."""
    spark = rows.sparkSession
    fresh = rows.where(f"`{key}` IS NOT NULL").dropDuplicates([key])
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        fresh = fresh.join(spark.read.schema(fresh.schema).parquet(path).select(key), key, "left_anti").select(*fresh.columns)
    fresh.write.mode("append").parquet(path)


def ingest(spark: SparkSession, landing: str, schema: StructType, output: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], files: int = 32, names: str = "*.parquet") -> StreamingQuery:
    """Process all parquet files (of a pattern of names) of the landing folder that no run has taken yet, `files` at a
    time, and stop; a later call goes on from there. work maps the rows of a part to rows of the
    output, which has one row a key."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(landing)

    def part(rows: DataFrame, _: int) -> None:
        append_new(work(rows), output, key)

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
