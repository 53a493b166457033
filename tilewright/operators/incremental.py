"""Processing only new or changed records, exactly once, across failures.

A ledger holds, per source, the sequence numbers that committed runs have processed, as
disjoint closed intervals. A run subtracts them from the range that is there, reads the gaps
(rows that arrive late, below the highest number, lie in them too) once into a folder of its own,
adds what they change to the state, and commits state and intervals together by one marker file.
Whatever a failed run wrote is without a marker and is never read.

The cost of a run follows what is new: of the state only the changes are written (every
`KEPT` runs they are folded into one), and few gaps are pushed into the scan as ranges.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import folded, require

#: Sequence numbers of a block of the ledger; a row of the ledger has at most half as many intervals.
BLOCK = 1 << 16
#: So many gaps are pushed into the scan as ranges; more are met by joins. Either is exact.
PUSHED = 64
#: Runs whose changes are kept apart before they are folded into one state.
KEPT = 8

INTERVALS = "source string, block bigint, runs array<struct<lo:bigint,hi:bigint>>"


def intervals(rows: DataFrame) -> DataFrame:
    """Disjoint intervals per (source, block) of rows (source, seq), maximal in their block;
    repeats and null numbers don't matter."""
    block = F.shiftright(F.col("seq").cast("bigint"), 16).alias("block")
    distinct = rows.where(F.col("seq").isNotNull()).select("source", block, "seq").distinct()
    island = F.expr("seq - row_number() OVER (PARTITION BY source, block ORDER BY seq)").alias("island")
    islands = distinct.select("source", "block", "seq", island).groupBy("source", "block", "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return islands.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def merged(ledger: DataFrame) -> DataFrame:
    """A ledger with several rows of a block as one with one: touching or overlapping intervals
    become one."""
    runs = ledger.select("source", "block", F.inline("runs"))
    before = F.expr("max(hi) OVER (PARTITION BY source, block ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    new = F.when(F.col("before").isNull() | (F.col("lo") > F.col("before") + 1), 1).otherwise(0)
    marked = runs.withColumn("before", before).withColumn("new", new)
    island = F.expr("sum(new) OVER (PARTITION BY source, block ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)")
    islands = marked.withColumn("island", island).groupBy("source", "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return islands.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def maximal(ledger: DataFrame) -> DataFrame:
    """(source, lo, hi): the intervals of a merged ledger, also across the borders of blocks.
    Only those that touch a border, two a block at most, are put in order."""
    runs = ledger.select("source", F.inline("runs"))
    touching = (F.pmod("lo", F.lit(BLOCK)) == 0) | (F.pmod("hi", F.lit(BLOCK)) == BLOCK - 1)
    inner, outer = runs.where(~touching), runs.where(touching)
    new = F.expr("CASE WHEN lo = lag(hi) OVER (PARTITION BY source ORDER BY lo) + 1 THEN 0 ELSE 1 END")
    island = F.expr("sum(new) OVER (PARTITION BY source ORDER BY lo ROWS UNBOUNDED PRECEDING)")
    outer = outer.withColumn("new", new).withColumn("island", island).groupBy("source", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return inner.unionByName(outer.select("source", "lo", "hi"))


def subtracted(available: tuple[int, int], done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The gaps that disjoint intervals leave of a range, in order."""
    out, at = [], available[0]
    for lo, hi in sorted(done):
        if lo > at:
            out.append((at, min(lo - 1, available[1])))
        at = max(at, hi + 1)
    return [(lo, hi) for lo, hi in [*out, (at, available[1])] if lo <= hi]


def _words(ledger: DataFrame) -> DataFrame:
    """(__word, __mask): the processed numbers of each word of 64 numbers, as bits."""
    runs = ledger.select(F.inline("runs")).withColumn("__word", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))))
    first = F.greatest("lo", F.col("__word") * 64) - F.col("__word") * 64
    size = F.least("hi", F.col("__word") * 64 + 63) - F.col("__word") * 64 - first + 1
    ones = F.expr("shiftrightunsigned(-1L, CAST(64 - size AS INT))")
    bits = runs.select("__word", first.alias("first"), size.alias("size")).withColumn("ones", ones)
    return bits.groupBy("__word").agg(F.expr("bit_or(shiftleft(ones, CAST(first AS INT)))").alias("__mask"))


def unprocessed(df: DataFrame, source: str, seq: str, ledger: DataFrame) -> DataFrame:
    """The rows of df whose sequence number no interval of the (merged) ledger covers: those in
    the gaps that the intervals leave of the range of df's numbers. Rows without a number can't
    be told apart and are left out.

    Few gaps become ranges of the scan. Else blocks with one interval are decided by it, and only
    the rows of fragmented blocks are joined, with the bits of their word of 64 numbers.
    """
    require(df, seq)
    done = ledger.where(F.col("source") == source)
    rows = df.where(F.col(seq).isNotNull())
    few = maximal(done).select("lo", "hi").limit(PUSHED).collect()
    if len(few) < PUSHED:
        lo, hi = rows.agg(F.min(seq), F.max(seq)).first()
        gaps = subtracted((lo, hi), [(r["lo"], r["hi"]) for r in few]) if lo is not None else []
        inside = F.lit(False)
        for a, b in gaps:
            inside = inside | F.col(seq).between(a, b)
        return rows.where(inside)
    blocks = done.select(F.col("block").alias("__block"), F.size("runs").alias("__n"), F.col("runs")[0]["lo"].alias("__lo"), F.col("runs")[0]["hi"].alias("__hi"))
    placed = rows.withColumn("__block", F.shiftright(F.col(seq).cast("bigint"), 16)).join(blocks, "__block", "left")
    plain = placed.where(F.col("__n").isNull() | ((F.col("__n") == 1) & ~F.col(seq).between(F.col("__lo"), F.col("__hi"))))
    torn = placed.where(F.col("__n") > 1).withColumn("__word", F.shiftright(F.col(seq).cast("bigint"), 6))
    torn = torn.join(_words(done.where(F.size("runs") > 1)), "__word", "left")
    bit = F.expr(f"shiftright(__mask, CAST(pmod(`{seq}`, 64) AS INT)) & 1")
    return plain.select(*df.columns).unionByName(torn.where(F.col("__mask").isNull() | (bit == 0)).select(*df.columns))


@dataclass
class Source:
    """Input of a run: the rows that are there, their sequence number, and what they add to the state."""

    rows: DataFrame
    seq: str
    delta: Callable[[DataFrame], DataFrame]


class Ledger:
    """State and processed intervals in a folder of a file system that all executors share.

    fold merges states (a union of rows) into one; it must be associative, commutative and
    idempotent or the deltas disjoint. Two runs can't both commit a version: the marker is made
    by a hard link on a local file system and by a rename that doesn't overwrite elsewhere, which
    is atomic on HDFS; a store without such a rename needs one run at a time.
    """

    def __init__(self, spark: SparkSession, path: str, state_schema: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.fold = spark, path.rstrip("/"), state_schema, fold
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _committed(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _marker(self, version: int) -> dict:
        if not version:
            return {"version": 0, "parts": []}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:08d}.json", wholetext=True).first()[0])

    def version(self) -> int:
        """Number of committed runs."""
        return max(self._committed(), default=0)

    def _read(self, what: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}/{what}" for p in parts])

    def state(self) -> DataFrame:
        parts = self._marker(self.version())["parts"]
        rows = self._read("state", self.schema, parts)
        return self.fold(rows) if len(parts) > 1 else rows

    def processed(self) -> DataFrame:
        """The processed intervals, per source and block."""
        parts = self._marker(self.version())["parts"]
        rows = self._read("intervals", INTERVALS, parts)
        return merged(rows) if len(parts) > 1 else rows

    def run(self, sources: dict[str, Source], before_commit: Callable[[], None] | None = None) -> int:
        """Process what no committed run has processed; the number of the new version.

        The rows of the run are written once; state and intervals both follow from that copy, so
        a row that arrives meanwhile is either in both or in neither. before_commit is called
        when all is written and nothing is committed yet; if it raises, the run has failed and
        left no trace that a later run would read.
        """
        version = self.version()
        marker = self._marker(version)
        ledger = self.processed()
        folder = f"runs/{version + 1:08d}-{uuid.uuid4().hex}"
        state = seen = None
        for name, s in sources.items():
            rows = unprocessed(s.rows, name, s.seq, ledger) if version else s.rows.where(F.col(s.seq).isNotNull())
            rows.write.parquet(at := f"{self.path}/{folder}/rows/{name}")
            rows = self.spark.read.schema(rows.schema).parquet(at)
            delta = s.delta(rows)
            state = delta if state is None else state.unionByName(delta, allowMissingColumns=True)
            new = rows.select(F.lit(name).alias("source"), F.col(s.seq).cast("bigint").alias("seq"))
            seen = new if seen is None else seen.unionByName(new)
        state, seen, parts = self.fold(state), intervals(seen), [*marker["parts"], folder]
        if len(parts) > KEPT:
            state = self.fold(self._read("state", self.schema, marker["parts"]).unionByName(state, allowMissingColumns=True))
            seen = merged(self._read("intervals", INTERVALS, marker["parts"]).unionByName(seen))
            parts = [folder]
        state.write.parquet(f"{self.path}/{folder}/state")
        seen.write.parquet(f"{self.path}/{folder}/intervals")
        self._fs.delete(self._path(f"{self.path}/{folder}/rows"), True)
        if before_commit:
            before_commit()
        self._commit(version + 1, folder, parts)
        return version + 1

    def _commit(self, version: int, folder: str, parts: list[str]) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        part, final = self._path(f"{self.path}/{folder}/marker"), self._path(f"{self.path}/commits/{version:08d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        out.close()
        rival = RuntimeError(f"version {version} was committed by another run")
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), final.toUri().getPath())
                return
            except FileExistsError:
                raise rival from None
            except OSError:
                pass  # a file system without hard links
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise rival


STATE = (
    "id string, listed struct<at:timestamp_ntz,seq:bigint,checksum:string>,"
    " done struct<at:timestamp_ntz,seq:bigint,checksum:string>"
)


def _newest(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.max("listed").alias("listed"), F.max("done").alias("done"))


def _listings(df: DataFrame) -> DataFrame:
    """Newest complete listing per slide; of equal times the larger listing_id."""
    rows = df.where(F.col("id").isNotNull() & F.col("checksum").isNotNull())
    at = F.struct(F.col("listed_at").alias("at"), F.col("listing_id").alias("seq"), "checksum")
    return rows.groupBy("id").agg(F.max(at).alias("listed")).withColumn("done", F.lit(None).cast("struct<at:timestamp_ntz,seq:bigint,checksum:string>"))


def _completions(df: DataFrame, task: str) -> DataFrame:
    """Newest completion of the task per slide; of equal times the larger event_id."""
    rows = df.where(F.col("id").isNotNull() & (F.col("task") == task) & (folded("status") == "completed"))
    at = F.struct(F.col("ts").alias("at"), F.col("event_id").alias("seq"), "checksum")
    return rows.groupBy("id").agg(F.max(at).alias("done")).withColumn("listed", F.lit(None).cast("struct<at:timestamp_ntz,seq:bigint,checksum:string>"))


def slide_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger of slide contents: per slide its newest listing and its newest completion."""
    return Ledger(spark, path, STATE, _newest)


def slide_sources(slides: DataFrame, events: DataFrame, task: str = "segmentation") -> dict[str, Source]:
    require(slides, "listing_id", "id", "checksum", "listed_at")
    require(events, "event_id", "id", "task", "status", "checksum", "ts")
    slides = slides.select("listing_id", "id", "checksum", "listed_at")
    events = events.select("event_id", "id", "task", "status", "checksum", "ts")
    return {
        "slides": Source(slides, "listing_id", _listings),
        "task_events": Source(events, "event_id", lambda df: _completions(df, task)),
    }


def pending(ledger: Ledger) -> DataFrame:
    """Slides whose current content has no successful outcome: the newest listing's checksum
    is not that of the newest completion, or there is no completion (or one without checksum).

    Slides with incomplete listings only have no known content and are not pending. Repeated
    rows and ties don't matter; empty tables give no rows.
    """
    same = F.coalesce(F.col("listed.checksum") == F.col("done.checksum"), F.lit(False))
    return ledger.state().where(F.col("listed").isNotNull() & ~same).select("id")
