"""The log of task outcomes: counts, attempts, last errors, summaries, and what is left to do.

Events are (event_id, id, task, status, reason, message, event, ts, error); repeats of an
event_id count once, and events without id are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.common import folded, require
from tilewright.functions import text
from tilewright.operators.ranking import numbered_by, with_neighbours

#: Order of events of equal time.
ORDER = ("ts", "event_id")


def events_of(log: DataFrame) -> DataFrame:
    """One row per event_id, with status folded to lower case without outer blanks."""
    require(log, "event_id", "id", "task", "status", "reason", "message", "event", "ts", "error")
    rows = log.where("event_id IS NOT NULL AND id IS NOT NULL").select("event_id", "id", "task", folded("status").alias("status"), "reason", "message", folded("event").alias("event"), "ts", "error")
    return rows.dropDuplicates(["event_id"])


def label(status: Column, reason: Column) -> Column:
    known = F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown"))
    return F.when((known != "unknown") & (F.coalesce(reason, F.lit("")) != ""), F.concat(known, F.lit(" ("), reason, F.lit(")"))).otherwise(known)


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each slide and task; an aggregate, so nothing is sorted."""
    newest = F.max_by(F.struct("status", "reason", "message", "error", "ts"), F.struct(*ORDER)).alias("e")
    return events.where("ts IS NOT NULL").groupBy("id", "task").agg(newest).select("id", "task", "e.*")


def status_counts(events: DataFrame) -> DataFrame:
    """(task, encoder, label, n): slides by the newest outcome of each task."""
    group, encoder = text.task_parts(F.col("task"))
    return latest(events).groupBy(group.alias("task"), encoder.alias("encoder"), label(F.col("status"), F.col("reason")).alias("label")).agg(F.count("*").alias("n"))


# The order of states in a report; others follow in the order of letters.
PREFERRED = ("completed", "skipped", "error", "running", "not_started", "unknown")


def report_order(counts: DataFrame) -> DataFrame:
    """counts with place, from 1 in each task and encoder: preferred states first."""
    first = F.split(F.col("label"), " ", 2)[0]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PREFERRED]), first), F.lit(0)), F.lit(len(PREFERRED) + 1)).cast("int")
    return counts.withColumn("__rank", rank).withColumn("place", F.expr("row_number() OVER (PARTITION BY task, encoder ORDER BY __rank, label)")).drop("__rank")


def attempts(events: DataFrame) -> DataFrame:
    """(id, task, attempt_no, started_at, finished_at, duration_s, result, error): a start opens an
    attempt, the next end closes it; an end without a start before it is one with a null start;
    a start that no end follows is running. Events of other kinds, or without time, are none.
    Events are sorted by range, so a slide with most of them is shared by many tasks."""
    rows = events.where("ts IS NOT NULL AND event IN ('started', 'finished', 'error')")
    rows = with_neighbours(rows, ["id", "task"], list(ORDER), ["event", "ts", "status", "error"])
    start = F.col("event") == "started"
    opens = start | F.col("__before").isNull() | (F.col("__before.event") != "started")
    closed = start & (F.col("__after.event") != "started")
    rows = numbered_by(rows.where(opens), ["id", "task"], list(ORDER), "attempt_no")
    end = F.when(F.coalesce(closed, F.lit(False)), F.col("__after.ts")).when(~start, F.col("ts"))
    began = F.when(start, F.col("ts"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    result = F.when(~start, F.col("status")).when(F.coalesce(closed, F.lit(False)), F.col("__after.status")).otherwise(F.lit("running"))
    error = F.when(~start, F.col("error")).when(F.coalesce(closed, F.lit(False)), F.col("__after.error"))
    return rows.select("id", "task", "attempt_no", began.alias("started_at"), end.alias("finished_at"), (seconds(end) - seconds(began)).alias("duration_s"), result.alias("result"), error.alias("error"))


def last_errors(events: DataFrame, length: int = 200) -> DataFrame:
    """(id, task, error, is_current): the newest error of each slide, in one line of bounded
    length, and whether its task has not ended well since."""
    failed = events.where("ts IS NOT NULL AND status = 'error' AND error IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("task", "error"), F.struct(*ORDER)).alias("e")).select("id", "e.*")
    now = latest(events).select("id", "task", "status")
    return failed.join(now, ["id", "task"], "left").select("id", "task", text.shortened(F.col("error"), length).alias("error"), (F.col("status") == "error").alias("is_current"))


def resume(events: DataFrame) -> DataFrame:
    """(id, last_task, last_status, last_message): where each slide stands; the message is the newest that there is."""
    rows = events.where("ts IS NOT NULL")
    newest = F.max_by(F.struct("task", "status"), F.struct(*ORDER)).alias("e")
    message = F.max_by(F.when(F.col("message").isNotNull(), F.col("message")), F.when(F.col("message").isNotNull(), F.struct(*ORDER))).alias("last_message")
    return rows.groupBy("id").agg(newest, message).select("id", F.col("e.task").alias("last_task"), F.col("e.status").alias("last_status"), "last_message")


def task_summary(events: DataFrame) -> DataFrame:
    """(id, task, states): the newest status by encoder ('' for tasks without one) as a map."""
    group, encoder = text.task_parts(F.col("task"))
    rows = latest(events).where("task IS NOT NULL").select("id", group.alias("task"), F.coalesce(encoder, F.lit("")).alias("encoder"), F.coalesce("status", F.lit("unknown")).alias("status"))
    return rows.groupBy("id", "task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("encoder", "status")))).alias("states"))


def upserted(lines: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the last value written under each key."""
    return lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def left_to_do(slides: DataFrame, wanted: list[str], done: DataFrame, keys: list[str]) -> DataFrame:
    """Slides (keys) that lack the output (keys, task) of a wanted task: each slide once a task,
    less the outputs there are. No tasks, nothing left."""
    if not wanted:
        return slides.select(*keys).limit(0)
    pairs = slides.select(*keys).distinct().withColumn("task", F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(wanted)])))
    return pairs.join(done, [*keys, "task"], "left_anti").select(*keys).distinct()


def triage(events: DataFrame) -> DataFrame:
    """(id, completed, skipped, failed, open): tasks of each slide by how they stand."""
    now = latest(events)
    n = lambda s: F.count_if(F.col("status") == s)
    return now.groupBy("id").agg(n("completed").alias("completed"), n("skipped").alias("skipped"), n("error").alias("failed"), n("running").alias("open"))
