"""Queries on the log of tasks and on what is left to do, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import table
from tilewright.operators import log, ranking


def _events(spark: SparkSession, d: str) -> DataFrame:
    return log.events_of(table(spark, d, "task_events"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return log.status_counts(_events(spark, d))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    return log.report_order(log.status_counts(_events(spark, d)))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = log.attempts(_events(spark, d))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c.replace("_at", "_us"))
    return rows.select("id", "task", "attempt_no", us("started_at"), us("finished_at"), F.round("duration_s", 3).alias("duration_s"), "result", "error")


def last_error(spark: SparkSession, d: str) -> DataFrame:
    return log.last_errors(_events(spark, d), 30)


def resume(spark: SparkSession, d: str) -> DataFrame:
    return log.resume(_events(spark, d))


def task_summary(spark: SparkSession, d: str) -> DataFrame:
    return log.task_summary(_events(spark, d)).select("id", "task", F.explode("states").alias("encoder", "status"))


def triage(spark: SparkSession, d: str) -> DataFrame:
    return log.triage(_events(spark, d))


def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).where("ts IS NOT NULL").withColumn("line", F.coalesce("message", "error", F.lit("-")))
    return log.upserted(rows, "id", "line", ["ts", "event_id"])


def task_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Slides that lack a completed segmentation, coords or features."""
    slides = table(spark, d, "slides").where("id IS NOT NULL").select("id")
    done = _events(spark, d).where("status = 'completed'").select("id", "task").distinct()
    return log.left_to_do(slides, ["segmentation", "coords", "patch_features:uni_v1"], done, ["id"])


def pending_slides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def already_done(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


def first_reason(spark: SparkSession, d: str) -> DataFrame:
    """The first of some rules in order that holds for a slide's grid."""
    n = table(spark, d, "patch_coords").where("patch_id IS NOT NULL").groupBy("id").agg(F.countDistinct("patch_id").alias("n"))
    rows = table(spark, d, "patch_grids").where("id IS NOT NULL").select("id", "level0_magnification", "overlap").dropDuplicates(["id"]).join(n, "id", "left")
    reason = ranking.first_reason([(F.col("level0_magnification").isNull(), "no_magnification"), (F.col("n").isNull(), "no_patch"), (F.col("overlap") > 0, "overlap")])
    return rows.select("id", reason.alias("reason"))


QUERIES = {f.__name__: f for f in (status_counts, report_order, attempts, last_error, resume, task_summary, triage, log_upsert, task_gaps, pending_slides, already_done, first_reason)}

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
_EV = f"""WITH e AS (SELECT DISTINCT ON (event_id) event_id, id, task, lower(trim(status, {_TRIM})) AS status, reason, message, lower(trim(event, {_TRIM})) AS event, ts, error FROM task_events WHERE event_id IS NOT NULL AND id IS NOT NULL),
n AS (SELECT id, task, arg_max(struct_pack(status := status, reason := reason, error := error), (ts, event_id)) AS v FROM e WHERE ts IS NOT NULL GROUP BY 1, 2)
"""
_COUNTS = (
    _EV
    + """, p AS (SELECT id, split_part(task, ':', 1) AS task, CASE WHEN contains(task, ':') THEN substr(task, strpos(task, ':') + 1) END AS encoder, coalesce(nullif(v.status, ''), 'unknown') AS status, coalesce(v.reason, '') AS reason FROM n),
k AS (SELECT task, encoder, CASE WHEN status <> 'unknown' AND reason <> '' THEN status || ' (' || reason || ')' ELSE status END AS label, count(*) AS n FROM p GROUP BY 1, 2, 3)
"""
)

SQL = {
    "status_counts": _COUNTS + "SELECT * FROM k",
    "report_order": _COUNTS + "SELECT *, CAST(row_number() OVER (PARTITION BY task, encoder ORDER BY coalesce(list_position(['completed', 'skipped', 'error', 'running', 'not_started', 'unknown'], split_part(label, ' ', 1)), 7), label) AS INTEGER) AS place FROM k",
    "attempts": _EV
    + """, r AS (SELECT *, lag(event) OVER w AS before, lead(event) OVER w AS after, lead(ts) OVER w AS nts, lead(status) OVER w AS nstatus, lead(error) OVER w AS nerror FROM e WHERE ts IS NOT NULL AND event IN ('started', 'finished', 'error') WINDOW w AS (PARTITION BY id, task ORDER BY ts, event_id)),
o AS (SELECT *, event = 'started' AS s, event = 'started' AND after IS NOT NULL AND after <> 'started' AS closed FROM r WHERE event = 'started' OR before IS NULL OR before <> 'started'),
a AS (SELECT id, task, CAST(row_number() OVER (PARTITION BY id, task ORDER BY ts, event_id) AS INTEGER) AS attempt_no, CASE WHEN s THEN ts END AS started_at, CASE WHEN closed THEN nts WHEN NOT s THEN ts END AS finished_at,
  CASE WHEN NOT s THEN status WHEN closed THEN nstatus ELSE 'running' END AS result, CASE WHEN NOT s THEN error WHEN closed THEN nerror END AS error FROM o)
SELECT id, task, attempt_no, epoch_us(started_at) AS started_us, epoch_us(finished_at) AS finished_us, round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6::DOUBLE, 3) AS duration_s, result, error FROM a""",
    "last_error": _EV
    + """, f AS (SELECT id, arg_max(struct_pack(task := task, error := error), (ts, event_id)) AS v FROM e WHERE ts IS NOT NULL AND status = 'error' AND error IS NOT NULL GROUP BY 1),
g AS (SELECT f.id, f.v.task AS task, trim(replace(f.v.error, chr(10), ' ')) AS error FROM f)
SELECT g.id, g.task, CASE WHEN length(error) > 30 THEN substr(error, 1, 30) || '…' ELSE error END AS error, n.v.status = 'error' AS is_current FROM g LEFT JOIN n ON g.id = n.id AND g.task = n.task""",
    "resume": _EV
    + """, s AS (SELECT id, arg_max(struct_pack(task := task, status := status), (ts, event_id)) AS v, arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS last_message FROM e WHERE ts IS NOT NULL GROUP BY 1)
SELECT id, v.task AS last_task, v.status AS last_status, last_message FROM s""",
    "task_summary": _EV + "SELECT id, split_part(task, ':', 1) AS task, CASE WHEN contains(task, ':') THEN substr(task, strpos(task, ':') + 1) ELSE '' END AS encoder, coalesce(v.status, 'unknown') AS status FROM n WHERE task IS NOT NULL",
    "triage": _EV + "SELECT id, " + ", ".join(f"count(*) FILTER (WHERE v.status = '{s}') AS {c}" for s, c in (("completed", "completed"), ("skipped", "skipped"), ("error", "failed"), ("running", "open"))) + " FROM n GROUP BY 1",
    "log_upsert": _EV + "SELECT id, arg_max(coalesce(message, error, '-'), (ts, event_id)) AS line FROM e WHERE ts IS NOT NULL GROUP BY 1",
    "task_gaps": _EV
    + """, d AS (SELECT DISTINCT id, task FROM e WHERE status = 'completed'), w AS (SELECT DISTINCT id, unnest(['segmentation', 'coords', 'patch_features:uni_v1']) AS task FROM slides WHERE id IS NOT NULL)
SELECT DISTINCT w.id FROM w ANTI JOIN d ON w.id = d.id AND w.task = d.task""",
    "pending_slides": "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "already_done": "SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey",
    "first_reason": """WITH n AS (SELECT id, count(DISTINCT patch_id) AS n FROM patch_coords WHERE patch_id IS NOT NULL GROUP BY 1), g AS (SELECT DISTINCT ON (id) id, level0_magnification, overlap FROM patch_grids WHERE id IS NOT NULL)
SELECT g.id, CASE WHEN level0_magnification IS NULL THEN 'no_magnification' WHEN n IS NULL THEN 'no_patch' WHEN overlap > 0 THEN 'overlap' END AS reason FROM g LEFT JOIN n USING (id)""",
}
