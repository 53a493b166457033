"""The log of tasks: attempts, labels, what is kept and what the newest event decides."""

import datetime as dt

from pyspark.sql import functions as F

from tilewright.operators import log

SCHEMA = "event_id long, id string, task string, status string, reason string, message string, event string, ts timestamp_ntz, error string, x string"


def frame(spark, *rows):
    at = lambda i: None if i is None else dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)
    return spark.createDataFrame([(n, *r[:6], at(r[6]), r[7], "x") for n, r in enumerate(rows)], SCHEMA)


def event(task, status, event, ts, reason=None, error=None, message=None, slide="s"):
    return (slide, task, status, reason, message, event, ts, error)


def test_attempts(spark):
    rows = [
        event("seg", "running", "started", 1), event("seg", " Completed ", "finished", 4), event("seg", "error", "error", 9, error="late"), event("seg", "running", "started", 10),
        event("seg", "running", "started", 11), event("seg", "error", "error", 13, error="boom"), event("seg", "skipped", None, 14), event("seg", "running", "started", None), event("feat", "running", "started", 2),
    ]
    got = [(r["task"], r["attempt_no"], r["started_at"] is not None, r["duration_s"], r["result"], r["error"]) for r in log.attempts(log.events_of(frame(spark, *rows))).orderBy("task", "attempt_no").collect()]
    assert got == [("feat", 1, True, None, "running", None), ("seg", 1, True, 3.0, "completed", None), ("seg", 2, False, None, "error", "late"), ("seg", 3, True, None, "running", None), ("seg", 4, True, 2.0, "error", "boom")]


def test_counts_and_their_order(spark):
    rows = [event("feat:uni", "completed", "finished", 1, slide=s) for s in "ab"] + [event("feat:titan", "error", "error", 1, "exception", "boom"), event("seg", "odd", None, 1), event("seg", "skipped", None, 2, "locked", slide="b"), event("seg", None, None, 2, slide="c")]
    e = log.events_of(frame(spark, *rows, rows[0]))
    got = {(r["task"], r["encoder"], r["label"]): (r["n"], r["place"]) for r in log.report_order(log.status_counts(e)).collect()}
    assert got == {("feat", "uni", "completed"): (2, 1), ("feat", "titan", "error (exception)"): (1, 1), ("seg", None, "skipped (locked)"): (1, 1), ("seg", None, "unknown"): (1, 2), ("seg", None, "odd"): (1, 3)}


def test_errors_resume_and_summary(spark):
    rows = [event("seg", "error", "error", 1, error="first\nline"), event("seg", "completed", "finished", 2, message="fine"), event("feat:uni", "running", "started", 3)]
    e = log.events_of(frame(spark, *rows))
    assert [tuple(r) for r in log.last_errors(e).collect()] == [("s", "seg", "first line", False)]
    assert [tuple(r) for r in log.resume(e).collect()] == [("s", "feat:uni", "running", "fine")]
    assert {r["task"]: r["states"] for r in log.task_summary(e).collect()} == {"seg": {"": "completed"}, "feat": {"uni": "running"}}
    assert [tuple(r) for r in log.triage(e).collect()] == [("s", 1, 0, 0, 1)]


def test_left_to_do(spark):
    slides = spark.createDataFrame([("a",), ("b",), ("b",)], "sid string")
    done = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "sid string, task string")
    left = lambda *t: [r[0] for r in log.left_to_do(slides, list(t), done, ["sid"]).collect()]
    assert left("x", "y") == ["b"] and left("x") == [] and left() == []


def test_empty(spark):
    e = log.events_of(frame(spark).limit(0))
    for f in (log.attempts, log.status_counts, log.last_errors, log.resume, log.task_summary, log.triage):
        assert f(e).count() == 0
    assert log.upserted(e.withColumn("line", F.lit("x")), "id", "line", ["ts"]).count() == 0
