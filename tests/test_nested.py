"""State documents in all their shapes become flat tables that keep their links."""

import json

from tilewright.operators import nested

DOC = {
    "slide": {"id": "s"},
    "tasks": {
        "segmentation": {"status": "error", "attempts": [{"attempt_id": "a"}, {"attempt_id": "b", "duration_s": 1.5}], "outputs": {"mask": {"path": "/m", "exists": True, "bytes": 7}, "empty": None}},
        "coords:x": {"attempts": {"attempt_id": "c"}, "outputs": "odd"},
    },
    "resume": {"last_error": {"task": "segmentation", "error": "boom"}},
}


def frame(spark, *raws):
    return spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "state_id bigint, raw string")


def children(spark, *raws):
    return sorted(tuple(r) for r in nested.state_children(frame(spark, *raws)).collect())


WANT = [(0, "coords:x", "attempt", "1"), (0, "coords:x", "task", "1"), (0, "segmentation", "attempt", "1"), (0, "segmentation", "attempt", "2"), (0, "segmentation", "last_error", "1"), (0, "segmentation", "output", "empty"), (0, "segmentation", "output", "mask"), (0, "segmentation", "task", "1")]


def test_children(spark):
    assert children(spark, json.dumps(DOC)) == WANT


def test_packing_and_shapes(spark):
    listed = DOC | {"tasks": [{"name": k, **v} for k, v in DOC["tasks"].items()]}
    for raw in (" ﻿" + json.dumps(DOC), json.dumps(json.dumps(DOC)), json.dumps({"state": DOC}), json.dumps([DOC]), json.dumps(listed)):
        assert children(spark, raw) == WANT


def test_no_documents(spark):
    assert children(spark, None, "", "{", "[]", "3", '{"a": 1}', json.dumps(DOC)[:-9]) == []
    assert nested.state_children(frame(spark).limit(0)).count() == 0


def test_repeats_and_clashing_columns(spark):
    df = frame(spark, json.dumps(DOC))
    df = df.union(df).selectExpr("*", "'x' AS dewey", "1 AS path", "2 AS key")
    assert sorted(tuple(r) for r in nested.state_children(df).collect()) == WANT


def test_tables_keep_parent_labels(spark):
    tables = {k: v.collect() for k, v in nested.state_tables(frame(spark, json.dumps(DOC))).items()}
    labels = {r["task"]: r["task_dewey"] for r in tables["tasks"]}
    assert {(r["task_dewey"], r["attempt_no"], r["attempt_id"]) for r in tables["attempts"]} == {(labels["segmentation"], 1, "a"), (labels["segmentation"], 2, "b"), (labels["coords:x"], 1, "c")}
    assert all(r["dewey"].startswith(r["task_dewey"] + ".") for r in [*tables["attempts"], *tables["outputs"]])
    assert [(r["task_dewey"], r["error"]) for r in tables["resume"]] == [(labels["segmentation"], "boom")]


def test_numbers_that_json_does_not_have(spark):
    raw = json.dumps(DOC).replace("1.5", "NaN")
    assert [(r["attempt_id"], str(r["duration_s"])) for r in nested.state_tables(frame(spark, raw))["attempts"].collect() if r["attempt_id"] == "b"] == [("b", "nan")]
