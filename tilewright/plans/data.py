"""Queries of the general data problems (3, 4 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import scratch, table
from tilewright.operators import incremental, nested, skew


def _runs(spark: SparkSession, d: str) -> incremental.Ledger:
    """Two runs over slides and task_events: of what had arrived after nine tenths of the time,
    then of all. The second processes only the gaps, which hold late rows too."""
    slides, events = table(spark, d, "slides"), table(spark, d, "task_events")
    ledger = incremental.slide_ledger(spark, scratch(spark, "ledger"))
    lo, hi = slides.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    if lo is not None:
        until = F.lit(lo + (hi - lo) * 0.9).cast("timestamp_ntz")
        early = lambda df: df.where(F.col("arrived_at") <= until)
        ledger.run(incremental.slide_sources(early(slides), early(events)))
    ledger.run(incremental.slide_sources(slides, events))
    return ledger


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending(_runs(spark, d))


def p3_processed(spark: SparkSession, d: str) -> DataFrame:
    """The intervals of sequence numbers that are processed after all runs."""
    return incremental.maximal(_runs(spark, d).processed())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_names(table(spark, d, "patch_coords")).select("name")


def p4_slide_extents(spark: SparkSession, d: str) -> DataFrame:
    return skew.slide_extents(table(spark, d, "patch_coords"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_children(table(spark, d, "wsi_states"))


def _p5(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.state_tables(table(spark, d, "wsi_states"))[name]
        return rows.withColumns({c: F.col(c).cast("int") for c, kind in rows.dtypes if kind == "boolean"})

    return run


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"

_DOCS = r"""
WITH RECURSIVE docs AS (
  SELECT state_id, trim(any_value(raw), chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS raw FROM wsi_states WHERE state_id IS NOT NULL GROUP BY 1),
once AS (
  SELECT state_id, CASE WHEN json_type(j) = 'VARCHAR' THEN trim(json_extract_string(j, '$'), chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) ELSE raw END AS raw
  FROM (SELECT state_id, raw, TRY_CAST(raw AS JSON) AS j FROM docs) WHERE j IS NOT NULL),
opened AS (SELECT state_id, TRY_CAST(raw AS JSON) AS j FROM once),
state AS (SELECT state_id, CASE WHEN json_type(j, '$.state') = 'OBJECT' THEN json_extract(j, '$.state') ELSE j END AS j FROM opened WHERE json_type(j) = 'OBJECT'),
tasks AS (
  SELECT state_id, k AS task, json_extract(j, '$.tasks."' || k || '"') AS t FROM (SELECT state_id, j, unnest(json_keys(j, '$.tasks')) AS k FROM state WHERE json_type(j, '$.tasks') = 'OBJECT')
  UNION ALL
  SELECT state_id, json_extract_string(t, '$.name'), t FROM (SELECT state_id, unnest(json_extract(j, '$.tasks[*]')) AS t FROM state WHERE json_type(j, '$.tasks') = 'ARRAY')),
children AS (
  SELECT state_id, task, 'task' AS child, '1' AS child_key FROM tasks
  UNION ALL
  SELECT state_id, task, 'attempt', CAST(unnest(range(1, CAST(json_array_length(t, '$.attempts') AS BIGINT) + 1)) AS VARCHAR) FROM tasks WHERE json_type(t, '$.attempts') = 'ARRAY'
  UNION ALL
  SELECT state_id, task, 'attempt', '1' FROM tasks WHERE json_type(t, '$.attempts') NOT IN ('ARRAY', 'NULL')
  UNION ALL
  SELECT state_id, task, 'output', unnest(json_keys(t, '$.outputs')) FROM tasks WHERE json_type(t, '$.outputs') = 'OBJECT'
  UNION ALL
  SELECT state_id, task, 'output', json_extract_string(o, '$.name') FROM (SELECT state_id, task, unnest(json_extract(t, '$.outputs[*]')) AS o FROM tasks WHERE json_type(t, '$.outputs') = 'ARRAY')
  UNION ALL
  SELECT state_id, json_extract_string(j, '$.resume.last_error.task'), 'last_error', '1' FROM state WHERE json_type(j, '$.resume.last_error') NOT IN ('NULL'))
"""

_NODES = (
    _DOCS[: _DOCS.index("tasks AS (")]
    + r"""root AS (SELECT state_id, j, printf('%06d.', list_position(json_keys(j), 'tasks')) AS head FROM state),
raw_list AS (SELECT state_id, head, unnest(json_extract(j, '$.tasks[*]')) AS t, generate_subscripts(json_extract(j, '$.tasks[*]'), 1) AS pos FROM root WHERE json_type(j, '$.tasks') = 'ARRAY'),
tasks AS (
  SELECT state_id, head || printf('%06d', i) AS task_dewey, k AS task, json_extract(j, '$.tasks."' || k || '"') AS t, -1 AS named
  FROM (SELECT state_id, head, j, unnest(json_keys(j, '$.tasks')) AS k, generate_subscripts(json_keys(j, '$.tasks'), 1) AS i FROM root WHERE json_type(j, '$.tasks') = 'OBJECT')
  UNION ALL
  SELECT state_id, head || printf('%06d', row_number() OVER (PARTITION BY state_id ORDER BY pos)), json_extract_string(t, '$.name'), t, list_position(json_keys(t), 'name')
  FROM raw_list WHERE json_type(t) = 'OBJECT' AND json_type(t, '$.name') = 'VARCHAR'),
-- the place of a key among a task's children, the name of a listed task not being one
under AS (SELECT *, list_position(json_keys(t), 'attempts') AS pa, list_position(json_keys(t), 'outputs') AS po FROM tasks WHERE json_type(t) = 'OBJECT'),
places AS (SELECT state_id, task_dewey, task, t, task_dewey || printf('.%06d.', pa - CAST(named BETWEEN 0 AND pa AS INTEGER)) AS pa, task_dewey || printf('.%06d.', po - CAST(named BETWEEN 0 AND po AS INTEGER)) AS po FROM under),
attempts AS (
  SELECT state_id, task_dewey, pa, unnest(json_extract(t, '$.attempts[*]')) AS v, generate_subscripts(json_extract(t, '$.attempts[*]'), 1) AS i FROM places WHERE json_type(t, '$.attempts') = 'ARRAY'
  UNION ALL SELECT state_id, task_dewey, pa, json_extract(t, '$.attempts'), 1 FROM places WHERE json_type(t, '$.attempts') NOT IN ('ARRAY', 'NULL')),
outputs AS (
  SELECT state_id, task_dewey, po, k AS output, json_extract(t, '$.outputs."' || k || '"') AS v, i FROM (SELECT *, unnest(json_keys(t, '$.outputs')) AS k, generate_subscripts(json_keys(t, '$.outputs'), 1) AS i FROM places WHERE json_type(t, '$.outputs') = 'OBJECT')
  UNION ALL
  SELECT state_id, task_dewey, po, json_extract_string(v, '$.name'), CASE WHEN len(json_keys(v)) = 2 AND list_contains(json_keys(v), 'value') THEN json_extract(v, '$.value') ELSE v END, row_number() OVER (PARTITION BY state_id, task_dewey ORDER BY pos)
  FROM (SELECT *, unnest(json_extract(t, '$.outputs[*]')) AS v, generate_subscripts(json_extract(t, '$.outputs[*]'), 1) AS pos FROM places WHERE json_type(t, '$.outputs') = 'ARRAY') WHERE json_type(v) = 'OBJECT' AND json_type(v, '$.name') = 'VARCHAR')
"""
)
_F = "json_extract_string({v}, '$.{f}') AS \"{f}\""


def _fields(v: str, *names: str) -> str:
    return ", ".join(_F.format(v=v, f=n) for n in names)


QUERIES = {
    "p3_found": p3_found,
    "p3_processed": p3_processed,
    "p4_found": p4_found,
    "p4_slide_extents": p4_slide_extents,
    "p5_found": p5_found,
    "p5_tasks": _p5("tasks"),
    "p5_attempts": _p5("attempts"),
    "p5_outputs": _p5("outputs"),
    "p5_resume": _p5("resume"),
}

SQL = {
    "p3_found": f"""
WITH l AS (SELECT id, arg_max(checksum, (listed_at, listing_id)) AS c FROM slides WHERE checksum IS NOT NULL AND id IS NOT NULL GROUP BY id),
d AS (SELECT id, arg_max(struct_pack(c := checksum), (ts, event_id)).c AS c FROM task_events WHERE task = 'segmentation' AND lower(trim(status, {_BLANK})) = 'completed' GROUP BY id)
SELECT l.id FROM l LEFT JOIN d USING (id) WHERE d.c IS NULL OR d.c <> l.c""",
    "p3_processed": """
WITH s AS (SELECT DISTINCT 'slides' AS source, listing_id AS seq FROM slides UNION SELECT DISTINCT 'task_events', event_id FROM task_events),
i AS (SELECT source, seq, seq - row_number() OVER (PARTITION BY source ORDER BY seq) AS island FROM s WHERE seq IS NOT NULL)
SELECT source, min(seq) AS lo, max(seq) AS hi FROM i GROUP BY source, island""",
    "p4_found": f"""
WITH p AS (SELECT patch_id, lower(trim(any_value(name), {_BLANK})) AS name FROM patch_coords WHERE patch_id IS NOT NULL GROUP BY patch_id)
SELECT name FROM p WHERE name IS NOT NULL GROUP BY name HAVING count(*) * 100 >= (SELECT count(*) FROM p)""",
    "p4_slide_extents": f"""
WITH p AS (SELECT patch_id, any_value(struct_pack(n := name, i := id, c := coords)) AS s FROM patch_coords WHERE patch_id IS NOT NULL GROUP BY patch_id),
q AS (SELECT patch_id, lower(trim(s.n, {_BLANK})) AS name, s.i AS id,
        CASE WHEN len(s.c) = 2 AND s.c[1] >= 0 AND s.c[2] >= 0 THEN s.c[1] END AS x,
        CASE WHEN len(s.c) = 2 AND s.c[1] >= 0 AND s.c[2] >= 0 THEN s.c[2] END AS y FROM p)
SELECT name, id, count(*) AS n_patches, count(x) AS n_located, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM q GROUP BY name, id""",
    "p5_tasks": _NODES + f"SELECT state_id, task_dewey, task, {_fields('t', 'status', 'reason', 'message')} FROM tasks",
    "p5_attempts": _NODES
    + f"SELECT state_id, pa || printf('%06d', i) AS dewey, task_dewey, CAST(i AS INTEGER) AS attempt_no, {_fields('v', 'attempt_id', 'result', 'error', 'started_at', 'finished_at', 'event', 'ts')}, TRY_CAST(json_extract_string(v, '$.duration_s') AS DOUBLE) AS duration_s FROM attempts",
    "p5_outputs": _NODES
    + "SELECT state_id, po || printf('%06d', i) AS dewey, task_dewey, output, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE json_extract_string(v, '$.path') END AS path, CAST(TRY_CAST(json_extract_string(v, '$.exists') AS BOOLEAN) AS INTEGER) AS exists, TRY_CAST(json_extract_string(v, '$.bytes') AS BIGINT) AS bytes FROM outputs",
    "p5_resume": _NODES
    + f""", e AS (SELECT state_id, printf('%06d.%06d', list_position(json_keys(j), 'resume'), list_position(json_keys(j, '$.resume'), 'last_error')) AS dewey, json_extract(j, '$.resume.last_error') AS v FROM root WHERE json_type(j, '$.resume.last_error') NOT IN ('NULL'))
SELECT e.state_id, e.dewey, min(x.task_dewey) AS task_dewey, {_fields('e.v', 'task', 'at', 'reason', 'error')} FROM e LEFT JOIN tasks x ON x.state_id = e.state_id AND x.task = json_extract_string(e.v, '$.task') GROUP BY ALL""",
    "p5_found": _DOCS + "SELECT DISTINCT state_id, task, child, child_key FROM children",
}
