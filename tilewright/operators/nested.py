"""Deeply nested, semi-structured documents as related flat tables, by Dewey labels.

Every node of a document gets the ordinal path from the root as its label ("0003.0001": the
first child of the root's third), so a parent's label is the child's without its last step, and
the nodes with equal schema path form one table. Where several shapes mean the same (a map, or
a list of named objects; a list, or its only element bare) the schema says so and the nodes are
labelled alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.common import require

NODES = "state_id bigint, dewey string, parent_dewey string, path string, key string, kind string, value string"


@dataclass(frozen=True)
class Shape:
    """How documents are read. Paths have '*' for any key and '[]' for any list position.

    named: paths whose children are named entries, given as a map or as a list of objects that
    carry their name; the value is the name's key. listed: paths that hold a list, or one bare
    element. envelope: keys that only wrap a document. root: a key that a complete document has.
    """

    named: dict[str, str] = field(default_factory=dict)
    listed: frozenset[str] = frozenset()
    envelope: tuple[str, ...] = ()
    root: tuple[str, ...] = ()


STATE = Shape(
    named={"tasks": "name", "tasks.*.outputs": "name"},
    listed=frozenset({"tasks.*.attempts"}),
    envelope=("state",),
    root=("slide", "tasks", "schema_version"),
)


def document(raw: str | None, shape: Shape) -> dict | None:
    """The document in raw, unpacked from byte order mark, outer blanks, string encoding (also
    repeated) and envelopes; None if there is none or it isn't complete. Numbers that JSON doesn't
    have, such as NaN, become their names, so that what holds them stays readable."""
    found: object = raw
    for _ in range(8):
        if isinstance(found, (bytes, bytearray)):
            found = found.decode("utf-8", "replace")
        if isinstance(found, str):
            try:
                found = json.loads(found.strip().lstrip("\ufeff").strip(), parse_constant=str)
            except (ValueError, RecursionError):
                return None
        elif isinstance(found, dict):
            inner = [k for k in shape.envelope if isinstance(found.get(k), (dict, str))]
            if not inner or any(k in found for k in shape.root):
                break
            found = found[inner[0]]
        elif isinstance(found, list) and len(found) == 1:
            found = found[0]
        else:
            return None
    return found if isinstance(found, dict) and (not shape.root or any(k in found for k in shape.root)) else None


def children(value: object, path: str, shape: Shape) -> list[tuple[str, str, object]]:
    """(schema path, key, value) of each child, in order."""
    if path in shape.named:
        name = shape.named[path]
        if isinstance(value, dict):
            return [(f"{path}.*", k, v) for k, v in value.items()]
        if isinstance(value, list):
            out = []
            for v in value:
                if isinstance(v, dict) and isinstance(v.get(name), str):
                    rest = {k: x for k, x in v.items() if k != name}
                    out.append((f"{path}.*", v[name], rest["value"] if set(rest) == {"value"} else rest))
            return out
        return []
    if path in shape.listed:
        if value is None:
            return []
        return [(f"{path}[]", str(i), v) for i, v in enumerate(value if isinstance(value, list) else [value], 1)]
    if isinstance(value, dict):
        return [(f"{path}.{k}" if path else k, k, v) for k, v in value.items()]
    if isinstance(value, list):
        return [(f"{path}[]", str(i), v) for i, v in enumerate(value, 1)]
    return []


_KINDS = ((bool, "boolean"), (int, "number"), (float, "number"), (str, "string"), (dict, "object"), (list, "array"))


def nodes(raw: str | None, shape: Shape, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    """(dewey, path, key, kind, value) of the nodes, parents first; those of the wanted schema
    paths if given. The value of an object or a list is its JSON."""
    doc = document(raw, shape)
    if doc is None:
        return
    into = None
    if wanted is not None:  # only subtrees that can hold a wanted path are entered
        into = {p[:i] for p in wanted for i in range(len(p) + 1)}
    stack: list[tuple[str, str, str, object]] = [("", "", "", doc)]
    while stack:
        dewey, path, key, value = stack.pop()
        if dewey and (wanted is None or path in wanted):
            kind = "null" if value is None else next((k for t, k in _KINDS if isinstance(value, t)), "string")
            text = None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
            yield dewey, path, key, kind, text
        if into is not None and path not in into:
            continue
        kids = children(value, path, shape)
        for i in range(len(kids), 0, -1):
            p, k, v = kids[i - 1]
            if into is None or p in into:
                stack.append((f"{dewey}.{i:06d}" if dewey else f"{i:06d}", p, k, v))


def shred(df: DataFrame, key: str = "state_id", raw: str = "raw", shape: Shape = STATE, wanted: list[str] | None = None) -> DataFrame:
    """The nodes of all documents: one row per node with its label, its parent's, its schema
    path, key (name or position), kind and value; one pass, one exchange.

    Null, empty, broken and incomplete documents have no rows, as have rows without key. A
    repeated record counts once. Other columns are ignored. An empty table gives no rows. A
    document of any length is read whole.
    """
    require(df, key, raw)
    only = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], [[] for _ in range(6)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for dewey, path, k, kind, value in nodes(text, shape, only):
                    ids.append(i)
                    for c, x in zip(cols, (dewey, dewey.rpartition(".")[0], path, k, kind, value)):
                        c.append(x)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in cols]],
                names=["state_id", "dewey", "parent_dewey", "path", "key", "kind", "value"],
            )

    rows = df.where(F.col(key).isNotNull() & F.col(raw).isNotNull()).select(F.col(key).cast("bigint"), F.col(raw).cast("string"))
    # one exchange by document serves the repeats here and whatever is done per task later
    return rows.mapInArrow(run, NODES).repartition("state_id").dropDuplicates(["state_id", "dewey"])


TASK, ATTEMPT, OUTPUT, ERROR = "tasks.*", "tasks.*.attempts[]", "tasks.*.outputs.*", "resume.last_error"


def _parent(column: str, steps: int = 1):
    return F.regexp_replace(column, r"(\.\d+){%d}$" % steps, "")


def state_tables(states: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of tasks, attempts, outputs and resume errors, each row tied to its state
    (state_id) and, by label, to its task (task_dewey); children of the same nodes() pass. A
    resume error has the label of the task that it names, null if its document has none."""
    all_nodes = shred(states, wanted=[TASK, ATTEMPT, OUTPUT, ERROR])
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    of = lambda path: all_nodes.where(F.col("path") == path)
    tasks = of(TASK).select("state_id", F.col("dewey").alias("task_dewey"), F.col("key").alias("task"), field("status"), field("reason"), field("message"))
    attempts = of(ATTEMPT).select(
        "state_id", "dewey", _parent("dewey", 2).alias("task_dewey"), F.col("key").cast("int").alias("attempt_no"), field("attempt_id"), field("result"), field("error"),
        F.expr("try_cast(get_json_object(value, '$.duration_s') AS double)").alias("duration_s"), field("started_at"), field("finished_at"), field("event"), field("ts"),
    )
    whole = F.when(F.col("kind") == "string", F.col("value"))
    outputs = of(OUTPUT).select(
        "state_id", "dewey", _parent("dewey", 2).alias("task_dewey"), F.col("key").alias("output"), F.coalesce(F.get_json_object("value", "$.path"), whole).alias("path"),
        F.expr("try_cast(get_json_object(value, '$.exists') AS boolean)").alias("exists"), F.expr("try_cast(get_json_object(value, '$.bytes') AS bigint)").alias("bytes"),
    )
    of_task = F.when(F.col("path") == TASK, F.struct("key", "dewey"))
    named = all_nodes.where(F.col("path").isin(TASK, ERROR)).withColumn("__tasks", F.collect_list(of_task).over(Window.partitionBy("state_id")))  # tasks of one document
    label = F.get(F.filter("__tasks", lambda t: t["key"] == F.get_json_object("value", "$.task")), F.lit(0))["dewey"]
    errors = named.where((F.col("path") == ERROR) & (F.col("kind") != "null")).select("state_id", "dewey", label.alias("task_dewey"), field("task"), field("at"), field("reason"), field("error"))
    return {"tasks": tasks, "attempts": attempts, "outputs": outputs, "resume": errors}


def state_children(states: DataFrame) -> DataFrame:
    """(state_id, task, child, child_key) of tasks, attempts, outputs and resume errors.

    A child's task is the key of the node its label leads to; the label of the task is carried
    along by cutting the child's, so no table is joined with another document's rows.
    """
    found = shred(states, wanted=[TASK, ATTEMPT, OUTPUT, ERROR])
    kinds = F.create_map(*[F.lit(x) for pair in ((TASK, "task"), (ATTEMPT, "attempt"), (OUTPUT, "output"), (ERROR, "last_error")) for x in pair])
    rows = found.where((F.col("path") != ERROR) | (F.col("kind") != "null")).select(
        "state_id", kinds[F.col("path")].alias("child"), "key",
        F.when(F.col("path") == ERROR, F.get_json_object("value", "$.task")).alias("named"),
        F.when(F.col("path") == TASK, F.col("dewey")).when(F.col("path") != ERROR, _parent("dewey", 2)).alias("task_dewey"),
    )
    owner = F.expr("max(CASE WHEN child = 'task' THEN key END) OVER (PARTITION BY state_id, task_dewey)")
    one = F.col("child").isin("task", "last_error")
    return rows.withColumn("owner", owner).select(
        "state_id", F.when(F.col("child") == "last_error", F.col("named")).otherwise(F.col("owner")).alias("task"), "child", F.when(one, F.lit("1")).otherwise(F.col("key")).alias("child_key")
    )
