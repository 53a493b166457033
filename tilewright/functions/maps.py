"""Maps and JSON: pruning, merging, flattening."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pruned(m: Column) -> Column:
    """Without the entries whose value is null."""
    return F.map_filter(m, lambda _, v: v.isNotNull())


def merged(left: Column, right: Column) -> Column:
    """Entries of both; of an equal key the right one, unless it is null."""
    kept = pruned(right)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(kept, k)), kept)


def first_number(json: Column, paths: list[str], digits: int = 4) -> Column:
    """The first of the JSON paths that holds a number, rounded half to even; others are skipped."""
    return F.coalesce(*[F.bround(F.get_json_object(json, p).try_cast("double"), digits) for p in paths])


def flattened(json: str) -> dict[str, str | None]:
    """Dotted lower-case keys of all leaves of a JSON object; {} if it isn't one."""
    import json as reader

    try:
        found = reader.loads(json)
    except (TypeError, ValueError):
        return {}
    out: dict[str, str | None] = {}
    stack = [("", found)] if isinstance(found, dict) else []
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{at}.{k}".lstrip(".").lower(), v) for k, v in reversed(value.items())]
        else:
            out[at] = None if value is None else value if isinstance(value, str) else reader.dumps(value, ensure_ascii=False)
    return out


def leaves(json: Column) -> Column:
    """flattened() as map<string,string>, in Arrow batches."""
    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(flattened)

    return run(json)
