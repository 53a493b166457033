"""Packs hold no more than they can, every token is in one, and texts are split only if they must be."""

import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tilewright.llm import packing

SIZES = [("short", 64), ("long", 500)]


def test_invariants(spark):
    docs = [(i, "word " * (i * 7 % 90)) for i in range(300)] + [(1000, "lorem ipsum " * 900), (1001, None), (1002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sizes = spark.createDataFrame(SIZES, "pack_kind string, capacity_tokens int")
    rows = packing.pack(df, sizes, open_packs=8).collect()
    encode = packing.encoding(packing.default_vocabulary()).encode_ordinary
    count = {d: len(encode(t)) for d, t in docs if t is not None}
    for kind, capacity in SIZES:
        mine = [r for r in rows if r["pack_kind"] == kind]
        held, whole = {}, {}
        for r in mine:
            if r["pack_id"]:
                held[r["pack_id"]] = held.get(r["pack_id"], 0) + r["n_tokens"]
            whole.setdefault(r["doc_id"], []).append(r)
        assert max(held.values()) <= capacity and {d: sum(r["n_tokens"] for r in p) for d, p in whole.items()} == count
        assert all(len(p) == max(1, -(-count[d] // capacity)) for d, p in whole.items())
        assert len(held) <= 1.35 * sum(count.values()) / capacity + 3 * 8
    fill = {r["pack_kind"]: r for r in packing.pack_fill(packing.pack(df, sizes)).collect()}
    assert all(fill[k]["least_packs"] <= fill[k]["packs"] and fill[k]["fullest"] <= c for k, c in SIZES)


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_best_fit(items, limit):
    packs = packing.OpenPacks(50, limit, "p")
    used = {}
    for n in items:
        p = packs.place(n)
        used[p] = used.get(p, 0) + n
        assert packs.open <= limit and used[p] <= 50


def test_bad_kinds(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (None, 0):
        with pytest.raises(ValueError, match="at least 1"):
            packing.pack(df, spark.createDataFrame([("x", bad)], "pack_kind string, capacity_tokens int"))


def test_long_texts_keep_their_tokens():
    encode = packing.encoding(packing.default_vocabulary()).encode_ordinary
    text = "The lease,  it was held, ran to 1999. " * 6000
    assert [t for s in packing.spans(text) for t in encode(s)] == encode(text)
    assert os.path.exists(packing.default_vocabulary())
