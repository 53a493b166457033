"""Half of an item in stretches of five words is found."""

import random

from tilewright.llm import leakage


def test_short_stretches(spark):
    item = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(120)]
    doc = " ".join(w if i % 10 < 5 else f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, w in enumerate(item))
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    items = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()] == [(1, 2)]


def test_against_brute_force_in_blocks_and_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    item = lambda: [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 90]))]
    items = {i: item() for i in range(40)}
    docs, want = [], set()
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(300)]
        if d % 2:
            i = rng.randrange(40)
            part = items[i] if d % 3 else items[i][: len(items[i]) * 2 // 3]
            text[100:100] = part
            want.add((d, i))
        docs.append((d, " ".join(text).upper().replace(" ", "\n", 3), 1.0))
    docs += [(100, None, 1.0), (101, "", 1.0), (None, " ".join(items[0]), 1.0), (1, docs[1][1], 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, share double")
    rows = [(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "too short"), (0, " ".join(items[0]))]
    wanted = spark.createDataFrame(rows, "item_id long, text string")
    for kwargs in ({}, {"block": 11}, {"block_mb": 0.004}):
        assert {(r[0], r[1]) for r in leakage.leaks(df, wanted, **kwargs).collect()} == want
    assert leakage.leaks(df.limit(0), wanted).count() == 0 and leakage.leaks(df, wanted.limit(0)).count() == 0
