"""Held-out passages inside a corpus: size-partitioned MinHash containment search, then an
exact check.

The passages (short) are parted by size; within a part the largest has u shingles and each
document is seen as windows of 2u shingles, u apart, so that a passage of the part lies whole
in one window. MinHash values of windows and passages, over the same hash functions, agree as
often as the two sets' Jaccard similarity; the containment threshold gives, by the sizes, the
number of agreements from which a pair is a candidate. Candidates are checked word by word.
The documents are read once and never shuffled; the passages go to every task, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.common import require
from tilewright.llm.words import K, codes, shingles, words

#: Words of documents that are handled at once.
CHUNK = 400_000


@dataclass
class Part:
    """Passages of similar size: their places, minima (passage x hash function) and thresholds."""

    width: int
    places: np.ndarray
    minima: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per hash function: values, offsets, places
    least: np.ndarray


def _half(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


def _mixed(x: np.ndarray, mask: np.uint32, factor: np.uint32, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """One of the hash functions, a bijection of 32-bit numbers."""
    out = np.bitwise_xor(x, mask, out=out)
    np.multiply(out, factor, out=out)
    np.bitwise_xor(out, np.right_shift(out, np.uint32(15), out=spare), out=out)
    return np.multiply(out, factor, out=out)


class Passages:
    """The passages as searched for; built once and sent to all tasks."""

    def __init__(self, items: list[tuple[int, str]], hashes: int, contained: float):
        found = [(i, w) for i, text in items if len(w := words(text or "")) >= K]
        self.ids = [i for i, _ in found]
        self.words = [w for _, w in found]
        found_in = [shingles(codes(w)) for w in self.words]
        rng = np.random.default_rng(20240611)
        self.masks = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.factors = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        ordered = [np.unique(s, return_index=True) for s in found_in]
        sets = [values for values, _ in ordered]
        self.sizes = np.array([len(v) for v in sets], dtype=np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        by = np.argsort(every, kind="stable")
        self.values, first = np.unique(every[by], return_index=True)  # each shingle, with the passages that have it
        self.first = np.append(first, len(every))
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[by] if sets else np.empty(0, dtype=np.int64)
        self.spots = np.concatenate([at for _, at in ordered])[by] if sets else np.empty(0, dtype=np.int64)
        order = sorted(range(len(sets)), key=lambda p: len(sets[p]))
        self.parts: list[Part] = []
        while order:
            most = 2 * len(sets[order[0]])
            own = [p for p in order if len(sets[p]) <= most]
            order = order[len(own) :]
            u = len(sets[own[-1]])
            sig = np.stack([_mixed(_half(sets[p])[None, :], self.masks[:, None], self.factors[:, None]).min(axis=1) for p in own])
            minima = []
            for h in range(hashes):
                by = np.argsort(sig[:, h], kind="stable")
                values, first = np.unique(sig[by, h], return_index=True)
                minima.append((values, np.append(first, len(own)), by))
            q = np.array([len(sets[p]) for p in own], dtype=float)
            jaccard = contained * q / (2 * u + q - contained * q)
            self.parts.append(Part(u, np.array(own), minima, np.maximum(1, np.floor(hashes * jaccard / 2)).astype(np.int64)))

    def hits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All shingles that documents have in common with passages: (document * passages + passage,
        place in the document, place in the passage), in that order."""
        sizes = np.array([len(s) for s in docs])
        flat = np.concatenate(docs) if len(docs) else np.empty(0, dtype=np.uint64)
        at = np.searchsorted(self.values, flat)
        at[at == len(self.values)] = 0
        found = np.nonzero(self.values[at] == flat)[0] if len(self.values) else np.empty(0, dtype=np.int64)
        v = at[found]
        times = self.first[v + 1] - self.first[v]
        entry = np.repeat(self.first[v], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, found, side="right")
        place = found - (ends - sizes)[doc]
        key = np.repeat(doc, times) * len(self.ids) + self.owners[entry]
        order = np.lexsort((np.repeat(place, times), key))
        return key[order], np.repeat(place, times)[order], self.spots[entry][order]

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(documents, first shingles, passages, width) of the windows that may hold a passage, part
        by part."""
        for part in self.parts:
            u = part.width
            blocks = np.array([-(-len(s) // u) for s in docs])
            ends = np.cumsum(blocks)
            if not len(ends) or not ends[-1]:
                continue
            flat = np.zeros(ends[-1] * u, dtype=np.uint32)
            filled = np.zeros(ends[-1] * u, dtype=bool)
            for s, e, b in zip(docs, ends, blocks):
                at = (e - b) * u
                flat[at : at + len(s)] = _half(s)
                filled[at : at + len(s)] = True
            empty = np.nonzero(~filled)[0]
            last = np.zeros(ends[-1], dtype=bool)
            last[ends[blocks > 0] - 1] = True
            keys = []
            hashed, spare = np.empty_like(flat), np.empty_like(flat)
            for mask, factor, (values, first, by) in zip(self.masks, self.factors, part.minima):
                _mixed(flat, mask, factor, hashed, spare)
                hashed[empty] = 0xFFFFFFFF
                low = hashed.reshape(-1, u).min(axis=1)
                low[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                at = np.searchsorted(values, low)
                at[at == len(values)] = 0
                windows = np.nonzero(values[at] == low)[0]
                v = at[windows]
                times = first[v + 1] - first[v]
                entry = np.repeat(first[v], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                keys.append(np.repeat(windows, times) * len(by) + by[entry])
            pairs, agree = np.unique(np.concatenate(keys), return_counts=True)
            pairs = pairs[agree >= part.least[pairs % len(part.places)]]
            window, place = np.divmod(pairs, len(part.places))
            doc = np.searchsorted(ends, window, side="right")
            yield doc, (window - (ends - blocks)[doc]) * u, part.places[place], u

    def verified(self, docs: list[np.ndarray], contained: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int]]]]:
        """(document, first shingle, end, passage, hits) of the candidates whose surroundings, a
        window to either side, hold at least the share `contained` of the passage's shingles."""
        key, place, spot = self.hits(docs)
        at = key * (1 << 32) + place
        for doc, start, passage, u in self.candidates(docs):
            lo, hi = np.maximum(0, start - u), start + 3 * u
            pair = (doc * len(self.ids) + passage) * (1 << 32)
            a, b = np.searchsorted(at, pair + lo), np.searchsorted(at, pair + hi)
            for c in np.nonzero(b - a >= contained * self.sizes[passage])[0]:
                own = spot[a[c] : b[c]]
                if len(set(own.tolist())) >= contained * self.sizes[passage[c]]:
                    yield int(doc[c]), int(lo[c]), int(hi[c]), int(passage[c]), list(zip((place[a[c] : b[c]] - lo[c]).tolist(), own.tolist()))


def _alike(a: list[bytes], b: list[bytes]) -> bool:
    """The same letters but for few, however they are cut into words."""
    x, y = b"".join(a).decode("utf-8", "replace"), b"".join(b).decode("utf-8", "replace")
    return SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.7


def _bridged(doc: list[bytes], item: list[bytes], a: list[int], b: list[int]) -> int:
    """Words of the item between two runs that count as held: all, if the document has as many
    there and they differ by damage only."""
    x, y = doc[a[1] : b[0]], item[a[3] : b[2]]
    if y and abs(len(x) - len(y)) <= 1 + len(y) // 4 and len(y) < 4 * K and _alike(x, y):
        return len(y)
    return 0


def held(doc: list[bytes], item: list[bytes], hits: list[tuple[int, int]], slack: float = 1.6) -> float:
    """The largest share of the item's words that doc holds in order, within a passage of `slack`
    times the item's length, in stretches of K words or more; single damaged words between two
    stretches are none the less held. hits: places (in doc, in item) of equal shingles."""
    runs: list[list[int]] = []  # first and end in doc, first and end in item
    last: dict[int, list[int]] = {}
    for i, j in sorted(hits):
        r = last.get(i - j)
        if r and r[1] >= i:
            r[1], r[3] = i + K, j + K
        else:
            last[i - j] = r = [i, i + K, j, j + K]
            runs.append(r)
    most, width = 0, slack * len(item) + 10
    for s in range(len(runs)):
        if most >= len(item):
            break
        best = {s: runs[s][3] - runs[s][2]}
        for t in range(s + 1, len(runs)):
            if runs[t][1] - runs[s][0] > width:
                continue
            gains = [g + runs[t][3] - max(runs[t][2], runs[p][3]) + _bridged(doc, item, runs[p], runs[t])
                     for p, g in best.items() if runs[p][0] < runs[t][0] and runs[p][2] < runs[t][2] and runs[p][3] < runs[t][3]]
            if gains:
                best[t] = max(gains)
        most = max(most, *best.values())
    return most / len(item)


FOUND = "doc_id bigint, item_id bigint, share double"


def leaks(
    documents: DataFrame, items: DataFrame, share: float = 0.5, hashes: int = 128, contained: float = 0.1, block: int = 20_000, block_mb: float = 16
) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least `share` of an item's words, in
    one passage, in order, in stretches of K words or more.

    contained is the share of an item's shingles from which MinHash must propose a pair; it is
    lower than `share`, because each break in a passage costs K - 1 shingles. Items are taken
    about `block` at a time, or fewer if their texts exceed block_mb MB, each block in one pass over
    the documents; only one block at a time is brought to the driver and sent to the tasks.

    Null and empty texts hold nothing and are held by nothing, nor are items of fewer than K
    words. Texts are read whole. An item or a document that occurs twice gives its rows once.
    """
    require(documents, "doc_id", "text")
    require(items, "item_id", "text")
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    wanted = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), int(-(-size // (block_mb * 1e6))))
    out = None
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = _search(rows, Passages([(r[0], r[1]) for r in own.collect()], hashes, contained), share, contained)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _search(rows: DataFrame, sought: Passages, share: float, contained: float) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(sought)

    def check(ids: list, texts: list, passages: Passages) -> Iterator[tuple]:
        coded = [codes(w) for w in texts]
        docs = [shingles(c) for c in coded]
        best: dict[tuple[int, int], float] = {}
        for d, lo, hi, p, hits in passages.verified(docs, 0.75 * contained):
            if best.get((d, p), 0) < 0.999:
                best[d, p] = max(best.get((d, p), 0), held(texts[d][lo : hi + K], passages.words[p], hits))
        for (d, p), s in best.items():
            if s >= share:
                yield ids[d], passages.ids[p], s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = given.value
        for batch in batches:
            out, ids, texts, size = [], [], [], 0
            for i, text in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(words(text.as_py()))
                size += len(texts[-1])
                if size >= CHUNK:
                    out += check(ids, texts, passages)
                    ids, texts, size = [], [], 0
            out += check(ids, texts, passages)
            yield pa.record_batch(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["doc_id", "item_id", "share"],
            )

    return rows.mapInArrow(run, FOUND)
