"""Texts packed into containers of fixed capacity: bounded-space online best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.common import require

#: Splits a text into pieces before byte pairs are merged; a fixed value of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-pair encoding of a file of ranks; built once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters of a text that are encoded at once. Cuts fall after a line break or a blank's start,
#: where the pattern splits anyway, so the tokens are those of the whole text.
SPAN = 1 << 16


class OpenPacks:
    """At most `limit` open packs of one capacity; a bit set over free space finds the best fit.
    closed: packs that were filled or closed since it was last emptied."""

    def __init__(self, capacity: int, limit: int, name: str):
        self.capacity, self.limit, self.name = capacity, limit, name
        self.closed: list[str] = []
        self.free = 0  # bit f: a pack with f tokens of room is open
        self.at: dict[int, list[str]] = {}
        self.open = self.opened = 0

    def place(self, size: int) -> str:
        """The pack that a piece goes to: of the open ones with room the fullest, else a new one."""
        if size > self.capacity:
            raise ValueError("a piece exceeds the capacity")
        fit = self.free >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            pack = self._take(room)
        else:
            if self.open >= self.limit:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))  # the fullest closes
            room, pack = self.capacity, f"{self.name}-{self.opened}"
            self.opened += 1
        if room > size:
            self.at.setdefault(room - size, []).append(pack)
            self.free |= 1 << (room - size)
            self.open += 1
        else:
            self.closed.append(pack)
        return pack

    def _take(self, room: int) -> str:
        packs = self.at[room]
        pack = packs.pop()
        if not packs:
            del self.at[room]
            self.free &= ~(1 << room)
        self.open -= 1
        return pack


class Stream:
    """Pieces of one kind as they come. Rows are given out when their pack is closed; the pieces in
    packs that are still open at the end are packed once more, the largest first."""

    def __init__(self, kind: str, capacity: int, limit: int, part: int):
        self.kind, self.capacity, self.part = kind, capacity, part
        self.packs = OpenPacks(capacity, limit, f"{kind}-{part}")
        self.held: dict[str, list[tuple]] = {}  # rows of the open packs

    def add(self, doc: int, n: int) -> Iterator[tuple]:
        for no, (start, size) in enumerate(pieces(n, self.capacity) or [(0, 0)]):
            if not size:
                yield doc, self.kind, None, no, start, size, self.capacity
                continue
            pack = self.packs.place(size)
            self.held.setdefault(pack, []).append((doc, no, start, size))
            for closed in self.packs.closed:
                for d, i, s, z in self.held.pop(closed):
                    yield d, self.kind, closed, i, s, z, self.capacity
            self.packs.closed.clear()

    def end(self) -> Iterator[tuple]:
        rows = sorted((r for rows in self.held.values() for r in rows), key=lambda r: -r[3])
        last = OpenPacks(self.capacity, len(rows) + 1, f"{self.kind}-{self.part}-end")
        for doc, no, start, size in rows:
            yield doc, self.kind, last.place(size), no, start, size, self.capacity


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of the parts of an item of n tokens; whole unless n exceeds the capacity."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


PACKS = "doc_id bigint, pack_kind string, pack_id string, piece_no int, start_token bigint, n_tokens int, capacity_tokens int"


def pack(documents: DataFrame, sizes: DataFrame, vocabulary: str | None = None, open_packs: int = 256, max_kinds: int = 1000) -> DataFrame:
    """Each text placed, for each kind of pack: one row per piece with its pack, its first token
    and its length. A text is split only if it exceeds the capacity, at every `capacity` tokens.

    One pass, no shuffle: a task packs the texts it reads, into packs of its own. What is in open
    packs when its texts end is packed once more, so about one pack per task and kind is not full.

    Null texts are no items and have no rows; a text without tokens takes no room and has one
    row with pack_id null and no tokens. A doc_id that occurs twice is packed twice. Kinds with
    a capacity that is null or below 1 raise ValueError, as do more than max_kinds kinds (the
    kinds are the one table that is brought to the driver). Other columns are ignored.
    """
    require(documents, "doc_id", "text")
    require(sizes, "pack_kind", "capacity_tokens")
    kinds = [(r[0], r[1]) for r in sizes.select("pack_kind", "capacity_tokens").distinct().limit(max_kinds + 1).collect()]
    if len(kinds) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of pack")
    if any(c is None or c < 1 for _, c in kinds):
        raise ValueError("capacities must be at least 1")
    kinds.sort(key=lambda k: (k[0] or "", k[1]))
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoding(path).encode_ordinary
        streams = [Stream(k, c, open_packs, part) for k, c in kinds]
        types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 7
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "pack_kind", "pack_id", "piece_no", "start_token", "n_tokens", "capacity_tokens"])

        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(encode(text)) if len(text) <= SPAN else sum(len(encode(s)) for s in spans(text))
                for stream in streams:
                    out += stream.add(doc, n)
            yield batch_of(out)
        for stream in streams:
            yield batch_of(list(stream.end()))

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, PACKS)


def spans(text: str) -> Iterator[str]:
    """The text in stretches of about SPAN characters, each but the first beginning with the
    single blank before a letter, where the pattern always splits; a text without such a place
    stays whole."""
    start = 0
    while len(text) - start > SPAN:
        at = start + SPAN
        while at < len(text) - 1 and not (text[at] == " " and text[at + 1].isalpha() and not text[at - 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def pack_fill(packed: DataFrame) -> DataFrame:
    """Per kind: packs, tokens, least number of packs that could hold them, and share of room used."""
    packs = packed.where(F.col("pack_id").isNotNull()).groupBy("pack_kind", "pack_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity_tokens").alias("capacity_tokens"))
    out = packs.groupBy("pack_kind").agg(F.count("*").alias("packs"), F.sum("used").alias("tokens"), F.first("capacity_tokens").alias("capacity_tokens"), F.max("used").alias("fullest"))
    return out.withColumn("least_packs", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6))
