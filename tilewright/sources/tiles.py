"""A data source of tiles: spark.read.format("tiles").

It draws synthetic slides (a disc of tissue on white, the same for the same seed) and shows what a
reader of real slides has to do: a partition per slide and band of rows, and pixels only if they
are asked for (option pixels=false gives places alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACES = "sid string, x bigint, y bigint, h int, w int"


class Band(InputPartition):
    def __init__(self, sid: int, first: int, last: int):
        self.sid, self.first, self.last = sid, first, last


def drawn(sid: int, x: int, y: int, size: int, side: int, seed: int) -> np.ndarray:
    """The tile at (x, y) of a square slide of `side` pixels."""
    rng = np.random.default_rng([seed, sid, x, y])
    out = np.full((size, size, 3), 255, dtype=np.int16)
    rows, cols = np.mgrid[y : y + size, x : x + size]
    r = side * (0.2 + 0.05 * (sid % 5))
    inside = (rows - side / 2) ** 2 + (cols - side / 2) ** 2 < r * r
    out[inside] = np.array([150, 80, 120]) + rng.integers(-12, 13, (int(inside.sum()), 3))
    return out.astype(np.uint8)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def _pixels(self) -> bool:
        return self.options.get("pixels", "true").lower() == "true"

    def schema(self) -> str:
        return PLACES + (", pixels binary" if self._pixels() else "")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TileReader({k: int(self.options.get(k, v)) for k, v in (("slides", 2), ("side", 1024), ("size", 256), ("seed", 0), ("band", 4))}, self._pixels())


class TileReader(DataSourceReader):
    def __init__(self, given: dict[str, int], pixels: bool):
        if any(given[k] < 1 for k in ("side", "size", "band")) or given["slides"] < 0:
            raise ValueError("slides, side, size and band must be positive")
        self.given, self.with_pixels = given, pixels

    def partitions(self) -> list[Band]:
        g = self.given
        rows = -(-g["side"] // g["size"])
        return [Band(s, r, min(rows, r + g["band"])) for s in range(g["slides"]) for r in range(0, rows, g["band"])] or [Band(0, 0, 0)]

    def read(self, part: Band) -> Iterator[tuple]:
        g = self.given
        for row in range(part.first, part.last):
            for col in range(-(-g["side"] // g["size"])):
                x, y = col * g["size"], row * g["size"]
                place = (f"slide{part.sid}", x, y, g["size"], g["size"])
                yield (*place, drawn(part.sid, x, y, g["size"], g["side"], g["seed"]).tobytes()) if self.with_pixels else place


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileSource)
