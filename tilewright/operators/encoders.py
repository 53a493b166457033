"""Encoders of patches: what there is, how one is plugged in, and the driver that runs it.

Models with trained weights can't be had here: they are listed with their dimension and pooling
and raise if asked for. Encoders without weights run: the mean colour, a histogram, and a seeded
random projection. An own encoder is any function from (n, h, w, 3) uint8 to (n, d).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.common import require

# Patch encoders, the length of their vectors, and how tokens become one.
PATCH = {
    "conch_v1": (512, "model"), "conch_v15": (768, "attention"), "uni_v1": (1024, "model"), "uni_v2": (1536, "model"), "ctranspath": (768, "model"),
    "phikon": (768, "cls"), "phikon_v2": (1024, "cls"), "resnet50": (1024, "average"), "keep": (768, "model"), "gigapath": (1536, "model"),
    "virchow": (2560, "cls+mean, tokens from 1"), "virchow2": (2560, "cls+mean, tokens from 5"), "hoptimus0": (1536, "token"), "hoptimus1": (1536, "token"), "h0-mini": (768, "cls"),
    "musk": (1024, "cls"), "openmidnight": (1536, "model"), "gpfm": (1024, "model"), "hibou_l": (1024, "model"), "kaiko-vitb8": (768, "model"),
    "kaiko-vitb16": (768, "model"), "kaiko-vits8": (384, "model"), "kaiko-vits16": (384, "model"), "kaiko-vitl14": (1024, "model"), "lunit-vits8": (384, "model"),
    "midnight12k": (1536, "cls"), "genbio-pathfm": (4608, "cls of three channels"), "gemma4-e4b": (768, "mean of 256 tokens"), "gemma4-26b": (1152, "mean of 256 tokens"),
}
# Slide encoders, the patch encoder that each needs, and the length of their vectors.
SLIDE = {
    "titan": ("conch_v15", 768), "prism": ("virchow", 1280), "chief": ("ctranspath", 768), "gigapath": ("gigapath", 768), "madeleine": ("conch_v1", 512),
    "threads": ("conch_v15", None), "care": ("conch_v15", 512), "feather": ("conch_v15", 512), "feather_uni_v2": ("uni_v2", 512), "abmil": (None, None),
}
# Mean and standard deviation that pixels in [0, 1] are normalised with.
NORMS = {
    "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "openai_clip": ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)),
    "hibou": ((0.7068, 0.5755, 0.722), (0.195, 0.2316, 0.1816)),
    "kaiko": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
    "genbio_pathfm": ((0.697, 0.575, 0.728), (0.188, 0.240, 0.187)),
    "none": (None, None),
}

Encode = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Encoder:
    name: str
    dim: int
    encode: Encode


def mean_rgb() -> Encoder:
    return Encoder("mean_rgb", 3, lambda x: x.reshape(len(x), -1, 3).mean(axis=1))


def histogram(bins: int = 8) -> Encoder:
    def encode(x: np.ndarray) -> np.ndarray:
        at = x.reshape(len(x), -1, 3).astype(int) * bins // 256
        return np.stack([np.bincount((a + np.arange(3) * bins).reshape(-1), minlength=3 * bins) / len(a) for a in at]) if len(x) else np.empty((0, 3 * bins))

    return Encoder("histogram", 3 * bins, encode)


def random_projection(dim: int = 64, side: int = 8, seed: int = 0, norm: str = "imagenet") -> Encoder:
    weights = np.random.default_rng(seed).normal(0, 1 / np.sqrt(side * side * 3), (side * side * 3, dim))

    def encode(x: np.ndarray) -> np.ndarray:
        h, w = x.shape[1] // side * side, x.shape[2] // side * side
        small = normalised(x[:, :h, :w], norm).reshape(len(x), side, h // side, side, w // side, 3).mean(axis=(2, 4))
        return small.reshape(len(x), -1) @ weights

    return Encoder("random_projection", dim, encode)


def normalised(x: np.ndarray, norm: str = "imagenet") -> np.ndarray:
    """Pixels in [0, 1], less the mean, by the standard deviation; unknown names are an error."""
    if norm not in NORMS:
        raise ValueError(f"unknown normalisation: {norm}")
    mean, std = NORMS[norm]
    x = x / 255.0
    return x if mean is None else (x - np.array(mean)) / np.array(std)


def centre_crop(x: np.ndarray, size: int) -> np.ndarray:
    h, w = x.shape[1:3]
    if size > min(h, w):
        raise ValueError("the crop is larger than the tile")
    top, left = (h - size) // 2, (w - size) // 2
    return x[:, top : top + size, left : left + size]


def encoder(name: str) -> Encoder:
    """An encoder that can run here, by name; ValueError for one that needs weights or there isn't."""
    built = {"mean_rgb": mean_rgb, "histogram": histogram, "random_projection": random_projection}
    if name in built:
        return built[name]()
    if name in PATCH or name in SLIDE:
        raise ValueError(f"{name} needs trained weights, which are not available; plug in an Encoder of your own")
    raise ValueError(f"unknown encoder: {name}")


def slide_encoder_input(name: str) -> str:
    """The patch encoder that a slide encoder needs; mean-X needs X."""
    if name.startswith("mean-"):
        if name[5:] not in PATCH:
            raise ValueError(f"unknown encoder: {name}")
        return name[5:]
    if name not in SLIDE or SLIDE[name][0] is None:
        raise ValueError(f"unknown encoder, or one without a fixed input: {name}")
    return SLIDE[name][0]


def registry(spark: SparkSession) -> DataFrame:
    """(name, kind, input, dim, pooling, available): all encoders."""
    rows = [(n, "patch", None, d, p, False) for n, (d, p) in PATCH.items()]
    rows += [(n, "slide", i, d, None, n == "abmil") for n, (i, d) in SLIDE.items()] + [(f"mean-{n}", "slide", n, d, "mean", True) for n, (d, _) in PATCH.items()]
    rows += [(e.name, "patch", None, e.dim, "none", True) for e in (mean_rgb(), histogram(), random_projection())]
    return spark.createDataFrame(rows, "name string, kind string, input string, dim int, pooling string, available boolean")


def checked_size(size: Column, patch: int) -> Column:
    """A size in pixels, or an error unless it is a positive multiple of the model's patch."""
    return F.when((size > 0) & (size % patch == 0), size).otherwise(F.raise_error(F.concat(F.lit(f"not a positive multiple of {patch}: "), F.coalesce(size.cast("string"), F.lit("null")))).cast("int"))


def cls_and_mean(tokens: Column, skip: int, cls_only: bool = False) -> Column:
    """The first token, and behind it the mean of those after the first `skip`; tokens are
    array<array<double>>."""
    first = tokens[0]
    if cls_only:
        return first
    rest = F.slice(tokens, F.lit(skip + 1), F.greatest(F.lit(0), F.size(tokens) - skip))
    zero = F.transform(first, lambda _: F.lit(0.0))
    total = F.aggregate(rest, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return F.concat(first, F.transform(total, lambda v: v / F.size(rest)))


def channels_joined(r: Column, g: Column, b: Column) -> Column:
    return F.flatten(F.array(r, g, b))


def encoded(tiles: DataFrame, model: Encoder, keys: list[str], batch: int = 64) -> DataFrame:
    """tiles (keys..., h, w, pixels) -> (keys..., features): patches encoded `batch` at a time; the
    encoder is built once per worker. Tiles without pixels, or of another size than they say,
    have null features. An empty table gives no rows and never calls the encoder."""
    require(tiles, *keys, "h", "w", "pixels")
    rows = tiles.select(*keys, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "pixels")
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            sizes: dict[tuple[int, int], list[int]] = {}
            pixels = b.column(len(keys) + 2)
            for i, (h, w, p) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), pixels)):
                if p.is_valid and h and w and len(p.as_buffer()) == h * w * 3:
                    sizes.setdefault((h, w), []).append(i)
            for (h, w), at in sizes.items():
                for k in range(0, len(at), batch):
                    part = at[k : k + batch]
                    x = np.stack([np.frombuffer(pixels[i].as_buffer(), dtype=np.uint8).reshape(h, w, 3) for i in part])
                    for i, v in zip(part, np.asarray(model.encode(x), dtype=np.float64)):
                        out[i] = v
            yield pa.record_batch([*b.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "features"])

    return rows.mapInArrow(run, f"{fields}, features array<double>")
