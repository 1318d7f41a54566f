"""Pixels as arrays: histograms, difference hashes, colour-word embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 16

# A ten-colour palette that colour-word backends share, in the order in which equal distances are decided.
PALETTE = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (220, 30, 30), "green": (30, 160, 60), "blue": (30, 60, 220), "yellow": (240, 220, 40), "orange": (240, 140, 30), "purple": (130, 40, 160), "brown": (120, 80, 40), "gray": (128, 128, 128)}


# Colours that the mask detector knows, how far a pixel may be from one, and the least share of a frame.
MASK_PALETTE = {"red": (220, 30, 30), "green": (30, 180, 30), "blue": (30, 30, 220), "yellow": (230, 220, 40), "white": (240, 240, 240), "black": (15, 15, 15)}
MASK_DISTANCE, MASK_SHARE = 60, 0.002


def color_mask(r: Column, g: Column, b: Column, rgb: tuple[int, int, int]) -> Column:
    """UD5: places (from 0) of the pixels nearer than MASK_DISTANCE to a colour, in channels given as arrays."""
    far = lambda v, c: (v - F.lit(c)) * (v - F.lit(c))
    squares = F.zip_with(F.zip_with(F.transform(r, lambda v: far(v, rgb[0])), F.transform(g, lambda v: far(v, rgb[1])), lambda x, y: x + y), F.transform(b, lambda v: far(v, rgb[2])), lambda x, y: x + y)
    placed = F.transform(squares, lambda d, i: F.when(d < MASK_DISTANCE * MASK_DISTANCE, i))
    return F.filter(placed, lambda i: i.isNotNull())


def mask_extent(mask: Column, pixels: Column, width: Column, object_class: str) -> Column:
    """SC14: the detection that a mask makes: its extent in shares of the frame, surer the more of the frame it covers; null under MASK_SHARE."""
    share = F.size(mask) / F.nullif(pixels, F.lit(0))
    height = pixels / width
    xs, ys = F.transform(mask, lambda i: i % width), F.transform(mask, lambda i: F.floor(i / width))
    low = lambda v: F.array_min(v).cast("double")
    wide = lambda v: (F.array_max(v) - F.array_min(v) + 1).cast("double")
    box = F.struct(F.lit(object_class).alias("object_class"), F.least(F.lit(1.0), 0.5 + share).alias("confidence"), (low(xs) / width).alias("bbox_x"), (low(ys) / height).alias("bbox_y"), (wide(xs) / width).alias("bbox_w"), (wide(ys) / height).alias("bbox_h"))
    return F.when(share >= MASK_SHARE, box)


def channel_histogram(values: Column) -> Column:
    """Shares of one channel's values (0 to 255) in BINS equal bins, the last one closed; zeros without values."""
    bin_of = lambda v: F.least(F.floor(v.cast("double") * BINS / 255.0), F.lit(BINS - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.size(F.filter(values, lambda v: bin_of(v) == i)) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0)))


def rgb_histogram(r: Column, g: Column, b: Column) -> Column:
    """The three channels' histograms, one after another."""
    return F.concat(*map(channel_histogram, (r, g, b)))


def histogram_distance(x: Column, y: Column) -> Column:
    """Half of the L1 distance, as a mean over the three channels, in [0, 1]."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d) / 6.0


def dhash(grid: Column, size: int = 8) -> Column:
    """The difference hash of a grey image given as size rows of size + 1 values: a bit for each value brighter than its right neighbour, at most 64."""
    if not 0 < size <= 8:
        raise ValueError("a hash has at most 64 bits")

    def bit(i: Column) -> Column:
        at = F.floor(i / size).cast("int") * (size + 1) + i % size
        return (grid[at] > grid[at + 1]).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), F.lit(size * size - 1)), F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def key_vector(key: str, dim: int) -> np.ndarray:
    """A unit vector that a key determines: normal numbers seeded by the first eight bytes of its sha256."""
    v = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")).standard_normal(dim).astype(np.float32)
    return v / (np.linalg.norm(v) or 1.0)


def nearest_color(r: Column, g: Column, b: Column) -> Column:
    """The palette's colour nearest to a mean colour, the first of equal ones."""
    far = F.array(*[F.struct(sum(((c - v) * (c - v) for c, v in zip((r, g, b), rgb, strict=True)), F.lit(0)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, rgb) in enumerate(PALETTE.items())])
    return F.array_min(far)["name"]


def color_key(text: Column) -> Column:
    """The first palette word of a text, else a key of the whole phrase, which matches no colour."""
    low = F.lower(text)
    words = F.filter(F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " "), lambda w: w.isin(*PALETTE))
    return F.coalesce(F.get(words, 0), F.concat(F.lit("__text__:"), low))


def color_embedding(key: Column, dim: int = 64) -> Column:
    """The vector of a key. Palette words are looked up in a literal map; other phrases are hashed in Arrow batches."""

    @F.pandas_udf("array<float>")
    def hashed(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else key_vector(k, dim).tolist())

    known = F.create_map(*[x for name in PALETTE for x in (F.lit(name), F.array(*[F.lit(float(v)).cast("float") for v in key_vector(name, dim)]))])
    return F.coalesce(F.try_element_at(known, key), hashed(F.when(~key.isin(*PALETTE), key)))
