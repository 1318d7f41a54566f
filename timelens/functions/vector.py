"""Vectors: norms, cosine, scaling, hashing embedders."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = norm(a)
    return bound(F.when(length == 0, 1.0).otherwise(length), lambda by: F.transform(a, lambda x: (x.cast("double") / by).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return dot(a, b) / F.when(lengths == 0, 1.0).otherwise(lengths)


def query_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1] between two bounds; 0.5 where they are one."""
    return F.when(high - low < 1e-9, 0.5).otherwise((value - low) / (high - low))


def min_max(df: DataFrame, value: str, lane: str, name: str) -> DataFrame:
    """df with a column scaled to [0, 1] within its lane. The lanes' bounds are added up before any shuffle and joined back, a row for each."""
    bounds = df.groupBy(F.col(lane).alias("_lane_of")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = df.join(bounds, F.col(lane).eqNullSafe(F.col("_lane_of")))
    return joined.withColumn(name, scaled(F.col(value), F.col("_low"), F.col("_high"))).drop("_lane_of", "_low", "_high")


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Signed hashing of words: the sum over words of a sign at a place, both from the word's sha256, normalised."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    # first eight bytes modulo dim (a power of two: their last bits), sign from the ninth byte
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    place = lambda w: F.conv(F.substring(F.sha2(w, 256), 9, 8), 16, 10).cast("bigint") % dim
    sign = lambda w: F.when(F.conv(F.substring(F.sha2(w, 256), 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    spots = F.transform(words, lambda w: F.struct(place(w).alias("at"), sign(w).alias("sign")))

    def summed(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(found, lambda s: s["at"] == i), F.lit(0.0), lambda acc, s: acc + s["sign"]).cast("float"))

    return bound(bound(spots, summed), normalised)


def hash_embeddings(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """hash_embedding for long texts, as rows (key, at, value) of the places that aren't zero: words are added up before the shuffle."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1)))
    digest = df.select(key, words.alias("w")).select(key, F.sha2("w", 256).alias("h"))
    at = (F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring("h", 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = digest.groupBy(key, at.alias("at")).agg(F.sum(sign).alias("sum")).filter("sum <> 0")
    length = sums.groupBy(F.col(key).alias("_of")).agg(F.sqrt(F.sum(F.col("sum") * F.col("sum"))).alias("_length"))
    return sums.join(length, F.col(key).eqNullSafe(F.col("_of"))).select(key, "at", (F.col("sum") / F.col("_length")).alias("value"))


def hash_embed(text: str, dim: int = 256) -> list[float]:
    """hash_embedding for a query, on the driver."""
    out = [0.0] * dim
    for w in re.findall(r"[a-z0-9']+", text.lower()):
        h = hashlib.sha256(w.encode()).digest()
        out[int.from_bytes(h[:8], "big") % dim] += 1.0 if h[8] % 2 == 0 else -1.0
    size = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / size for x in out]
