"""Vector search: exact cosine top-k, over the shards of an embedder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.functions.vector import dot, normalised, query_vector


def add_vectors(df: DataFrame, dim: int) -> DataFrame:
    """SK17: rows ready to be written: vectors of the right length, normalised."""
    return df.filter(F.size("embedding") == dim).withColumn("embedding", normalised(F.col("embedding")))


def usable(vectors: DataFrame, space: str, embedder: str, dim: int) -> DataFrame:
    """the shards of a space that an embedder wrote; as partition columns these prune files."""
    return vectors.filter((F.col("space") == space) & (F.col("embedder") == embedder) & (F.col("dim") == dim))


def index_state(vectors: DataFrame, space: str, embedder: str, dim: int) -> DataFrame:
    """F32: rows in a space, and those that an embedder can use."""
    mine = (F.col("embedder") == embedder) & (F.col("dim") == dim)
    return vectors.filter(F.col("space") == space).agg(F.count("*").alias("total"), F.count_if(mine).alias("usable"))


def cosine_top_k(vectors: DataFrame, query: Sequence[float], k: int, *ids: str) -> DataFrame:
    """The k rows nearest to a query by cosine; vectors are unit length, ties go by ids."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    score = dot(F.col("embedding"), query_vector([x / length for x in query]))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), *ids).limit(k)


def search_text(vectors: DataFrame, query: Sequence[float], k: int, modalities: Sequence[str] | None, *ids: str, exact: bool = True) -> DataFrame:
    """Top k of some modalities. Not exact: of the top 5 k of all, so there may be fewer than k."""
    if modalities is None:
        return cosine_top_k(vectors, query, k, *ids)
    mine = F.col("modality").isin(*modalities)
    if exact:
        return cosine_top_k(vectors.filter(mine), query, k, *ids)
    return cosine_top_k(vectors, query, 5 * k, *ids).filter(mine).orderBy(F.desc("score"), *ids).limit(k)


def with_catalog(hits: DataFrame, videos: DataFrame) -> DataFrame:
    """Hits with their video's URI, the hit's own where the video is gone."""
    live = videos.select("video_id", F.col("source_uri").alias("_live"))
    return hits.join(live, "video_id", "left").withColumn("source_uri", F.coalesce("_live", "source_uri")).drop("_live")
