"""Evidence: gathering, fusion, the relevance gate, what is rendered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.constants import EVIDENCE_CAP, KEYFRAME_CAP, RENDER_CAP, RERANK_WEIGHT
from timelens.functions.text import minutes, overlap_score, query_tokens
from timelens.functions.vector import scaled

COLUMNS = ["modality", "video_id", "time_start", "time_end", "content", "score"]

#: Order in which modalities stand for a question.
PRIORITY = ("deep_scan_count", "object_count", "co_occurrence", "action", "transcript", "on_screen_text", "caption", "object", "visual")


def _item(df: DataFrame, modality: str, start: str, end: str, content: Column, score: Column) -> DataFrame:
    return df.select(F.lit(modality).alias("modality"), F.col("video_id").cast("string").alias("video_id"), F.col(start).cast("double").alias("time_start"), F.col(end).cast("double").alias("time_end"), content.alias("content"), score.cast("double").alias("score"))


def from_visual(hits: DataFrame) -> DataFrame:
    """Search hits as evidence; so the others below."""
    return _item(hits, "visual", "timestamp", "timestamp", F.format_string("visual match at %s", minutes(F.col("timestamp"))), F.col("score"))


def from_captions(hits: DataFrame) -> DataFrame:
    return _item(hits, "caption", "start_time", "end_time", F.col("caption"), F.col("score"))


def from_transcripts(hits: DataFrame) -> DataFrame:
    return _item(hits, "transcript", "start_time", "end_time", F.col("text"), F.col("score"))


def from_actions(hits: DataFrame) -> DataFrame:
    return _item(hits, "action", "start_time", "end_time", F.format_string("action %s (confidence %.2f, best of the vocabulary)", "action_class", "confidence"), F.col("score"))


def from_ocr(hits: DataFrame) -> DataFrame:
    return _item(hits, "on_screen_text", "time_start", "time_end", F.format_string("text %s, seen %d times", "text", "sightings"), F.col("score"))


def from_co_occurrence(spans: DataFrame) -> DataFrame:
    """A span's score is half, and a tenth more for each frame, one at most."""
    return _item(spans, "co_occurrence", "time_start", "time_end", F.format_string("together in %d frames", "frames"), F.least(F.lit(1.0), 0.5 + 0.1 * F.col("frames")))


def from_distinct_counts(counts: DataFrame) -> DataFrame:
    return _item(counts, "object_count", "first_seen", "last_seen", F.format_string("%d %s tracks; one that leaves and returns counts again", "distinct", "object_class"), F.lit(1.0))


def from_summaries(rows: DataFrame) -> DataFrame:
    return _item(rows, "object", "first_seen", "last_seen", F.format_string("%s in %d frames", "object_class", "frames"), F.col("confidence"))


def from_text(hits: DataFrame) -> DataFrame:
    """Hits of the text index, each of its own modality, with the cosine as score."""
    return hits.select("modality", F.col("video_id").cast("string").alias("video_id"), F.col("time_start").cast("double").alias("time_start"), F.col("time_end").cast("double").alias("time_end"), F.col("text").alias("content"), F.col("score").cast("double").alias("score"))


def top_spans(spans: DataFrame, most: int = 3) -> DataFrame:
    """The spans with most frames."""
    return spans.orderBy(F.desc("frames"), "time_start", "video_id").limit(most)


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """All candidates in one pool; ``position`` keeps the order of the parts."""
    pool = None
    for i, part in enumerate(parts):
        part = part.withColumn("position", F.lit(i))
        pool = part if pool is None else pool.unionByName(part, allowMissingColumns=True)
    if pool is None:
        raise ValueError("nothing to gather")
    return pool


def word_overlap_rerank(items: DataFrame, query: str) -> DataFrame:
    """items that have language get the share of the query's words as rerank_score; visual ones get none."""
    return items.withColumn("rerank_score", F.when(F.col("modality") != "visual", overlap_score(F.col("content"), query_tokens(query))))


def fuse(items: DataFrame, weight: float = RERANK_WEIGHT) -> DataFrame:
    """F8: fused_score from rerank and native scores, each scaled where they compare.

    Rerank scores are scaled over all items that have one; native ones within visual items and within the others. An item without a
    rerank score counts 0 for it.
    """
    visual = F.col("modality") == "visual"
    spans = {"_visual": F.when(visual, F.col("score")), "_other": F.when(~visual, F.col("score")), "_rerank": F.col("rerank_score")}
    # one row of bounds, added up before the shuffle, that every item needs
    bounds = items.agg(*[f(x).alias(f"{n}{end}") for n, x in spans.items() for end, f in (("_low", F.min), ("_high", F.max))])
    joined = items.join(F.broadcast(bounds))
    native = F.when(visual, scaled(F.col("score"), F.col("_visual_low"), F.col("_visual_high"))).otherwise(scaled(F.col("score"), F.col("_other_low"), F.col("_other_high")))
    rerank = F.when(F.col("rerank_score").isNull(), 0.0).otherwise(scaled(F.col("rerank_score"), F.col("_rerank_low"), F.col("_rerank_high")))
    return joined.withColumns({"native_norm": native, "fused_score": weight * rerank + (1 - weight) * native}).drop(*bounds.columns)


def ranked(items: DataFrame, cap: int | None = EVIDENCE_CAP) -> DataFrame:
    """T5: by fused score, then native score, then time."""
    ordered = items.orderBy(F.desc("fused_score"), F.desc("score"), "time_start", "video_id", "modality", "content")
    return ordered if cap is None else ordered.limit(cap)


def gated(items: DataFrame, min_rerank: Column | float | None = None, min_cosine: Column | float | None = None) -> DataFrame:
    """FP15: visual items by raw cosine, others by raw rerank score; one without a rerank score stays."""
    floor = lambda x: x if isinstance(x, Column) else F.lit(float("-inf") if x is None else float(x))
    visual = F.col("score") >= floor(min_cosine)
    language = F.col("rerank_score").isNull() | (F.col("rerank_score") >= floor(min_rerank))
    return items.filter(F.when(F.col("modality") == "visual", visual).otherwise(language))


def gated_by_domain(items: DataFrame, domains: DataFrame, floors: dict[str, tuple[float, float]], base: tuple[float, float]) -> DataFrame:
    """FP16: each item by the floors (rerank, cosine) of its video's domain (video_id, domain), else the base."""
    pick = lambda i: F.coalesce(*[F.when(F.col("domain") == d, F.lit(float(f[i]))) for d, f in sorted(floors.items())], F.lit(float(base[i])))
    return gated(items.join(domains.select("video_id", "domain"), "video_id", "left"), pick(0), pick(1)).drop("domain")


def dominant_video(items: DataFrame) -> DataFrame:
    """The video with most items, the first seen of equals, from (video_id, position)."""
    counts = items.filter("video_id IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return counts.orderBy(F.desc("n"), "first", "video_id").limit(1).select("video_id", "n")


def modality_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("modality").agg(F.count("*").alias("n"))


def strongest(items: DataFrame) -> DataFrame:
    """Each modality's best item, in the order of PRIORITY."""
    rank = F.coalesce(*[F.when(F.col("modality") == m, F.lit(i)) for i, m in enumerate(PRIORITY)])
    best = F.row_number().over(Window.partitionBy("modality").orderBy(F.desc("score"), "time_start", "video_id", "content"))
    return items.withColumns({"priority": rank, "_best": best}).filter("_best = 1 AND priority IS NOT NULL").drop("_best").orderBy("priority")


def rendered(items: DataFrame, order: Sequence[str | Column], cap: int = RENDER_CAP) -> DataFrame:
    """Items taken in turn from each modality, then by time. ``position`` orders items within and between modalities."""
    firsts = items.groupBy(F.col("modality").alias("_of")).agg(F.min("position").alias("_first"))
    # a modality can't give more rows than are shown, so each task keeps that many of it
    few = items.withColumn("_rank", F.row_number().over(Window.partitionBy("modality").orderBy(*order))).filter(F.col("_rank") <= cap)
    placed = few.join(firsts, F.col("modality") == F.col("_of"))
    return placed.orderBy("_rank", "_first", "modality").limit(cap).orderBy("time_start", "modality", "_rank").drop("_rank", "_first", "_of")


def keyframes(items: DataFrame, cap: int = KEYFRAME_CAP) -> DataFrame:
    """Moments to show: by modality, then score, one for each second of a video."""
    rank = F.coalesce(*[F.when(F.col("modality") == m, F.lit(i)) for i, m in enumerate(PRIORITY)], F.lit(len(PRIORITY)))
    moments = items.withColumns({"middle": (F.col("time_start") + F.col("time_end")) / 2, "priority": rank}).withColumn("second", F.floor("middle"))
    order = (F.col("priority"), F.desc("score"), F.col("middle"))
    once = moments.withColumn("_row", F.row_number().over(Window.partitionBy("video_id", "second").orderBy(*order))).filter("_row = 1")
    return once.orderBy(*order, "video_id").limit(cap).select("video_id", "middle", "modality", "score")


def verified_within(items: DataFrame, checks: int, accepts: int) -> DataFrame:
    """Items with ``accepted`` (a verifier's answer): the first ``checks`` by score count until ``accepts`` of them hold; refused ones go, the rest pass."""
    by = (F.desc("score"), "time_start", "video_id", "modality", "content")
    # the window runs over the items that can be checked, ``checks`` at most; each is known by all its columns and its number among equals
    alike = Window.partitionBy(*items.columns).orderBy(F.lit(0))
    numbered = items.withColumn("_copy", F.row_number().over(alike))
    few = numbered.orderBy(*by, "_copy").limit(checks)
    held = F.coalesce(F.sum(F.col("accepted").cast("int")).over(Window.orderBy(*by, "_copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    looked = few.withColumn("_held", held).filter(F.col("_held") < accepts)
    named = looked.select(*[F.col(c).alias(f"_of_{c}") for c in (*items.columns, "_copy")])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*items.columns, "_copy")])
    marked = numbered.join(named, same, "left").withColumn("checked", F.col("_of__copy").isNotNull()).select(*items.columns, "checked")
    return marked.filter(~F.col("checked") | F.col("accepted"))


def first_texts(items: DataFrame, norm: Column) -> DataFrame:
    """The earliest item of each normalised text, by video and modality."""
    seq = Window.partitionBy("video_id", "modality", "_norm").orderBy("timestamp", "seq")
    return items.withColumn("_norm", norm).filter("_norm <> ''").withColumn("_row", F.row_number().over(seq)).filter("_row = 1").drop("_row", "_norm")
