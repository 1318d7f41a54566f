"""Hits that a costly verifier confirms, within a budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.operators.presence import presence_counts, presence_times
from timelens.session import checkpoint

FLOOR, CHECKS, GROWTH = 0.10, 16, 2

#: Frames with ``accepted`` added: the verifier's answer, null where a frame can't be read.
Verifier = Callable[[DataFrame], DataFrame]


def verify_hits(hits: DataFrame, claim: str, verifier: Verifier, order: Sequence[str], floor: float = FLOOR, checks: int = CHECKS, accepts: int | None = None, growth: int = GROWTH) -> DataFrame:
    """Hits without those that the verifier refuses, with ``checked``. Each claim has a budget of its own.

    A claim's hits are gone through by score, then ``order``. Those under the floor pass unchecked; so do frames that can't be read, which don't
    count, and all that come after ``checks`` checks or, where it is given, after ``accepts`` accepted ones. The verifier sees 1, 2, 4... hits of
    each claim at a time (``growth``), all claims in one job; answers past the end of the budget don't count. It is never asked twice about a hit: its answers are
    checkpointed as they come.
    """
    rows = checkpoint(hits.withColumn("_row", F.monotonically_increasing_id()))
    above = rows.filter(F.col("score") >= floor)
    states = above.select(claim).distinct().withColumns({"_checked": F.lit(0).cast("bigint"), "_accepted": F.lit(0).cast("bigint"), "_unread": F.lit(0).cast("bigint")})
    first = Window.partitionBy(claim).orderBy(F.desc("score"), *order, "_row")
    seen, size = None, 1
    while True:
        left = above if seen is None else above.join(seen.select("_row"), "_row", "left_anti")
        open_ = states.filter(F.col("_checked") < checks) if accepts is None else states.filter((F.col("_checked") < checks) & (F.col("_accepted") < accepts))
        batch = left.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= size).join(open_, claim)
        batch = batch.filter(F.col("_n") <= F.lit(checks) - F.col("_checked") + F.col("_unread"))
        answers = checkpoint(verifier(batch).select("_row", claim, "_n", "_checked", "_accepted", "_unread", "accepted"))
        if answers.isEmpty():
            break
        before = Window.partitionBy(claim).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)  # over ``size`` rows at most
        sums = {"_c": F.col("_checked") + F.coalesce(F.count("accepted").over(before), F.lit(0)), "_a": F.col("_accepted") + F.coalesce(F.sum(F.col("accepted").cast("int")).over(before), F.lit(0))}
        counts = F.col("accepted").isNotNull() & (F.col("_c") < checks) & (F.lit(True) if accepts is None else F.col("_a") < accepts)
        judged = checkpoint(answers.withColumns(sums).withColumn("counts", counts).select("_row", claim, "accepted", "counts"))
        gained = judged.groupBy(claim).agg(F.count_if("counts").alias("_c"), F.count_if(F.col("counts") & F.col("accepted")).alias("_a"), F.count_if(F.col("accepted").isNull()).alias("_u"))
        more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        states = checkpoint(states.join(gained, claim, "left").select(claim, more("_checked", "_c"), more("_accepted", "_a"), more("_unread", "_u")))
        seen = judged if seen is None else checkpoint(seen.union(judged))
        size *= growth
    if seen is None:
        return rows.drop("_row").withColumn("checked", F.lit(False))
    told = rows.join(seen.select("_row", "accepted", "counts"), "_row", "left").withColumn("checked", F.coalesce("counts", F.lit(False)))
    return told.filter(~F.col("checked") | F.col("accepted")).drop("_row", "accepted", "counts")


def verified_presence(videos: DataFrame, segments: DataFrame, verifier: Callable[[DataFrame], DataFrame], samples: int = 10, window: tuple[float, float] | None = None) -> DataFrame:
    """at how many sampled times of each video the verifier surely sees it (``label`` yes, no or unsure); every video has a row."""
    answers = verifier(presence_times(videos, segments, samples, window))
    return videos.select("video_id").join(presence_counts(answers), "video_id", "left").withColumn("present", F.coalesce("present", F.lit(0)))
