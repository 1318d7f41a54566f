"""Sharding by a k-d tree over document metadata, balanced by bytes.

Each node of the tree covers a number of shards. It is split across its widest dimension at the distributed weighted median, so
that each side's bytes are in proportion to its shards, until every leaf is one shard. Dimensions come from the text alone (its
length and its bytes for each character), so equal texts stand at one point and stay together while their bytes
are at most TOLERANCE of a shard; heavier groups are dealt over shards row by row.

A point's place along a dimension is an integer of 62 bits: the dimension's value, then a checksum of the text, then a hash of
doc_id and, for rows that are alike, their number. The median is found by narrowing brackets with histograms: jobs over a slim table, adding up before
any shuffle. Only histograms of at most BINS bins for each node reach the driver, whatever the number of rows.

Defined results: a null text has size 8 and the checksum of an empty one; repeated rows, with null ids too, are a group of equal texts
like any other, split row by row where it is heavy; texts of any length are one row; an empty table gives no rows; with fewer distinct places than shards some shards stay empty; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, table, text_or_empty

SHARDS, OVERHEAD = 24, 8
#: Groups of equal texts above this share of a shard's bytes may be split.
TOLERANCE = 0.005
BINS = 1024
VALUE_BITS, TEXT_BITS, ROW_BITS = 22, 24, 16
#: Rows that are alike and are put out together.
COPIES = 65_536
#: Rows numbered in one sort.
SLOT_ROWS = 4096

DIMENSIONS = ("d_length", "d_density")


def metadata(docs: DataFrame) -> DataFrame:
    """A slim row for each document: id, size, checksum, and its dimensions scaled to VALUE_BITS."""
    text = text_or_empty()
    top = (1 << VALUE_BITS) - 1
    length = F.log2(1.0 + F.char_length(text)) / 40.0
    density = F.when(F.char_length(text) > 0, (F.octet_length(text) / F.char_length(text) - 1) / 3.0).otherwise(0.0)
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.least(F.lit(top), (x * top).cast("long")).cast("long").alias(n) for n, x in zip(DIMENSIONS, (length, density), strict=True)],
    )
    return _numbered(slim)


def _numbered(slim: DataFrame) -> DataFrame:
    """The rows with row_hash, which tells rows apart that are alike in all of the slim table.

    They are counted, which adds up before the shuffle, and put out again with a number each: blocks of COPIES first, which are dealt out, so that
    copies of one row, however many, are never one task's.
    """
    alike = slim.groupBy(*slim.columns).agg(F.count("*").alias("copies"))
    blocks = alike.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    dealt = blocks.filter("copies > 1").repartition("doc_id", "text_crc32", "from")
    again = dealt.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("copies")) - 1)))
    every = blocks.filter("copies = 1").withColumn("copy", F.col("from")).unionByName(again)
    key = F.col("doc_id").cast("string")
    return every.select(*slim.columns, F.when(F.col("copy") == 0, F.xxhash64(key)).otherwise(F.xxhash64(key, "copy")).alias("row_hash"))


def place(dimension: str) -> Column:
    """The integer by which rows are ordered along a dimension."""
    text = F.col("text_crc32") % F.lit(1 << TEXT_BITS)
    row = F.pmod("row_hash", F.lit(1 << ROW_BITS))
    return F.col(dimension) * F.lit(1 << (TEXT_BITS + ROW_BITS)) + text * F.lit(1 << ROW_BITS) + row


@dataclass
class Node:
    shards: int
    first: int
    dimension: str | None = None
    cut: int | None = None
    below: Node | None = None
    above: Node | None = None
    bracket: list = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [self] if self.below is None else [*self.below.leaves(), *self.above.leaves()]

    def shard(self) -> Column:
        """First shard of the leaf that a row falls in: rows under the cut go below."""
        if self.below is None:
            return F.lit(self.first)
        return F.when(place(self.dimension) < F.lit(self.cut), self.below.shard()).otherwise(self.above.shard())


def _find_cuts(slim: DataFrame, root: Node, open_: list[Node], tolerance: float) -> None:
    """Set dimension and cut of the nodes: weighted medians by narrowing histograms."""
    at = root.shard()
    sides = {n.first: n for n in open_}
    span = [e for d in DIMENSIONS for e in (F.stddev_pop(F.col(d)).alias(f"s_{d}"), F.min(place(d)).alias(f"lo_{d}"), F.max(place(d)).alias(f"hi_{d}"))]
    rows = slim.groupBy(at.alias("node")).agg(F.sum("size").alias("bytes"), *span).collect()
    goal: dict[int, float] = {}
    for r in rows:
        n = sides.get(r["node"])
        if n is None:
            continue
        n.dimension = max(DIMENSIONS, key=lambda d: (r[f"s_{d}"], d))
        n.bracket = [r[f"lo_{n.dimension}"], r[f"hi_{n.dimension}"] + 1, 0]  # from, to, bytes below
        goal[n.first] = r["bytes"] * (n.shards // 2) / n.shards
    for n in open_:
        if n.first not in goal:  # nothing falls here
            n.dimension, n.cut = DIMENSIONS[0], 0
    group = 1 << ROW_BITS
    while todo := [n for n in open_ if n.cut is None]:
        where, low, width, widths = F.lit(False), F.lit(0), F.lit(1), {}
        for n in todo:
            lo, hi, _ = n.bracket
            w = max(1, -(-(hi - lo) // BINS))
            if w < group < hi - lo:
                w = group  # bins of whole groups until one group is left
            if w > group:
                w = -(-w // group) * group
                n.bracket[0] = lo = lo // group * group
            widths[n.first] = w
            key = (at == n.first) & place(n.dimension).between(lo, hi - 1)
            where = where | key
            low = F.when(at == n.first, F.lit(lo)).otherwise(low)
            width = F.when(at == n.first, F.lit(w)).otherwise(width)
        spot = F.lit(0)
        for n in todo:
            spot = F.when(at == n.first, place(n.dimension)).otherwise(spot)
        counted = slim.filter(where).groupBy(at.alias("node"), F.floor((spot - low) / width).cast("int").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        for n in todo:
            lo, hi, below = n.bracket
            w = widths[n.first]
            bins = sorted((r["bin"], r["bytes"]) for r in counted if r["node"] == n.first)
            for b, size in bins:
                if below + size >= goal[n.first] or (b, size) == bins[-1]:
                    left = lo + b * w
                    if w == 1 or size <= tolerance:
                        # to the nearer end of the bin; bins are whole groups until a group alone is too heavy
                        n.cut = left if goal[n.first] - below < below + size - goal[n.first] else left + w
                    else:
                        n.bracket = [left, min(hi, left + w), below]
                    break
                below += size


def build_tree(slim: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> Node:
    """The k-d tree over a slim table."""
    root = Node(shards, 0)
    total = slim.agg(F.sum("size")).first()[0] or 0
    while open_ := [n for n in root.leaves() if n.shards > 1]:
        _find_cuts(slim, root, open_, tolerance * total / shards)
        for n in open_:
            half = n.shards // 2
            n.below, n.above = Node(half, n.first), Node(n.shards - half, n.first + half)
    return root


def kd_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text) placed: doc_id, size, text_crc32, shard, slot."""
    slim = checkpoint(metadata(docs))
    placed = slim.withColumn("shard", build_tree(slim, shards, tolerance).shard().cast("int"))
    # slots: numbered within parts of a shard, each after the parts before it
    parts = max(1, slim.count() // (shards * SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.col("row_hash"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1)
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
