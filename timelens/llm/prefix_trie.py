"""Trie of conversation prefixes with sums over subtrees, by heavy-path decomposition.

Conversations are rows (conv_id, turn, role, text), ordered by turn. A node stands for one sequence of first turns; its members are the
conversations that start with it. Prefixes are named by running hashes of their turns, so all nodes come from one grouping. After that a node
is its depth and its smallest member, as nodes of one depth have no member in common.

Each node's child with the most members is its heavy child; any other child has at most half of its members, so a way from the
root takes at most log2 of the number of conversations light steps. Nodes that heavy steps join form a path. Going along each conversation gives every node
its path (its last light node) and level (light steps above it). Then, from the deepest level up, one round for each: values are
suffix-summed along the level's paths, and the sum at each path's top is attached to the parent of its top.

No group is held whole: conversations are sorted over ranges, so even one with most of the rows is split; running values are taken
in blocks of BLOCK rows and carried from block to block by a row for each; members of nodes with many of them are joined
by sending those nodes, of which there are at most HOT, to all tasks. Only the digest of the members that end in a node has an order and streams
through one task.

Defined results: a null turn comes first; a null role or text is empty; rows alike in conv_id and turn are ordered by role and the text's
sha256; repeated rows are turns of their own; rows without a conv_id belong to no conversation; a conversation without turns
is a member of the root alone; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, free_shuffles, table

#: Rows of a sequence that one window runs over.
BLOCK = 4096
#: Nodes with many members that are sent to all tasks.
HOT = 10_000
#: sha256 of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, 3...), role, digest and bytes of the text. Ranges of the sorted rows are numbered by themselves, then set one after the other."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = checkpoint(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")  # a row for each range
    starts = sizes.withColumn("before", before).filter("before > 0").select("conv_id", "range", "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    placed = rows.withColumn("inside", inside).join(starts, ["conv_id", "range"], "left")
    return checkpoint(placed.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "role", "digest", "bytes"))


def rebuilt_turns(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, size) and their turns (conv, depth, role, digest, bytes) after each has got the first turns of its base.

    ``base`` and ``taken`` (at most 8 turns) are of column conv.
    """
    own = turns.groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("own"))
    heads = checkpoint(turns.filter("pos <= 8").withColumnRenamed("conv_id", "base"))
    known = own.withColumn("base", base).withColumn("taken", taken)
    given = heads.groupBy("base").agg(F.count("*").alias("given"))
    convs = checkpoint(known.join(given, "base", "left").withColumn("given", F.least("taken", F.coalesce("given", F.lit(0)))))
    first = convs.filter("given > 0").join(heads, "base").filter("pos <= given").select("conv", F.col("pos").alias("depth"), "role", "digest", "bytes")
    rest = turns.withColumnRenamed("conv_id", "conv").withColumn("taken", taken).filter("pos > taken")
    short = convs.filter("given < taken AND own > taken").select("conv", (F.col("taken") - F.col("given")).alias("lacking"))
    depth = F.col("pos") - F.coalesce("lacking", F.lit(0))
    after = rest.join(short, "conv", "left").select("conv", depth.cast("long").alias("depth"), "role", "digest", "bytes")
    size = F.col("given") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))
    return convs.select("conv", size.cast("long").alias("size")), first.union(after)


def running(rows: DataFrame, key: list[str], at: str, values: dict[str, tuple[Callable, str]], down: bool = False) -> DataFrame:
    """rows with running values along ``at`` (back from the end with ``down``), for each key; ``values`` names an aggregate and its column.

    Windows run over blocks of BLOCK rows; what earlier blocks hold is carried by a row for each, for keys of more than one block.
    """
    rows = rows.withColumn("block", F.floor(F.col(at) / F.lit(BLOCK)))
    along = lambda column: F.desc(column) if down else F.asc(column)
    spans = [agg(column).alias(name) for name, (agg, column) in values.items()]
    parts = rows.groupBy(*key, "block").agg(*spans)
    before = Window.partitionBy(*key).orderBy(along("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*key, "block", *[agg(name).over(before).alias(f"carried_{name}") for name, (agg, _) in values.items()])
    several = rows.filter("block > 0").select(*key).distinct()
    carried = carried.join(several, key, "left_semi")
    inside = Window.partitionBy(*key, "block").orderBy(along(at)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[agg(column).over(inside).alias(name) for name, (agg, column) in values.items()]).join(carried, [*key, "block"], "left")
    joined = {name: _together(agg, F.col(name), F.col(f"carried_{name}")) for name, (agg, _) in values.items()}
    return out.select(*[c for c in rows.columns if c != "block"], *[c.alias(name) for name, c in joined.items()])


def _together(agg: Callable, here: Column, carried: Column) -> Column:
    if agg is F.max:
        return F.greatest(here, carried)
    if agg is F.bit_xor:
        return here.bitwiseXOR(F.coalesce(carried, F.lit(0)))
    return here + F.coalesce(carried, F.lit(0))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, depth, x and y (what names the prefix), px and py (its parent's), bytes: a row for each member of each node, the root among them."""
    hashed = turns.withColumn("hx", F.xxhash64("depth", "role", "digest")).withColumn("hy", F.xxhash64("digest", "depth", "role"))
    run = running(hashed, ["conv"], "depth", {"x": (F.bit_xor, "hx"), "y": (F.bit_xor, "hy")})
    below = run.select("conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "bytes")
    zero = F.lit(0).cast("long")
    return convs.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("bytes")).union(below)


def _with_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members (conv, depth, x, y, ...) with node and light of their nodes. Nodes with more than a ten-thousandth of all members are at most HOT, and go to all tasks."""
    keys = ["depth", "x", "y"]
    told = nodes.select(*keys, "node", "light", "n_convs")
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    many = max(total // HOT, BLOCK)
    hot = checkpoint(told.filter(F.col("n_convs") > many).drop("n_convs"))
    few = told.filter(F.col("n_convs") <= many).drop("n_convs")
    if hot.isEmpty():
        return members.join(few, keys)
    return members.join(F.broadcast(hot), keys).unionByName(members.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(few, keys))


def placed_nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, node: their smallest member, parent, n_convs, n_children, bytes, level, top: the depth and node of their path's first) and members (conv, depth, node)."""
    first = members.groupBy("depth", "x", "y").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("bytes").alias("bytes"))
    nodes = checkpoint(first)
    up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"), "n_convs", "node")
    largest = F.max_by(F.col("node"), F.struct("n_convs", -F.col("node")))
    families = checkpoint(up.groupBy("depth", "x", "y").agg(F.count("*").alias("n_children"), largest.alias("heavy")))
    heavy = families.select((F.col("depth") + 1).alias("depth"), F.col("heavy").alias("node"), F.lit(False).alias("is_light"))
    nodes = nodes.join(families.drop("heavy"), ["depth", "x", "y"], "left").join(heavy, ["depth", "node"], "left")
    nodes = checkpoint(nodes.select("depth", "x", "y", "node", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "bytes", F.coalesce("is_light", F.lit(True)).alias("light")))

    told = checkpoint(_with_nodes(members.select("conv", "depth", "x", "y"), nodes).select("conv", "depth", "node", "light"))
    step = F.col("light").cast("long")
    marked = told.withColumn("step", step).withColumn("here", F.when(F.col("light"), F.struct("depth", "node")))
    own = running(marked, ["conv"], "depth", {"top": (F.max, "here"), "steps": (F.sum, "step")}).filter(F.col("conv") == F.col("node"))
    above = told.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    one = own.join(above, ["conv", "depth"], "left").select("depth", "node", "parent", "top", (F.col("steps") - 1).alias("level"))
    return checkpoint(one.join(nodes.select("depth", "node", "n_convs", "n_children", "bytes"), ["depth", "node"])), told


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """depth, node and, by name, the sum of each value over the node's subtree: level after level of light steps, from the deepest."""
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.select("depth", "node", *[v.alias(n) for n, v in values.items()])
    valued = checkpoint(nodes.select("depth", "node", "parent", "top", "level", *[v.cast("long").alias(f"own_{n}") for n, v in values.items()]))
    done, attached = None, None
    for level in range(deepest, -1, -1):
        rows = valued.filter(F.col("level") == level)
        if attached is not None:
            rows = rows.join(attached, ["depth", "node"], "left")
            for n in values:
                rows = rows.withColumn(f"own_{n}", F.col(f"own_{n}") + F.coalesce(f"more_{n}", F.lit(0))).drop(f"more_{n}")
        summed = checkpoint(running(rows, ["top"], "depth", {n: (F.sum, f"own_{n}") for n in values}, down=True))
        tops = summed.filter((F.col("top.depth") == F.col("depth")) & F.col("parent").isNotNull())
        attached = checkpoint(tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(*[F.sum(n).alias(f"more_{n}") for n in values]))
        result = summed.select("depth", "node", *values)
        done = result if done is None else done.union(result)
    return done


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, node and the sha256 of the conversations (conv) that end there, ascending, joined by commas. They stream, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))

        def digests() -> Iterator[tuple]:
            for (depth, node), group in itertools.groupby(rows, key=lambda r: r[:2]):
                digest = hashlib.sha256(str(next(group)[2]).encode())
                for _, _, conv in group:
                    digest.update(b",%d" % conv)
                yield depth, node, digest.hexdigest()

        out = digests()
        while part := list(itertools.islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "node", "ends_sha256"])

    return ends.select("depth", "node", "conv").repartition(F.xxhash64("depth", "node")).sortWithinPartitions("depth", "node", "conv").mapInArrow(run, "depth long, node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes, from conversations (conv, size) and turns (conv, depth 1, 2, 3..., role, digest, bytes)."""
    members = checkpoint(prefixes(convs, turns))
    nodes, told = placed_nodes(members)
    del members
    free_shuffles(convs.sparkSession)
    sums = subtree_sums(nodes, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    ends = end_digests(told.join(convs, "conv").filter(F.col("depth") == F.col("size")))
    out = nodes.join(sums, ["depth", "node"]).join(ends, ["depth", "node"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    convs, rebuilt = rebuilt_turns(turns, conv - conv % 5, F.pmod(F.crc32(conv.cast("string")), F.lit(9)))
    return prefix_trie(checkpoint(convs), rebuilt)


_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), taken AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
), counted AS (SELECT k.*, least(h, (SELECT count(*) FROM own o WHERE o.conv_id = k.base)) AS given FROM taken k),
turns AS (
  SELECT k.conv_id AS conv, o.pos AS depth, o.role, o.text FROM counted k JOIN own o ON o.conv_id = k.base AND o.pos <= k.given
  UNION ALL SELECT k.conv_id, o.pos - k.h + k.given, o.role, o.text FROM counted k JOIN own o ON o.conv_id = k.conv_id AND o.pos > k.h
), members AS (
  SELECT conv, depth, octet_length(encode(text)) AS bytes,
    sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY conv ORDER BY depth)) AS prefix FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM counted
), sized AS (SELECT *, max(depth) OVER (PARTITION BY conv) AS size, min(conv) OVER (PARTITION BY depth, prefix) AS node FROM members),
nodes AS (
  SELECT depth, node, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (depth = size), '')) AS ends_sha256 FROM sized GROUP BY 1, 2
), parents AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN sized p ON p.conv = n.node AND p.depth = n.depth - 1),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (depth, node)),
below AS (
  SELECT a.depth, a.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM full_nodes u JOIN sized a ON a.conv = u.node AND a.depth <= u.depth GROUP BY 1, 2
)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_nodes JOIN below USING (depth, node)
"""
