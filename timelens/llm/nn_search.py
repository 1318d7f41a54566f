"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, which keeps its k + 1 smallest ids: more of them can't be among k nearest, so nothing is lost.
A hash deals all nodes into shards of at most MOST nodes, about SHARDS of them unless the table is larger or small. A shard's graph is made in its
task: random-projection trees deal its nodes into blocks, within which neighbours are exact. Then NN-descent joins each node's neighbours, both
ways, with one another and keeps the nearest, for a few rounds. Of two neighbours one must be new since the last round.

Each query is searched in every shard: from members of its leaves of the trees the nearest nodes met so far, the beam, are expanded along the
links until none of them is left. The nearest of all shards are kept. So a shard is shipped once, and no code is shipped along an edge. Recall is measured on
CHECKED queries against all nodes; while it is under RECALL, the beam is doubled. A query that has met fewer than k rows is compared with
all nodes, in blocks of queries. Making graphs grows with the nodes; beyond SHARDS * MOST nodes searches grow with queries times shards.

Vectors are shipped as 16-bit floats around a mean of all, each with a scale of its own, so that very long vectors leave the others'
digits alone; recall is measured, and the scores returned are, by the original vectors.

Defined results: rows whose id is null, or whose vector is null, empty, zero, or holds null or non-finite components take no part; a row
is searched among rows with vectors of its own length; rows with the same id are rows of their own, as candidates and as
queries; fewer than k candidates are all returned; an empty table gives no rows; ties go to the smaller id; further columns
are ignored.

The choice of a node's REVERSE incoming neighbours is part of NN-descent's sampling, and of no effect on which rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, table

NEAREST = 10
#: Neighbours kept for a node, incoming ones joined with them, trees, nodes of a block, neighbours taken from a block.
NEIGHBOURS, REVERSE, TREES, LEAF, FROM_LEAF = 32, 32, 6, 400, 16
#: Nodes whose neighbours are joined with one another at once.
GROUPS = 200
#: Shards of a table that isn't very large, and nodes of a shard, at least and about at most.
SHARDS, LEAST, MOST = 16, 4096, 1 << 17
ROUNDS, SETTLED = 8, 0.005
#: Nodes kept for a query at first, in a shard and of all shards, expanded at once, and taken from a leaf as starts.
BEAM, WIDE, STARTS = 64, 16, 16
#: Marks of the nodes that queries have met, held at once.
MARKS = 1 << 25
#: Queries whose nearest nodes are also found exactly, the recall that they must have, and queries compared with all nodes in one pass.
CHECKED, RECALL, BLOCK = 100, 0.95, 1000


def valid_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, vec, length) of the rows that take part."""
    kind = dict(rows.dtypes)["embedding"]
    vec = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL").filter(finite & F.exists("vec", lambda x: x != 0))
    # adding zero makes -0.0 equal to 0.0
    return good.withColumn("vec", F.transform("vec", lambda x: x + (F.lit(0.0).cast("float") if kind == "array<float>" else F.lit(0.0)))).withColumn("length", F.size("vec"))


def make_nodes(rows: DataFrame, k: int) -> DataFrame:
    """node, vec, ids (sorted, as often as they stand in rows): a row for each distinct vector."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("vec").alias("node"), "vec", "ids")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centre(nodes: DataFrame, width: int) -> np.ndarray:
    """The mean of the vectors that are no longer than four times the median length; a few very long ones don't move it."""
    long = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = 4 * (nodes.agg(F.percentile_approx(long, 0.5)).first()[0] or 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for b in batches:
            total += matrix(b.column(0), width).sum(axis=0, dtype=np.float64)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64())), "n": pa.array([n], pa.int64())})

    parts = nodes.filter(long <= F.lit(most)).select("vec").mapInArrow(run, "total array<double>, n long").collect()
    return np.sum([p["total"] for p in parts], axis=0) / max(1, sum(p["n"] for p in parts))


def coded(x: np.ndarray) -> list[bytes]:
    """Rows as 16-bit floats, after the power of two that scales each to a reach of about a thousand."""
    top = np.abs(x).max(axis=1, initial=0.0)
    power = np.where(top > 0, np.ceil(np.log2(np.where(top > 0, top, 1.0) / 1024.0)), 0.0).astype(np.int16)
    parts = np.ldexp(x, -power.astype(np.int32)[:, None]).astype(np.float16)
    return [p.tobytes() + c.tobytes() for p, c in zip(power, parts, strict=True)]


def packed(nodes: DataFrame, mean: np.ndarray) -> DataFrame:
    """node, code: vectors less the mean."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "code": pa.array(coded(matrix(b.column(1), width) - mean), pa.binary())})

    return nodes.select("node", "vec").mapInArrow(run, "node long, code binary")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width + 1)
    power, parts = raw[:, 0].copy().view(np.int16).astype(np.int32), raw[:, 1:]
    # lengths whose squares are beyond single precision are rare, and taken in double
    kind = np.float64 if len(power) and power.max() > 40 else np.float32
    return np.ldexp(parts.astype(kind), power[:, None])


def fit_tree(sample: np.ndarray, least: int, rng: np.random.Generator) -> list:
    """A random-projection tree: nested [direction, cut, below, above] down to parts of about ``least`` vectors."""
    if len(sample) <= 2 * least:
        return []
    a, b = sample[rng.choice(len(sample), 2, replace=False)]
    direction = (a - b).astype(np.float32)
    at = sample @ direction
    cut = float(np.median(at))
    below = at < cut
    if below.all() or not below.any():
        return []
    return [direction, cut, fit_tree(sample[below], least, rng), fit_tree(sample[~below], least, rng)]


def route(tree: list, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector, as a number that spells its path."""
    leaf = np.ones(len(vectors), np.int64)

    def down(part: list, rows: np.ndarray, path: int) -> None:
        if not part or not len(rows):
            leaf[rows] = path
            return
        below = vectors[rows] @ part[0] < part[1]
        down(part[2], rows[below], 2 * path)
        down(part[3], rows[~below], 2 * path + 1)

    down(tree, np.arange(len(vectors)), 1)
    return leaf


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.maximum(d, 0)


def _edges(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for u, v, d in found:
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d.astype(np.float32))})


EDGES = "u long, v long, d float"


def leaves_of(trees: list, vectors: np.ndarray) -> list[np.ndarray]:
    return [route(tree, vectors) for tree in trees]


def fit_trees(x: np.ndarray, trees: int, leaf: int) -> list:
    rng = np.random.default_rng(31)
    return [fit_tree(x, max(4, leaf // 2), rng) for _ in range(trees)]


def kept(u: np.ndarray, v: np.ndarray, d: np.ndarray, fresh: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each node's edges, sorted by node and distance. Of equal edges the first in order stays, so one that was there already isn't fresh."""
    once = np.unique(u * n + v, return_index=True)[1]
    u, v, d, fresh = u[once], v[once], d[once], fresh[once]
    order = np.lexsort((d, u))
    u, v, d, fresh = u[order], v[order], d[order], fresh[order]
    near = np.arange(len(u)) - np.searchsorted(u, u) < k
    return u[near], v[near], d[near], fresh[near]


def block_edges(x: np.ndarray, trees: list, most: int, k: int) -> tuple[np.ndarray, ...]:
    """Exact neighbours within the blocks of every tree; a leaf of very many nodes is cut into blocks of ``most``."""
    us, vs, ds = [], [], []
    for leaf in leaves_of(trees, x):
        order = np.argsort(leaf, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            for block in np.array_split(members, -(-len(members) // most)):
                few = min(k, len(block) - 1)
                if few < 1:
                    continue
                d = distances(x[block], x[block])
                np.fill_diagonal(d, np.inf)
                best = np.argpartition(d, few - 1, axis=1)[:, :few]
                us.append(np.repeat(block, few))
                vs.append(block[best].ravel())
                ds.append(np.take_along_axis(d, best, 1).ravel())
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, x.dtype)
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


def padded(u: np.ndarray, v: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first ``width`` of each node's v in a row, -1 where there are fewer; u is sorted."""
    out, rank = np.full((n, width), -1, np.int64), np.arange(len(u)) - np.searchsorted(u, u)
    out[u[rank < width], rank[rank < width]] = v[rank < width]
    return out


def both_ways(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int, k: int, reverse: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's neighbours and its nearest incoming ones, -1 where there are fewer, and the place of each one's edge."""
    back = np.lexsort((d, v))
    place = np.concatenate([padded(u, np.arange(len(u)), n, k), padded(v[back], back, n, reverse)], axis=1)
    other = np.concatenate([v, u, [-1]])
    return other[np.where(place < 0, 2 * len(u), place + np.r_[np.zeros(k, np.int64), np.full(reverse, len(u))])], place


def descend(x: np.ndarray, edges: tuple, k: int, reverse: int, groups: int) -> tuple[tuple, int]:
    """A round of NN-descent: the better graph, and how many nearer neighbours it found."""
    u, v, d, fresh = edges
    n = len(x)
    near, place = both_ways(u, v, d, n, k, reverse)
    new = (place >= 0) & np.append(fresh, False)[place]
    # of a neighbour met both ways one stays
    order = np.argsort(near, axis=1, kind="stable")
    ranked = np.take_along_axis(near, order, 1)
    again = np.zeros(near.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    near = np.where(again, -1, near)
    worst = np.full(n + 1, np.inf, x.dtype)
    counts = np.bincount(u, minlength=n)
    full = np.flatnonzero(counts == k)
    worst[full] = d[np.cumsum(counts)[full] - 1]
    worst[n] = -np.inf
    squares = (x * x).sum(1)
    us, vs, ds = [u], [v], [d]
    open_ = np.flatnonzero((new & (near >= 0)).any(axis=1))
    for at in range(0, len(open_), groups):
        rows = open_[at : at + groups]
        c, f = near[rows], new[rows]
        y = x[c]
        apart = squares[c][:, :, None] + squares[c][:, None] - 2 * (y @ y.transpose(0, 2, 1))
        hit = (apart < worst[c][:, :, None]) & (f[:, :, None] | f[:, None]) & (c >= 0)[:, None] & (c >= 0)[:, :, None]
        hit &= c[:, :, None] != c[:, None]
        g, a, b = np.nonzero(hit)
        us.append(c[g, a])
        vs.append(c[g, b])
        ds.append(np.maximum(apart[g, a, b], 0))
    u, v, d = map(np.concatenate, (us, vs, ds))
    better = kept(u, v, d, np.arange(len(u)) >= len(edges[0]), n, k)
    return better, int(better[3].sum())


def linked(x: np.ndarray, trees: list, k: int, reverse: int, leaf: int, from_leaf: int, rounds: int, settled: float, groups: int) -> np.ndarray:
    """The links of each node, both ways, after NN-descent from the blocks of the trees."""
    n, k = len(x), min(k, len(x) - 1)
    u, v, d = block_edges(x, trees, 2 * leaf, from_leaf)
    edges = kept(u, v, d, np.ones(len(u), bool), n, k)
    for _ in range(rounds):
        edges, fresh = descend(x, edges, k, reverse, groups)
        if fresh <= settled * n * k:
            break
    return both_ways(*edges[:3], n, k, reverse)[0]


def greedy(x: np.ndarray, links: np.ndarray, asked: np.ndarray, starts: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes nearest to each vector asked that a search along the links from its starts meets (-1: none), and squared distances."""
    n, m = len(x), len(asked)
    beam = min(beam, n)
    wide = min(wide, beam)
    at, near, done = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, x.dtype), np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    while True:
        q, v = np.repeat(np.arange(m), starts.shape[1]), starts.ravel()
        fresh = v >= 0
        fresh[fresh] = ~seen[q[fresh], v[fresh]]
        q, v = np.divmod(np.unique(q[fresh] * n + v[fresh]), n)
        seen[q, v] = True
        if len(q):
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            more, apart = np.full((m, rank.max() + 1), -1, np.int64), np.full((m, rank.max() + 1), np.inf, x.dtype)
            more[q, rank] = v
            for i in range(0, len(q), 1 << 16):
                part = slice(i, i + (1 << 16))
                gap = x[v[part]] - asked[q[part]]
                apart[q[part], rank[part]] = np.einsum("ij,ij->i", gap, gap)
            at, near, done = np.concatenate([at, more], 1), np.concatenate([near, apart], 1), np.concatenate([done, more < 0], 1)
            best = np.argpartition(near, beam - 1, axis=1)[:, :beam]
            at, near, done = (np.take_along_axis(a, best, 1) for a in (at, near, done))
        if done.all():
            return at, near
        pick = np.argpartition(np.where(done, np.inf, near), wide - 1, axis=1)[:, :wide]
        ready = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        starts = np.where(ready[:, :, None], links[np.take_along_axis(at, pick, 1)], -1).reshape(m, -1)


def entries(x: np.ndarray, trees: list, asked: np.ndarray, each: int) -> np.ndarray:
    """Members of the leaves of each vector asked, -1 where there are fewer."""
    out = []
    for own, leaf in zip(leaves_of(trees, x), leaves_of(trees, asked), strict=True):
        order = np.argsort(own, kind="stable")
        first, last = np.searchsorted(own[order], leaf), np.searchsorted(own[order], leaf, side="right")
        place = first[:, None] + np.arange(each)
        out.append(np.where(place < last[:, None], order[np.minimum(place, len(order) - 1)], -1))
    return np.concatenate(out, axis=1)


def nearest_edges(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each node's edges (u, v, d, fresh); an edge that is there already is not fresh."""
    order = Window.partitionBy("u").orderBy("d", "v")
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def build_graph(codes: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """shard, node, code and near (places of linked nodes within the shard, which is sorted by node), and the number of shards."""
    shards = max(1, -(-n // MOST), min(SHARDS, n // LEAST))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()
        x = unpacked(group.column("code").combine_chunks(), width)
        if len(x) > 1:
            near = linked(x, fit_trees(x, TREES, LEAF), NEIGHBOURS, REVERSE, LEAF, FROM_LEAF, ROUNDS, SETTLED, GROUPS)
        else:
            near = np.full((1, 1), -1)
        return group.append_column("near", pa.array([row.astype(np.int32).tobytes() for row in near], pa.binary()))

    # a number of partitions: by bytes, shards would be put together in few tasks
    dealt = codes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "code").repartition(shards, "shard")
    return checkpoint(dealt.groupBy("shard").applyInArrow(run, "shard int, node long, code binary, near binary")), shards


def distance(x: str, y: str) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def exact_nodes(nodes: DataFrame, picked: pa.Table, k: int, width: int) -> DataFrame:
    """u, v, d: the k nearest other nodes (node, vec) of those picked, by the vectors themselves in double precision, by one scan of all nodes."""
    starts = picked.column("node").to_numpy()
    held = nodes.sparkSession.sparkContext.broadcast(matrix(picked.column("vec").combine_chunks(), width).astype(np.float64))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for b in batches:
                if not b.num_rows or not len(starts):
                    continue
                members, x = b.column(0).to_numpy(), matrix(b.column(1), width).astype(np.float64)
                d = distances(held.value, x)
                d[starts[:, None] == members[None]] = np.inf
                # the short form loses digits far from the origin: more than k by it, then the differences themselves
                some = min(2 * k + 10, len(members))
                best = np.argpartition(d, some - 1, axis=1)[:, :some]
                apart = np.stack([((x[rows] - own) ** 2).sum(axis=1) for own, rows in zip(held.value, best, strict=True)])
                apart[np.isinf(np.take_along_axis(d, best, 1))] = np.inf
                few = min(k, len(members))
                order = np.argsort(apart, axis=1)[:, :few]
                u, v, d = np.repeat(starts, few), np.take_along_axis(members[best], order, 1).ravel(), np.take_along_axis(apart, order, 1).ravel()
                other = np.isfinite(d)
                yield u[other], v[other], np.minimum(d[other], np.finfo(np.float32).max)

        return _edges(found())

    every = nodes.select("node", "vec").mapInArrow(near, EDGES)
    return nearest_edges(every.withColumn("fresh", F.lit(True)), k).select("u", "v", "d")


def search_shards(index: DataFrame, shards: int, asked: DataFrame, beam: int, width: int) -> DataFrame:
    """q, v: the nearest nodes that greedy searches in all shards have met for each query node (asked: q, code)."""

    def run(group: pa.Table, wanted: pa.Table) -> pa.Table:
        us, vs, ds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        if len(group) and len(wanted):
            group = group.sort_by("node")
            nodes, x = group.column("node").to_numpy(), unpacked(group.column("code").combine_chunks(), width)
            links = np.frombuffer(b"".join(group.column("near").to_pylist()), np.int32).reshape(len(x), -1)
            trees, queries, y = fit_trees(x, TREES, LEAF), wanted.column("q").to_numpy(), unpacked(wanted.column("code").combine_chunks(), width)
            each = max(1, min(BLOCK, MARKS // len(x)))
            for i in range(0, len(y), each):
                part = y[i : i + each]
                at, d = greedy(x, links, part, entries(x, trees, part, STARTS), beam, WIDE)
                us.append(np.repeat(queries[i : i + each], at.shape[1])[(at >= 0).ravel()])
                vs.append(nodes[at[at >= 0]])
                ds.append(np.minimum(d[at >= 0], np.finfo(np.float32).max).astype(np.float32))
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs), "d": np.concatenate(ds)})

    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "code")
    met = index.repartition(shards, "shard").groupBy("shard").cogroup(everywhere.repartition(shards, "shard").groupBy("shard")).applyInArrow(run, EDGES)
    return nearest_edges(met.withColumn("fresh", F.lit(True)), beam).filter("u <> v").select(F.col("u").alias("q"), "v")


def search(codes: DataFrame, nodes: DataFrame, index: DataFrame, shards: int, starts: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """q, v: the nodes found for each query node (starts: node), as many as the recall on CHECKED ones, by their vectors themselves, asks for."""
    asked = checkpoint(starts.join(codes, "node").select(F.col("node").alias("q"), "code"))
    picked = starts.orderBy(F.xxhash64("node"), "node").limit(CHECKED).join(nodes.select("node", "vec"), "node").select("node", "vec").toArrow()
    exact = checkpoint(exact_nodes(nodes, picked, k, width))
    wanted = exact.count()
    beam = max(BEAM, 2 * k)
    while True:
        found = checkpoint(search_shards(index, shards, asked, beam, width))
        met = found.join(exact.select(F.col("u").alias("q"), "v"), ["q", "v"]).count()
        if met >= RECALL * wanted or beam >= n:
            return found
        beam *= 2


def completed(nodes: DataFrame, found: DataFrame, starts: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """found (q, v), and for each query node that has met fewer than k rows its nearest nodes of all."""
    size = nodes.select(F.col("node").alias("v"), F.size("ids").alias("rows"))
    own = starts.select(F.col("node").alias("q")).join(size, F.col("q") == F.col("v")).select("q", (F.col("rows") - 1).alias("rows"))
    rows = found.join(size, "v").select("q", "rows").union(own).groupBy("q").agg(F.sum("rows").alias("rows"))
    met = found.groupBy("q").count()
    short = rows.join(met, "q", "left").filter((F.col("rows") < k) & (F.coalesce("count", F.lit(0)) < n - 1)).select(F.col("q").alias("node"))
    short = checkpoint(short.join(nodes.select("node", "vec"), "node"))
    many = short.count()
    blocks = -(-many // BLOCK)
    more = [found]
    for i in range(blocks):
        # blocks by a hash, so that a block's size is near BLOCK
        picked = short.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).toArrow()
        more.append(checkpoint(exact_nodes(nodes, picked, k, width)).select(F.col("u").alias("q"), "v"))
    return reduce(DataFrame.union, more).distinct() if blocks else found


def _nearest_of_length(good: DataFrame, is_query: Column, width: int, k: int) -> DataFrame:
    nodes = checkpoint(make_nodes(good, k))
    n = nodes.count()
    codes = checkpoint(packed(nodes, centre(nodes, width)))
    queries = good.filter(is_query).select(F.col("vec_id").alias("q"), F.xxhash64("vec").alias("start"), F.col("vec").alias("qvec"))
    starts = checkpoint(queries.select(F.col("start").alias("node")).distinct())
    if n > 1:
        index, shards = build_graph(codes, n, width)
        found = completed(nodes, search(codes, nodes, index, shards, starts, n, width, k), starts, n, width, k)
    else:
        found = starts.select(F.col("node").alias("q"), F.col("node").alias("v")).limit(0)
    reached = checkpoint(found.union(starts.select("node", F.col("node").alias("v"))).select(F.col("q").alias("start"), F.col("v").alias("node")))
    hits = queries.withColumn("copy", F.monotonically_increasing_id()).join(reached, "start").join(nodes, "node")
    hits = hits.select("q", "copy", distance("vec", "qvec").alias("d"), F.when(F.col("start") == F.col("node"), F.array_position("ids", F.col("q"))).otherwise(0).alias("own"), F.posexplode("ids").alias("at", "vec_id"))
    # the query's own row is one of those with its id and vector; of k + 1 that are kept, it may be beyond the last
    order = Window.partitionBy("q", "copy").orderBy("d", "vec_id")
    ranked = hits.filter("at + 1 <> own").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank, vec_id, score. is_query is a condition on vec_id."""
    good = checkpoint(valid_rows(rows))
    lengths = [r["length"] for r in good.select("length").distinct().orderBy("length").collect()]
    found = [_nearest_of_length(good.filter(F.col("length") == w).select("vec_id", "vec"), is_query, w, k) for w in lengths]
    empty = good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, found) if found else empty


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
