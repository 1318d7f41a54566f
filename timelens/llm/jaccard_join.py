"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A document's set holds its distinct 4-word shingles as 64-bit hashes. Documents link when the Jaccard similarity of their sets is at
least 85 / 100. Under any fixed order of shingles, two sets that link share at least l shingles among the first
|s| - ceil(0.85 |s|) + l of each, for every l up to the overlap that they need. The join uses this twice:

1. In hash order, with l near a twentieth of the set. Documents whose prefix has fewer than l shingles in common with other
   sets link with nothing and go. What remains is near copies, whatever passages the others share.
2. Among the rest, in order of exact document frequency, rarest first. Each document's prefix is lengthened while its
   estimated cost (postings read, and candidates that reach l matches) falls, and a pair needs the smaller l of its two
   documents. Copies with many edits of their own have nothing but those in their prefixes.

Within a large group of near copies pairs aren't enumerated: in each posting list documents are first verified against its most central
member, and only documents of different components, whose distances to a common centre allow a link, make pairs after that. Every link is either verified or lies within a
component, so the components are exact. Documents with equal sets share one node from the start.

Defined results: null, empty and blank texts have empty sets, are linked with nothing and are their own component; repeated rows are
one node and each gets the same component; rows without a doc_id are linked with nothing and have no component; an empty
table gives no rows; texts are read whole at any length; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.common import checkpoint, free_shuffles, table, text_parts, without_estimate, worker_cache

WORDS = 4
SHARE = (85, 100)
#: Cost of a candidate's verification, in postings.
VERIFY = 4.0
#: Multi-match numbers that are tried for a document.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
KEPT_WORDS = 50_000
#: Earlier shingles of its prefix that a posting carries: two postings that share one of them have met there.
CARRIED = 4
#: Bytes of text held at once.
SLICE = 2_000_000
#: Rows of two integers that may be broadcast.
BROADCAST_ROWS = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed integers. bytes.lower() and split() know A-Z and the six blanks only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        whole = xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))
        return np.array([whole], np.uint64).view(np.int64)
    n = len(words) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(WORDS):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MULTIPLIERS[i] + h[i : i + n]
    return np.unique(_mixed(mixed).view(np.int64))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any set that it links with; no such set is smaller."""
    return (SHARE[0] * n + SHARE[1] - 1) // SHARE[1]


def coarse_matches(n: int) -> int:
    return 1 + n // 20


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the set), n, and the set's first shingles in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for text in (t for part in text_parts(batch.column(1), SLICE) for t in part):
                s = shingles(text)
                n = len(s)
                nodes.append(_node(s))
                sizes.append(n)
                prefixes.append(s[: n - least_overlap(n) + coarse_matches(n)] if n else s)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()), "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, prefix array<long>")


def whole_sets(rows: DataFrame) -> DataFrame:
    """node, n and all shingles, from (node, text) where the text has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        for batch in batches:
            sets = [(node, s) for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _node(s := shingles(text)) == node]
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in sets])]).astype(np.int32)
            values = np.concatenate([s for _, s in sets]) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in sets], pa.int64()), "n": pa.array([len(s) for _, s in sets], pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))})

    return rows.select("node", "text").mapInArrow(run, "node long, n long, tokens array<long>")


def choose_matches(n: int, unique: int, frequencies: np.ndarray) -> int:
    """The multi-match number of least estimated cost; 0 if the set links with nothing.

    frequencies are those of its shingles that other sets have too, rarest first; unique is the number of the others.
    """
    best, chosen = float("inf"), 0
    spare = n - least_overlap(n)
    postings = np.cumsum(frequencies - 1)
    for m in MATCHES:
        if m > least_overlap(least_overlap(n)):
            break
        shared = spare + m - unique
        if shared < m:  # fewer shared shingles in the prefix than matches needed: no partner
            return 0
        read = float(postings[min(shared, len(postings)) - 1])
        cost = read + VERIFY * read / m
        if cost < best:
            best, chosen = cost, m
    return chosen


def adaptive_prefixes(ranked: DataFrame) -> DataFrame:
    """node, n, matches, own (shingles that no other set has), central (mean frequency of the set's shingles) and prefix, from (node, n, shared: array of (frequency, token), sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, n, frequencies, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                f = np.array(frequencies, np.float64)
                m = choose_matches(n, n - len(f), f)
                if m:
                    rows.append((node, n, m, n - len(f), (f.sum() + n - len(f)) / n, tokens[: n - least_overlap(n) + m - (n - len(f))]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "matches", "own", "central", "prefix"])

    slim = ranked.select("node", "n", F.col("shared.frequency").alias("frequencies"), F.col("shared.token").alias("tokens"))
    return slim.mapInArrow(run, "node long, n long, matches long, own long, central double, prefix array<long>")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.lit(SHARE[1]) * F.least(a, b) >= F.lit(SHARE[0]) * F.greatest(a, b)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with apart, the shingles that only one of them has, and whether they link."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    met = met.select(*pairs.columns, (F.size("ta") + F.size("tb") - 2 * F.col("common")).alias("apart"), (F.col("common") + 0).alias("common"))
    return met.withColumn("links", F.lit(SHARE[1]) * F.col("common") >= F.lit(SHARE[0]) * (F.col("apart") + F.col("common"))).drop("common")


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of the edges (a, b): contraction to the least neighbour, until no edge is left.

    Nodes are hashes, so the least neighbour is a random one and each round shrinks a component by a constant factor.
    """
    edges = without_estimate(checkpoint(edges.filter("a <> b").select("a", "b").distinct()))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = checkpoint(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to")))
        hop = least.select(F.col("v").alias("w"), F.col("to").alias("further"))
        step = checkpoint(least.join(hop, F.col("to") == F.col("w")).select("v", F.col("further").alias("to")))
        labels = without_estimate(checkpoint(labels.join(step, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root"))))
        a, b = step.select(F.col("v").alias("a"), F.col("to").alias("na")), step.select(F.col("v").alias("b"), F.col("to").alias("nb"))
        edges = without_estimate(checkpoint(edges.join(a, "a").join(b, "b").filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()))
    return labels


def _to_centres(postings: DataFrame) -> DataFrame:
    """Each document of a posting list (a) with the list's most central one (b)."""
    centres = postings.groupBy("token").agg(F.max_by(F.struct("node", "n", "central"), F.struct("central", "node")).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    joined = postings.join(checkpoint(centres.select("token", F.col("centre.node").alias("b"), F.col("centre.n").alias("bn"), F.col("centre.central").alias("b_central"))), "token")
    return joined.filter((F.col("node") != F.col("b")) & _sizes_fit(F.col("n"), F.col("bn"))).select(F.col("node").alias("a"), "b", "b_central").distinct()


def _own_centres(prefixes: DataFrame, to_centres: DataFrame) -> DataFrame:
    """node, its most central centre (itself where it is more central), and how many shingles they are apart."""
    measured_ = to_centres.select(F.col("a").alias("node"), F.col("b").alias("centre"), "apart", F.col("b_central").alias("central"))
    every = measured_.union(prefixes.select("node", F.col("node").alias("centre"), F.lit(0).alias("apart"), "central"))
    best = every.groupBy("node").agg(F.max_by(F.struct("centre", "apart"), F.struct("central", "centre")).alias("best"))
    return best.select("node", "best.centre", "best.apart")


def _candidates_across(prefixes: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of documents of different components that match often enough.

    Two documents of one centre differ from it in the sets D and E. They are |D| + |E| - 2 |D and E| apart, and what both share in D
    and E can't be shingles of one's own; where this is too much already, they make no pair. Strays of a large group of near copies,
    which don't link with its centre, thus meet few of the others. A pair is made where its documents first meet, not again for
    shingles that follow closely in both prefixes; then its matches are counted.
    """
    placed = prefixes.select("node", "n", "own", "central", "prefix", F.posexplode("prefix").alias("at", "token"))
    before = F.slice("prefix", F.greatest(F.col("at") - (CARRIED - 1), F.lit(1)), F.least(F.col("at"), F.lit(CARRIED)))
    rows = placed.withColumn("before", before).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(centres, "node")
    rows = checkpoint(rows.select("token", "before", "node", "n", "central", "root", "centre", "apart", F.greatest(F.lit(0), F.col("apart") - F.col("own")).alias("open")))
    lists = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", F.struct("central", "node")).alias("main")).filter("lo <> hi")
    rows = checkpoint(rows.join(checkpoint(lists.select("token", "main")), "token"))
    kept = ("node", "n", "before", "root", "centre", "apart", "open")
    x = rows.filter("root <> main").select("token", "main", *[F.col(c).alias(f"{c}_a") for c in kept])
    y = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in kept])
    least_apart = F.col("apart_a") + F.col("apart_b") - 2 * F.least("open_a", "open_b")
    near = (F.col("centre_a") != F.col("centre_b")) | (F.lit(SHARE[0] + SHARE[1]) * least_apart <= F.lit(SHARE[1] - SHARE[0]) * (F.col("n_a") + F.col("n_b")))
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
    met = x.join(y, "token").filter(once & near & _sizes_fit(F.col("n_a"), F.col("n_b")) & ~F.arrays_overlap("before_a", "before_b"))
    pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    of = lambda side: prefixes.select(F.col("node").alias(side), F.col("prefix").alias(f"prefix_{side}"), F.col("matches").alias(f"matches_{side}"))
    enough = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("matches_a", "matches_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(enough).select("a", "b")


def linked_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with their sets' sizes and components: doc_id, n_shingles, component_id."""
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, further columns) that stay where one document of each component does: the one with the smallest doc_id.

    A document is a doc_id with a set: a text under a repeated id counts by its own set, and of repeated rows one stays. Rows without a
    doc_id, and those with an empty set, are linked with nothing and stay.
    """
    found = checkpoint(linked_rows(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL"))
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.doc_id", "first.node")
    stays = checkpoint(first.union(found.filter("n_shingles = 0").select("doc_id", "node").distinct()))
    repeated = checkpoint(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    nameless = docs.filter("doc_id IS NULL")
    if repeated.isEmpty():
        return docs.join(stays.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).union(nameless)
    once = docs.join(repeated, "doc_id", "left_anti").join(stays.select("doc_id").distinct(), "doc_id", "left_semi")
    # rows of an id that stands for several are told apart by their sets
    node, size, copy = (f"{'_' * (1 + max(map(len, docs.columns)))}{n}" for n in ("node", "size", "copy"))
    told = _with_nodes(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), node, size)
    named = told.join(stays.select(F.col("doc_id").alias(f"{node}_id"), F.col("node").alias(f"{node}_of")), (F.col("doc_id") == F.col(f"{node}_id")) & (F.col(node) == F.col(f"{node}_of")), "left_semi")
    order = Window.partitionBy("doc_id", node).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    ranked = named.filter(F.col(size) > 0).withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1)
    kept = ranked.select(*docs.columns).union(named.filter(F.col(size) == 0).select(*docs.columns))
    return once.select(*docs.columns).union(kept).union(nameless)


def _with_nodes(docs: DataFrame, node: str, size: str) -> DataFrame:
    """docs with their sets' hashes and sizes."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for part in text_parts(batch.column(at), SLICE) for text in part]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=[*names, node, size])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType()), T.StructField(size, T.LongType())]))


def linked_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, node (a hash of the set), n_shingles, root (a node of the component; null without a set or an id), component_id."""
    spark = docs.sparkSession
    signed = checkpoint(signatures(docs))
    filled = signed.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = checkpoint(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")))
    postings = filled.select("node", F.explode("prefix").alias("token"))
    met = checkpoint(postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token"))
    # ceil(0.85 n), the size of its smallest partner, whose matches suffice
    partner = F.floor((F.lit(SHARE[0]) * F.col("n") + F.lit(SHARE[1] - 1)) / SHARE[1])
    # each copy of a set has all its postings
    hits = postings.join(met, "token").groupBy("node").count().join(nodes, "node").filter(F.col("count") >= F.col("copies") * (1 + F.floor(partner / 20)))
    active = checkpoint(hits.select("node", F.col("first").alias("doc_id")))
    del postings, met, hits
    free_shuffles(spark)

    # active documents are sent to all tasks only if they are few, else their texts meet them in a shuffle
    few = active.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(active) if few else active, "doc_id")
    sets = checkpoint(whole_sets(texts).dropDuplicates(["node"]))
    free_shuffles(spark)
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    frequent = checkpoint(tokens.groupBy("token").agg(F.count("*").alias("frequency")).filter("frequency > 1"))
    # a set with too many shingles of its own has none of the others in its prefix
    spare = F.col("n") - F.floor((F.lit(SHARE[0]) * F.col("n") + F.lit(SHARE[1] - 1)) / SHARE[1])
    ranked = tokens.join(frequent, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("frequency", "token"))).alias("shared")).filter(F.col("n") - F.size("shared") <= spare)
    prefixes = checkpoint(adaptive_prefixes(ranked))
    del tokens, frequent, ranked
    free_shuffles(spark)

    lists = prefixes.select("node", "n", "central", F.explode("prefix").alias("token"))
    to_centres = checkpoint(measured(checkpoint(_to_centres(lists)), sets))
    near = to_centres.filter("links").select("a", "b")
    labels = components(near)
    free_shuffles(spark)
    pairs = checkpoint(_candidates_across(prefixes, labels, _own_centres(prefixes, to_centres)))
    across = checkpoint(measured(pairs, sets).filter("links").select("a", "b"))
    free_shuffles(spark)
    if not across.isEmpty():
        labels = components(near.union(across))

    rooted = checkpoint(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("component")))
    by_node = checkpoint(rooted.join(least, "root").select("node", "root", "component"))
    out = signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "node", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"), own.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram FROM cut
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * met.shared >= 85 * (p.n + q.n - met.shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS seen FROM ways UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
