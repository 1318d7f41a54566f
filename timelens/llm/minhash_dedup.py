"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents link when the Jaccard similarity of their sets is at
least 85 / 100. In each of TREES independent trees a document walks down from the root: at every level it goes to the child that is named by its
minwise token under that level's own hash function, so two documents part with probability 1 - J at each level. Nodes are counted at every
STEP-th level: one of at most SMALL documents is a leaf and is compared exhaustively; larger ones branch again, down to LEVELS levels.

Recall: two documents of similarity s meet in a leaf of level k of one tree with probability s^k, so they miss each other in all trees with
(1 - s^k)^TREES: at s = 0.85 that is 3e-7 for the deepest leaves, and less for others. The two tests before the exact one cost 6e-7
(COMPANY) and 3e-7 (agreement of sketches) at that similarity, and less above it. Members of the deepest leaves are near copies or many; they aren't cut.

Before the walks, tokens are counted over all sets. What a set has alone is in no intersection, so a set is left out if its other tokens are too few
for a link with any set, and a pair is not made if they are too few in one of the two; no link is lost by that. Strays of a large group of near copies
differ from the others by words of their own for the most part.

Documents are first confirmed against the most central members of their leaves: against FIRST of them, which the members of a large group have in
common, and where that doesn't place them in their leaf's central component, against that of each leaf. What remains, members outside the central one's component, is compared with the whole leaf in blocks of BLOCK members by sketches of DRAWN minwise tokens, and only what passes is
confirmed on full sets. Every link is thus either confirmed or lies within a component. Equal sets are one node from the start.

Defined results: null, empty and blank texts have empty sets, are linked with nothing and are their own component; repeated rows are
one node and each gets the same component; under a repeated doc_id each text counts by itself; rows without a doc_id are linked with
nothing, have no component and kept is null; an empty table gives no rows; texts are read whole at any length; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.common import checkpoint, free_shuffles, table, text_parts, worker_cache
from timelens.llm.jaccard_join import components

WORDS = 5
SHARE = (85, 100)
TREES = 32
LEVELS = 6
#: Levels that a walk goes down at once; it divides LEVELS.
STEP = 2
#: Trees whose first level tells whether a document has company at all, and how many of those nodes must hold another set.
COMPANY = (20, 8)
#: Members of a node that doesn't branch further.
SMALL = 64
#: Members of a leaf that are compared at once.
BLOCK = 512
#: Most central members of its leaves that a document is first confirmed against.
FIRST = 2
#: Minwise tokens of a sketch, which holds two bits of each; the first TREES * LEVELS of them also name the nodes.
DRAWN = 512
#: Standard deviations that a linked pair's sketches may agree less than expected.
DEVIATIONS = 5
#: 64-bit words of a sketch.
SKETCH = DRAWN // 32
#: Bytes of text, and tokens, held at once.
SLICE = 2_000_000
TOKENS = 2048
KEPT_WORDS = 50_000
#: Rows of two integers that may be broadcast.
BROADCAST_ROWS = 1_000_000

_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (2, DRAWN), np.uint64)
_FACTORS, _OFFSETS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower() and split() know A-Z and the six blanks only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))] if len(h) else [], np.uint64)
    rolled = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        rolled = rolled * _STEP + h[i : i + len(rolled)]
    return np.unique(_mixed(rolled))


def minwise(tokens: np.ndarray, functions: int) -> np.ndarray:
    """The least value of the tokens under each of the first hash functions."""
    least = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), TOKENS):
        part = tokens[at : at + TOKENS, None] * _FACTORS[:functions] + _OFFSETS[:functions]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def paths(least: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """Keys of the nodes that a set visits, [tree, level]; function level * TREES + tree names the child at that level."""
    key, out = np.arange(trees, dtype=np.uint64), np.empty((trees, levels), np.uint64)
    for level in range(levels):
        out[:, level] = key = _mixed(key * _STEP + least[level * TREES : level * TREES + trees])
    return out


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each minwise token: the words of the first bits, then those of the second ones."""
    mixed = _mixed(least)
    return np.concatenate([np.packbits((mixed >> np.uint64(i) & np.uint64(1)).astype(np.uint8)).view(np.uint64) for i in (0, 1)])


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
    values = np.concatenate([r.ravel() for r in rows]) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def first_nodes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (a hash of the set), n, and the keys of its first nodes in COMPANY's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("minhash_dedup").setdefault("words", _WordHashes())
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in (t for part in text_parts(batch.column(1), SLICE) for t in part):
                tokens = shingle_set(text, hashes, words)
                nodes.append(_node(tokens))
                sizes.append(len(tokens))
                keys.append(paths(minwise(tokens, COMPANY[0]), COMPANY[0], 1) if len(tokens) else tokens)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()), "keys": _lists(keys)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, keys array<long>")


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    """node, n, central and all tokens, from (node, central, text) where the text has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("minhash_dedup").setdefault("words", _WordHashes())
        for batch in batches:
            at, sets = [], []
            for text in (t for part in text_parts(batch.column(2), SLICE) for t in part):
                sets.append(shingle_set(text, hashes, words))
            for i, (node, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)):
                if _node(s) == node:
                    at.append(i)
            kept = batch.take(pa.array(at, pa.int64()))
            sizes = pa.array([len(sets[i]) for i in at], pa.int64())
            yield pa.RecordBatch.from_pydict({"node": kept.column(0), "n": sizes, "central": kept.column(1), "tokens": _lists([sets[i] for i in at])})

    return rows.select("node", "central", "text").mapInArrow(run, "node long, n long, central long, tokens array<long>")


def with_company(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The sets that may link with one of the others, with open: how many of their tokens some other set has."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    alone = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("node").alias("node")).filter("sets = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    counted = sets.join(own, "node", "left").withColumn("open", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return counted.filter(F.lit(share[1]) * F.col("open") >= F.lit(share[0]) * F.col("n"))


def all_nodes(sets: DataFrame) -> DataFrame:
    """node, n, open, central, sketch (an array of SKETCH words) and keys of every STEP-th node on all paths, tree after tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            least = [minwise(values[a:b], DRAWN) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = {f: batch.column(i) for i, f in enumerate(("node", "n", "open", "central"))}
            yield pa.RecordBatch.from_pydict(out | {"sketch": _lists([sketch(x) for x in least]), "keys": _lists([paths(x, TREES, LEVELS)[:, STEP - 1 :: STEP] for x in least])})

    return sets.select("node", "n", "open", "central", "tokens").mapInArrow(run, "node long, n long, open long, central long, sketch array<long>, keys array<long>")


def least_agreement(share: tuple[int, int]) -> int:
    """Tokens that sketches of linked documents have alike, but for 3 pairs in ten million at the very share; unlike tokens have the same bits every fourth time."""
    p = 0.25 + 0.75 * share[0] / share[1]
    return math.floor(DRAWN * p - DEVIATIONS * math.sqrt(DRAWN * p * (1 - p)))


def may_link(a: str, b: str, share: tuple[int, int]) -> Column:
    """Sizes, tokens that others have, and sketches of the columns with these suffixes allow a link."""
    unlike = [F.col(f"sketch{a}")[i].bitwiseXOR(F.col(f"sketch{b}")[i]) for i in range(SKETCH)]
    apart = sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(unlike[: SKETCH // 2], unlike[SKETCH // 2 :], strict=True)), F.lit(0))
    most, both = F.least(f"open{a}", f"open{b}"), F.col(f"n{a}") + F.col(f"n{b}")
    return (F.lit(share[1]) * most >= F.lit(share[0]) * (both - most)) & (apart <= DRAWN - least_agreement(share))


def leaves(walks: DataFrame) -> DataFrame:
    """key, size and node: members of the leaves of all trees, from (node, walk: keys of one tree). Nodes of one document are none."""
    found = []
    for level in range(STEP, LEVELS + 1, STEP):
        keyed = walks.select("node", "walk", F.col("walk")[0].alias("key"))
        sizes = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
        last = level == LEVELS
        found.append(keyed.join(sizes if last else sizes.filter(F.col("size") <= SMALL), "key").select("key", "size", "node"))
        large = sizes.filter(F.col("size") > SMALL)
        if last or large.isEmpty():
            break
        walks = checkpoint(keyed.join(large, "key", "left_semi").select("node", F.slice("walk", 2, LEVELS).alias("walk")))
        del keyed, sizes, large
        free_shuffles(walks.sparkSession)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return checkpoint(out)


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    common, both = F.size(F.array_intersect("ta", "tb")).cast("long"), F.size("ta") + F.size("tb")
    return pairs.join(x, "a").join(y, "b").filter(F.lit(share[1]) * common >= F.lit(share[0]) * (both - common)).select("a", "b")


def _told(pairs: DataFrame, drawn: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda s: drawn.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "open", "sketch")])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link("_a", "_b", share)).select("a", "b")


def _to_centres(members: DataFrame) -> DataFrame:
    """Each member (a) of a leaf with the leaf's most central one (b) and its central."""
    centres = members.groupBy("key").agg(F.max(F.struct("central", "node")).alias("centre")).select("key", "centre")
    return members.join(centres, "key").filter("node <> centre.node").select(F.col("node").alias("a"), F.col("centre.node").alias("b"), "centre.central").distinct()


def _most_central(to_centres: DataFrame) -> DataFrame:
    """Of each document's pairs with centres those with the FIRST most central ones. Members of a large group have these in common."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("central", "b")), asc=False), 1, FIRST)  # of one pair for each tree at most
    return to_centres.groupBy("a").agg(first.alias("first")).select("a", F.explode("first").alias("x")).select("a", "x.b")


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of leaves that hold several components, with root and main: that of the leaf's most central member."""
    rows = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("central", "node", "root")).alias("centre")).filter("lo <> hi")
    return checkpoint(rows.join(mixed.select("key", F.col("centre.root").alias("main"), F.col("centre.node").alias("centre")), "key").select("key", "size", "node", "root", "main", "centre"))


def _across(rows: DataFrame, drawn: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of members of a leaf that may link and lie in different components, one of them outside that of the leaf's most central member.

    A leaf is cut into blocks of about BLOCK members; members outside the central component meet each block, in its own task. Pairs that meet in leaves of
    several trees are put out in the first of these alone.
    """
    places = rows.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("places"))  # one for each tree at most
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = rows.join(drawn.drop("central").join(places, "node"), "node")
    kept = ("node", "n", "open", "root", "sketch", "places")
    named = lambda s: [F.col(c).alias(f"{c}{s}") for c in kept]
    x = rows.filter("root <> main").select("key", "main", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *named("_a"))
    y = rows.select("key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), *named("_b"))
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
    first = F.when(may_link("_a", "_b", share), F.array_min(F.array_intersect("places_a", "places_b")) == F.col("key"))
    met = x.join(y, ["key", "block"]).filter(once & first)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, root) after further links (a, b): only what they join of the components is gone through again."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = checkpoint(ends.filter("a <> b").distinct())
    if between.isEmpty():
        return labels
    more = components(between)
    known = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpoint(known.union(more.join(labels.select("node"), "node", "left_anti").select("node", "root")))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (that one).

    A share below that of COMPANY's and the trees' recall (see above) needs more trees; at 0.8 a link is missed in 8e-6 of cases by the
    deepest leaves, and 2e-4 by COMPANY.
    """
    spark = docs.sparkSession
    signed = checkpoint(first_nodes(docs, words))
    filled = signed.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = checkpoint(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")))
    visits = nodes.select("node", F.explode("keys").alias("key"))
    met = checkpoint(visits.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    company = visits.join(met, "key").groupBy("node").agg(F.count("*").alias("nodes"), F.sum("size").alias("central")).filter(F.col("nodes") >= COMPANY[1])
    active = checkpoint(company.join(nodes, "node").select("node", F.col("first").alias("doc_id"), "central"))
    del visits, met, company
    free_shuffles(spark)

    # active documents are sent to all tasks only if they are few, else their texts meet them in a shuffle
    n_active = active.count()
    texts = docs.select("doc_id", "text").join(F.broadcast(active) if n_active <= BROADCAST_ROWS else active, "doc_id")
    sets = checkpoint(whole_sets(texts, words))
    if sets.count() > n_active:  # rows alike under one id
        sets = checkpoint(sets.dropDuplicates(["node"]))
    sets = checkpoint(with_company(sets, share))
    free_shuffles(spark)
    drawn = checkpoint(all_nodes(sets))
    steps = LEVELS // STEP
    walks = drawn.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("keys", t * steps + 1, F.lit(steps)))).alias("walk"))
    slim = drawn.drop("keys")
    members = checkpoint(leaves(walks).join(slim.select("node", "central"), "node"))
    free_shuffles(spark)
    labels = components(confirmed(checkpoint(_told(_most_central(_to_centres(members)), slim, share)), sets, share))
    free_shuffles(spark)
    outside = _outside(members, labels).filter("root <> main AND node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    labels = _joined(labels, confirmed(checkpoint(_told(outside, slim, share)), sets, share))
    free_shuffles(spark)
    labels = _joined(labels, confirmed(checkpoint(_across(_outside(members, labels), slim, share)), sets, share))
    free_shuffles(spark)

    rooted = checkpoint(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("component")))
    by_node = checkpoint(rooted.join(least, "root").select("node", "component"))
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = signed.select("doc_id", "node", "n").join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM cut
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * met.shared >= 85 * (p.n + q.n - met.shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS seen FROM ways UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
