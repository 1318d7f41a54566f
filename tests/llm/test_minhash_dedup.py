"""Chosen-path near-duplicates against a brute-force version; groups of copies, nulls, repeats, long texts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from timelens.llm import minhash_dedup as md


def sets_of(text, words=5):
    found = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split() if w]
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(docs, share=(85, 100), words=5):
    sets = [sets_of(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a_id, _) in enumerate(docs):
        for j in range(i):
            if a_id is not None and docs[j][0] is not None and sets[i] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), None if d is None else least[top(i)], None if d is None else least[top(i)] == d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def got(spark, docs, **more):
    df = spark.createDataFrame([(t, d, "x") for d, t in docs], "text string, doc_id long, node string")
    return sorted(map(tuple, md.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    docs, passage = [], word(60)
    for _ in range(40):
        own = word(int(rng.integers(6, 200)))
        docs.append(own)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(own)
            for at in rng.integers(0, len(copy), max(1, len(copy) // int(rng.integers(20, 120)))):
                copy[at] = "edited"
            docs.append(copy)
    docs += [word(40) + passage + word(40) for _ in range(30)]
    group = word(150)
    for _ in range(150):
        copy = list(group)
        for at in rng.integers(0, 150, 2):
            copy[at] = f"own{rng.integers(0, 10**9)}"
        docs.append(copy)
    texts = [" ".join(d) for d in docs]
    return list(enumerate(texts)) + [(len(texts) + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "a b c", "A  b\tc", texts[0], texts[0].upper()])]


def test_matches_brute_force(spark):
    docs = corpus()
    assert got(spark, docs) == brute(docs)


def test_small_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(md, "SMALL", 8)
    monkeypatch.setattr(md, "BLOCK", 16)
    docs = corpus(2)
    assert got(spark, docs) == brute(docs)


def test_strays_of_a_large_group_are_not_walked(spark, monkeypatch):
    """A set that has over 15 % of its tokens alone can't link; in a large group such strays made walks in all trees, and pairs with all members."""
    rng = np.random.default_rng(9)
    group = [f"w{k}" for k in rng.integers(0, 5000, 150)]
    docs = []
    for i in range(240):
        copy = list(group)
        for at in rng.choice(150, 1 + i % 12, replace=False):
            copy[at] = f"own{rng.integers(0, 10**9)}"
        docs.append((i, " ".join(copy)))
    sets, walked = [sets_of(t) for _, t in docs], []
    held = Counter(x for s in sets for x in s)
    able = sum(100 * sum(held[x] > 1 for x in s) >= 85 * len(s) for s in sets)
    drawn = md.all_nodes
    monkeypatch.setattr(md, "all_nodes", lambda rows: walked.append(rows.count()) or drawn(rows))
    assert got(spark, docs) == brute(docs)
    assert walked[0] <= able < 200


def test_repeated_ids_and_rows(spark):
    docs = corpus(3)[:60]
    docs += [docs[0], docs[0], (docs[1][0], "another text of its own that is not like it"), (None, docs[2][1]), (None, docs[2][1])]
    assert got(spark, docs) == brute(docs)


def test_a_very_long_text(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 100_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-500], "end"])), (3, " ".join(words[:50_000]))]
    assert [r[2] for r in got(spark, docs)] == [1, 1, 3]


def test_recall_by_trees():
    # two sets of similarity 0.85 meet in a leaf of the last level of one of the trees
    assert (1 - 0.85**md.LEVELS) ** md.TREES < 1e-6


def test_minwise_tokens_estimate_similarity():
    rng = np.random.default_rng(6)
    agreed, unlike = [], []
    for _ in range(40):
        both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (340, 30, 30))
        x, y = md.minwise(np.concatenate([both, a]), md.DRAWN), md.minwise(np.concatenate([both, b]), md.DRAWN)
        agreed.append((x == y).mean())
        one, two = np.split(md.sketch(x) ^ md.sketch(y), 2)
        unlike.append(sum(int(v).bit_count() for v in one | two))
    assert abs(np.mean(agreed) - 0.85) < 0.01 and abs(np.mean(unlike) / md.DRAWN - 0.15 * 0.75) < 0.01
    assert max(unlike) <= md.DRAWN - md.least_agreement((85, 100))


def test_empty_table(spark):
    assert md.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert md.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).filter(F.col("kept")).count() == 1
