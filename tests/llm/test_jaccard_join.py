"""Components against brute force over all pairs."""

import random
import re

from timelens.llm import jaccard_join as jj

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(12):  # families: copies, near copies and copies of those
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 20, 60, 150]))]
        family = [base]
        for _ in range(rng.randint(1, 14)):
            family.append(edited(rng, rng.choice(family), rng.randint(0, max(1, len(base) // 40))))
        texts += family
    for _ in range(60):  # strangers that share a passage
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] + passage)
    hot = [rng.choice(vocabulary) for _ in range(120)]
    texts += [edited(rng, hot, rng.randint(0, 6)) for _ in range(120)]
    rows = [(i, " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w), "x") for i, w in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, " \n", "x"), (9003, "one two", "x"), (9004, "ONE two", "x"), (9005, "É a", "x"), (9006, "é a", "x")]
    long = [f"u{i % 40_000}" for i in range(120_000)]
    rows += [(9010, " ".join(long), "x"), (9011, " ".join(edited(rng, long, 300)), "x")]
    return [*rows, rows[0], rows[0], (None, rows[0][1], "x"), (None, None, "x")]


def test_components(spark, tmp_path):
    for seed in (1, 2):
        rows = corpus(seed)
        spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3).write.parquet(str(tmp_path / f"{seed}/documents.parquet"))
        got = jj.query(spark, str(tmp_path / str(seed))).collect()
        want = brute(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r["component_id"] is None) if r["doc_id"] is None else ((r["n_shingles"], r["component_id"]) == want[r["doc_id"]]), r


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert jj.query(spark, str(tmp_path)).collect() == []


def test_one_of_each_component(spark):
    """Different texts under one id are judged by themselves; equal rows are one; the rest of a component goes."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (2, a, "x"), (3, a + " more", "x"), (7, b, "x"), (7, c, "y"), (7, b, "x"), (8, c, "x"), (9, d, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (None, a, "x")]
    got = sorted(map(tuple, jj.one_of_each_component(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()), key=str)
    assert got == sorted([(1, a, "x"), (7, b, "x"), (7, c, "y"), (9, d, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (None, a, "x")], key=str)
    plain = spark.createDataFrame([r for r in rows if r[0] not in (5, 7)], "doc_id long, text string, node string")
    assert sorted(r["doc_id"] or 0 for r in jj.one_of_each_component(plain).collect()) == [0, 1, 6, 8, 9]


def test_multi_matches_lose_no_link():
    """For any order and any number of matches, linked sets share that many shingles in their prefixes."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 120)
        a = set(range(n))
        b = (a - set(rng.sample(sorted(a), rng.randint(0, n // 12)))) | set(range(1000, 1000 + rng.randint(0, n // 12)))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        order = {t: rng.random() for t in a | b}
        for m in range(1, jj.least_overlap(max(len(a), len(b))) + 1):
            first = [set(sorted(s, key=order.get)[: len(s) - jj.least_overlap(len(s)) + m]) for s in (a, b)]
            assert len(first[0] & first[1]) >= m


def test_components_of_long_chains(spark):
    edges = [(i * 7919 % 100_003, (i + 1) * 7919 % 100_003) for i in range(300)] + [(-5, -9), (4, 4)]
    got = {r["node"]: r["root"] for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[a] for a, _ in edges[:300]} | {got[edges[299][1]]}) == 1 and got[-5] == got[-9] == -9


def test_estimated_sizes_do_not_grow_with_rounds(spark, monkeypatch):
    """Each round joins the last one's frames; the product of their estimated sizes once had five times as many digits after each, all multiplied in the driver."""
    bits, kept = [], jj.checkpoint

    def seen(df):
        bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return kept(df)

    monkeypatch.setattr(jj, "checkpoint", seen)
    edges = spark.createDataFrame([(i * 7919 % 100_003, (i + 1) * 7919 % 100_003) for i in range(300)], "a long, b long")
    labels = jj.components(edges)
    assert len(bits) > 2 + 4 * 3 and max(bits) < 1000, bits
    assert labels.groupBy("root").count().collect()[0]["count"] == 301
