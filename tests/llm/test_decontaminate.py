"""Leaks against brute force, edited passages, edge cases."""

import math
import random
from collections import Counter

import numpy as np

from timelens.llm import decontaminate as dc


def words(rng, n):
    return ["".join(rng.choice(["ka", "lo", "mi", "ta", "re", "un"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_leaks(spark, tmp_path):
    rng = random.Random(2)
    items = [words(rng, rng.randint(14, 60)) for _ in range(30)]
    docs, planted = [], set()
    for i in range(200):
        body = words(rng, rng.randint(0, 300))
        if i % 5 == 0:
            k = rng.randrange(30)
            leak = list(items[k])
            if i % 10 == 0:  # a paraphrase: words dropped and exchanged
                for _ in range(len(leak) // 6):
                    leak[rng.randrange(len(leak) // 2)] = rng.choice(words(rng, 3))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() for w in leak] if i % 15 == 0 else leak
            planted.add((i, k))
        docs.append((i, " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, " ".join(items[0]), "x"), (902, "the " * 100_000 + " ".join(items[1]), "x"), (0, docs[0][1], "x")]
    bench = [(i, ", ".join(w) + ".") for i, w in enumerate(items)] + [(77, None), (78, ""), (79, "!!")]
    spark.createDataFrame(docs, "doc_id long, text string, leaks string").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r["doc_id"], r["item_id"]) for r in dc.query(spark, str(tmp_path)).collect()]
    assert planted | {(None, 0), (902, 1)} == set(got)
    assert got.count((0, [k for d, k in planted if d == 0][0])) == 2


def plain_leaks(docs, bench):
    """(row, item) of all leaks by trying every window of every document against every passage: exact cosines, no keys, no latent space."""
    cut = [dc.words_of(t) for t in docs]
    df = Counter(w for ws in cut for w in set(ws))
    idf = lambda w: math.log1p(len(docs) / (1 + df[w]))
    passages = [(item, dc.words_of(t), dc.answer_of(t)) for item, t in bench]
    known = {w for _, ws, _ in passages for w in ws}
    out = set()
    for d, ws in enumerate(cut):
        for item, p, k in passages:
            n, weights = len(p), np.array([idf(w) for w in p])
            tf = Counter(p)
            norm = math.sqrt(sum((c * idf(w)) ** 2 for w, c in tf.items()))
            spans = [math.sqrt(sum(idf(w) ** 2 for w in p[a : a + 2 * dc.STRIDE])) for a in range(0, n, 2 * dc.STRIDE)]
            least = min(dc.COSINE, dc.PARAPHRASE * math.sqrt(sum(idf(w) ** 2 for w in p)) / sum(spans))
            for a in range(0, len(ws), dc.STRIDE):
                window = Counter(w for w in ws[a : a + 2 * dc.STRIDE] if w in known)
                size = math.sqrt(sum((c * idf(w)) ** 2 for w, c in window.items()))
                if not size or sum(c * tf[w] * idf(w) ** 2 for w, c in window.items()) / (size * norm) < least:
                    continue
                around = ws[max(0, a - n) : a + 2 * dc.STRIDE + n]
                share = dc.weighted_lcs(p, around, weights) / weights.sum()
                if share >= dc.SHARE or (share >= dc.PARAPHRASE and dc.weighted_lcs(p[n - k :], around, weights[n - k :]) >= dc.ANSWER * weights[n - k :].sum()):
                    out.add((d, item))
                    break
    return out


def test_matches_trying_everything(spark, monkeypatch):
    """Neither the keys nor a space of few dimensions lose a leak that trying every window finds."""
    rng = random.Random(17)
    items = [words(rng, rng.randint(3, 40)) for _ in range(40)]
    docs = []
    for i in range(120):
        body = words(rng, rng.randint(0, 80))
        if i % 2:
            leak = [w for w in rng.choice(items) if rng.random() < rng.choice([0.5, 0.7, 0.9, 1.0])]
            body[len(body) // 2 : len(body) // 2] = leak
        docs.append(" ".join(body))
    bench = [(i, " ".join(w[:-3]) + ". " + " ".join(w[-3:])) for i, w in enumerate(items)]
    wanted = plain_leaks(docs, bench)
    assert len(wanted) > 20
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for rank, group in ((128, 1_000_000), (4, 1_000_000), (16, 300)):
        monkeypatch.setattr(dc, "RANK", rank)
        monkeypatch.setattr(dc, "OVERSAMPLE", 4)
        monkeypatch.setattr(dc, "GROUP_WORDS", group)
        rows = dc.find_leaks(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()
        got = {(r["doc_id"], x["item_id"]) for r in rows for x in r["leaks"]}
        assert wanted <= got
        # nearby windows of a long passage share one look around them, which may hold a little more
        assert len(got - wanted) <= 1


def test_document_frequencies_are_exact(spark):
    docs = spark.createDataFrame([("A b, b",), ("b c",), (None,), ("",), ("d",)], "text string").repartition(3)
    assert dc.document_frequencies(docs, frozenset([b"a", b"b", b"x"])) == (5, {b"a": 1, b"b": 2})


def test_many_and_long_passages(spark):
    """Verbatim passages are all found where there are many more than a latent space's dimensions, and where one is much longer than a window."""
    rng = random.Random(11)
    rare = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    items = [rare(20) for _ in range(1000)] + [rare(n) for n in (900, 1200, 3000, 20_000)]
    chosen = [*range(0, 1000, 10), *range(1000, 1004)]
    docs = [(k, " ".join(rare(rng.randint(20, 90)) + items[k] + rare(60))) for k in chosen]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    missed = [r["doc_id"] for r in rows if r["doc_id"] not in [x["item_id"] for x in r["leaks"]]]
    assert len(rows) == len(chosen) and missed == []


def test_weighted_lcs():
    rng = random.Random(7)

    def brute(a, b, w):
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + w[i] if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        weights = {c: rng.random() for c in "abcd"}
        w = np.array([weights[c] for c in a])
        assert abs(dc.weighted_lcs(a, b, w) - brute(a, b, w)) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "old")], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.find_leaks(docs.limit(0), bench).count() == 0
    assert dc.find_leaks(docs, bench.limit(0)).first()["leaks"] == []
    clash = dc.find_leaks(docs, bench)
    assert clash.columns == ["doc_id", "text", "leaks"] and clash.first()["leaks"][0]["item_id"] == 1
