"""Importance resampling against a brute-force version; chunks, nulls, ties, repeated and long rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from timelens.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, text in docs for f in features(text)[1]), Counter(bucket(f) for text in target for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out, drawable = [], []
    for at, (doc_id, text) in enumerate(docs):
        n_words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= 20:
            drawable.append(at)
    drawable.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for rank, i in enumerate(drawable[: 5 * len(drawable) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def some_docs():
    rng = np.random.default_rng(7)
    vocabulary = [*"abcdefghij", "É", "Zürich", "漢字", "x1", "99"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60))) + rng.choice(["", "!", "  A-B\n\tc_d"])) for i in range(150)]
    return docs + [(150, None), (151, ""), (152, "?! \n"), (None, " ".join(vocabulary * 3)), (3, docs[3][1]), (3, docs[3][1]), (3, "other " * 30), (None, " ".join(vocabulary * 3))]


def test_matches_brute_force(spark):
    docs, target = some_docs(), ["a b c Zürich", None, "漢字 99 x1 " * 5]
    df = spark.createDataFrame([(t, i, "more") for i, t in docs], "text string, doc_id long, rank string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert collected(ir.resample(df, bench)) == brute(docs, target)


def test_long_texts_are_cut_and_summed(spark, monkeypatch):
    monkeypatch.setattr(ir, "CHUNK", 100)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join("w" * int(k) + str(int(k)) for k in rng.integers(1, 9, n))) for i, n in enumerate([5, 40, 41, 400, 3000])]
    docs += [(9, "x" * 5000), (10, "x" * 500 + " y " + "é" * 700 + " z"), (3, docs[3][1]), (11, "!" * 1000), (None, docs[4][1]), (None, docs[4][1])]
    bench = spark.createDataFrame([("w1 ww2",)], "text string")
    assert collected(ir.resample(spark.createDataFrame(docs, "doc_id long, text string"), bench)) == brute(docs, ["w1 ww2"])


def test_chunks_own_each_start_once():
    text = "Ab cd, ef! " * 40_000 + "end"
    parts = list(ir.chunked(text))
    assert len(parts) > 4 and sum(owned for _, owned in parts) == 120_001
    whole = ir.words_of(text)
    at = 0
    for chunk, owned in parts:
        words = chunk.split()
        assert words == whole[at : at + len(words)] and len(words) in (owned + 2, min(owned + 2, len(whole) - at))
        at += owned


@pytest.mark.parametrize("a, b", [(b"", b"x"), (b"abc", b""), (b"abc", b"d" * 70_001), ("é".encode(), b"\0\0")])
def test_joined_crc(a, b):
    got = ir.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)], np.int64))
    assert got[0] == zlib.crc32(a + b)


def test_equal_scores_have_ranks_of_their_own(spark):
    docs = [(5, "a b c d e " * 5)] * 300 + [(6, "f " * 30)] * 100
    got = ir.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("a b",)], "text string"), percent=50)
    assert sorted(r["rank"] for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 201))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([("a b",)], "text string")
    assert ir.resample(none, bench).collect() == []
    docs = [(1, "a b c " * 10), (2, None)]
    assert collected(ir.resample(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0), percent=100))[0][0] == 1
    assert collected(ir.resample(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0))) == brute(docs, [])
