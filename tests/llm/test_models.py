"""Quality and language: held-out accuracy, edge cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from timelens.llm import language_id, quality
from timelens.llm.common import bounded_sample, bucket_of

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["eau", "oi", "ais", "eux"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(4)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 120)), lang, "x") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_held_out(spark, tmp_path):
    rows = corpus() + [(900, None, None, "x"), (901, "", "aa", "x"), (902, "12 34 !!", None, "x"), (902, "12 34 !!", None, "x"), (904, "½", None, "x"), (905, "² 12 Ⅷ ①", None, "x"), (906, "_ ٣ _", None, "x"), (None, "kalo mita", None, "x"), (903, "kalo " * 30_000, None, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = language_id.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and by[r[0]]["held_out"]]
    assert held and sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 904, 905, 906))
    assert by[None]["lang_pred"] == "aa" and by[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)


def test_language_switches(spark):
    rng = random.Random(9)
    field = language_id.fit(spark.createDataFrame(corpus(), SCHEMA).filter(bucket_of("doc_id", 4) != 2))
    first, second = text(rng, "aa", 20), text(rng, "bb", 20)
    labels = [lang for _, lang in language_id.label_words(field, f"{first} {second}")]
    assert labels[:18] == ["aa"] * 18 and labels[-18:] == ["bb"] * 18
    assert field.moves.argmax(axis=1).tolist() == [0, 1, 2]


def brute_force_marginals(emissions, moves):
    """By summing over all label sequences."""
    n, k = emissions.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = math.exp(sum(emissions[t, path[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for t, label in enumerate(path):
            out[t, label] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_match_brute_force(monkeypatch):
    """Chains of several pieces are labelled as one."""
    rng = np.random.default_rng(5)
    for piece in (1, 2, 3, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        counts = np.array([7, 1, 2, 5, 8, 3])
        emissions, moves = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32), rng.normal(0, 2, (3, 3)).astype(np.float32)
        got, at = language_id.word_marginals(emissions, moves, counts), 0
        for n in counts:
            assert np.allclose(got[at : at + n], brute_force_marginals(emissions[at : at + n], moves), atol=1e-5)
            at += n


def test_a_far_word_reaches_over_pieces():
    """With strong transitions, one clear word decides for a long chain of undecided ones."""
    emissions = np.zeros((1000, 2), np.float32)
    emissions[999] = (0, 30)
    moves = np.array([[15, -15], [-15, 15]], np.float32)
    assert language_id.word_marginals(emissions, moves, np.array([1000])).argmax(axis=1).tolist() == [1] * 1000


def test_language_labels_by_slices_and_bounded_words(monkeypatch, spark):
    field = language_id.fit(spark.createDataFrame(corpus(), SCHEMA))
    texts = [r[1] for r in corpus()] + ["", "12"]
    whole = language_id.label_texts(field, texts)
    monkeypatch.setattr(language_id, "KEPT_WORDS", 3)
    monkeypatch.setattr(language_id, "FRESH", 7)
    labeller = language_id.Labeller(field)
    few = [x for i in range(0, len(texts), 9) for x in labeller.label_texts(texts[i : i + 9])]
    assert [x[0] for x in few] == [x[0] for x in whole] and np.allclose([x[1] for x in few], [x[1] for x in whole], atol=1e-5)


def test_predict_replaces_clashing_columns(spark):
    field = language_id.fit(spark.createDataFrame(corpus(), SCHEMA))
    got = language_id.predict(spark.createDataFrame([(1, "kalo mita", "old", "x")], "doc_id long, text string, lang_pred string, score string"), field)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.first()["lang_pred"] == "aa"


def test_sample_is_bounded_with_repeated_and_null_ids(spark):
    rows = [(None, f"t{i}", "a") for i in range(300)] + [(1, "same", "b")] * 500 + [(2, f"u{i}", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bounded_sample(df, "lang", "doc_id", 40, ["lang", "text"])
    by = Counter(r["lang"] for r in got)
    assert by["a"] == 40 and 20 <= by["b"] <= 40 and len({(r["lang"], r["text"]) for r in got}) == len(got)
    assert got == bounded_sample(df.repartition(5), "lang", "doc_id", 40, ["lang", "text"])


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, "x")], SCHEMA)
    assert language_id.fit(df) is None
    assert language_id.predict(df.select("doc_id", "text"), None).first()["lang_pred"] == "und"
    assert language_id.predict(df.limit(0), None).count() == 0


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = text(rng, "aa" if good else "bb", rng.randint(10, 300))
        docs.append((i, words if good else words.upper() + "!!", "x"))
        labels.append((i, int(good), 0))
    docs += [(900, None, "x"), (901, "", "x"), (None, "kalo", "x"), (902, "kami " * 50_000, "x")]
    labels += [(None, 1, 0), (5, None, 0), (10_000, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.query(spark, str(tmp_path)).collect()
    by, truth = {r["doc_id"]: r for r in got}, {r[0]: r[1] for r in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(got) == len(docs) and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert by[900]["score"] == by[901]["score"] and all(0 <= r["score"] <= 1 for r in got)


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    assert quality.score(docs.limit(0), {"share": 0.5}).select(F.count("*")).first()[0] == 0
