"""The pipeline: what each stage keeps and changes."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SYLLABLES = {"en": ["the", "and", "ing", "er"], "de": ["sch", "ung", "ein", "ber"]}


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(words(rng, lang := rng.choice(["en", "de"]), 60)), lang, "s", 0) for i in range(60)]
    item = words(rng, "en", 30)
    docs += [(100 + i, docs[i][1], docs[i][2], "s", 0) for i in range(3)]
    docs += [(200, " ".join(words(rng, "en", 40) + item + words(rng, "en", 40)), "en", "s", 0), (201, " ".join(words(rng, "en", 50)) + " a@b.co", "en", "s", 0)]
    docs += [(300, None, "en", "s", 0), (301, "12 34", "en", "s", 0), (None, " ".join(words(rng, "de", 60)), "de", "s", 0)]
    docs = [(a, t, lang, s, len(t or "")) for a, t, lang, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen[name] = frame.collect()
        if name != "bpe":
            assert frame.columns == corpus_pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    every = {d[0] for d in docs}
    assert ids["language_id"] == every - {300, 301}
    assert ids["jaccard_join"] == ids["language_id"] - {100, 101, 102}
    assert ids["decontaminate"] == ids["jaccard_join"] - {200}
    assert ids["pii"] == ids["bpe"] == ids["decontaminate"]
    redacted = {r["doc_id"]: r for r in seen["pii"]}[201]
    assert redacted["text"].endswith("<EMAIL>") and redacted["n_chars"] == len(redacted["text"])
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "pii", "bpe"]
