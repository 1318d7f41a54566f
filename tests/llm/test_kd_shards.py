"""Shards: balance, whole groups, gapless slots."""

import random
import zlib
from collections import defaultdict

from timelens.llm import kd_shards


def place_all(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    return kd_shards.query(spark, str(tmp_path)).collect()


def check(rows, docs, slack):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in docs)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(size.values()) <= mean * (1 + slack) and min(size.values()) >= mean * (1 - slack)


def test_balance_and_groups(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, rng.choice("aéz") * rng.randint(1, 900) + str(i), "x") for i in range(6000)]
    docs += [(10_000 + i, docs[i][1], "x") for i in range(40)] + [(None, None, "x"), (None, None, "x"), (20_000, "", "x")]
    rows = place_all(spark, tmp_path, docs)
    check(rows, docs, 0.03)
    where = {r["doc_id"]: r["shard"] for r in rows}
    assert all(where[i] == where[10_000 + i] for i in range(40))


def test_heavy_group_is_split(spark, tmp_path):
    docs = [(i, "same text" * 20, "x") for i in range(4000)] + [(5000 + i, f"other {i} " * (i % 40), "x") for i in range(4000)]
    check(place_all(spark, tmp_path, docs), docs, 0.05)


def test_small_tables(spark, tmp_path):
    assert place_all(spark, tmp_path / "a", []) == []
    rows = place_all(spark, tmp_path / "b", [(1, "a", "x"), (1, "a", "x")])
    assert len(rows) == 2 and {r["slot"] for r in rows} <= {0, 1}


def test_repeated_rows_are_split(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    docs = [(i, rng.choice("aéz") * rng.randint(100, 300) + str(i), "x") for i in range(3000)] + [(7, "same " * 40, "x")] * 1500
    check(place_all(spark, tmp_path / "a", docs), docs, 0.05)
    docs = [(None, None, "x")] * 2000 + [(i, f"{i} text", "x") for i in range(1000)]
    monkeypatch.setattr(kd_shards, "COPIES", 300)
    check(place_all(spark, tmp_path / "b", docs), docs, 0.05)


def test_a_very_long_text(spark, tmp_path):
    docs = [(i, "word " * 50, "x") for i in range(200)] + [(999, "long text " * 500_000, "x")]
    rows = place_all(spark, tmp_path, docs)
    assert len(rows) == 201 and max(r["size"] for r in rows) == 5_000_008
    alone = next(r["shard"] for r in rows if r["doc_id"] == 999)
    assert sum(r["shard"] == alone for r in rows) < 201
