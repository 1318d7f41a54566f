"""The prefix trie against a brute-force version; nulls, ties, repeats, long and turnless conversations."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.llm import prefix_trie as pt


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(prefix))
        children = sum(len(p) == len(prefix) + 1 for p in below)
        out.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = pt.query(spark, str(tmp_path)).collect()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found), key=str)


def test_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), "user" if t % 2 == 0 else "assistant", str(rng.choice(["a", "bé", "c" * 9]))) for c in range(-12, 40) for t in range(int(rng.integers(1, 14))) if c % 7]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "z", "a"), (1, 0, "z", "b"), (1, 0, "z", "b"), (None, 0, "user", "x"), (6, 0, "user", "x"), (11, 0, "user", "x"), (16, 3, "user", "x")]
    rows += [(c, t, "user", "same") for c in (20, 21, 22, 23, 24, 25, 30) for t in range(3)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_long_conversations_run_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 8)
    rows = [(5, t, "user", f"t{t % 50}") for t in range(60)] + [(6, t, "user", f"t{t % 50}") for t in range(40)] + [(c, t, "user", f"t{t}") for c in (7, 8, 10) for t in range(12)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_many_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "HOT", 10)
    rows = [(5 * c, t, "user", "first" if t == 0 else f"{c % 3}") for c in range(60) for t in range(3)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_light_steps_are_few(spark):
    # a conversation that leaves the common way at every turn
    rows = [(5 * c, t, "user", "go" if t < c else f"off {c}") for c in range(20) for t in range(21)]
    turns = pt.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = turns.withColumnRenamed("conv_id", "conv").withColumnRenamed("pos", "depth")
    nodes, _ = pt.placed_nodes(pt.prefixes(whole.groupBy("conv").agg(F.count("*").alias("size")), whole))
    assert nodes.agg(F.max("level")).first()[0] == 1


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_empty(spark, tmp_path, rows):
    assert got(spark, rows, tmp_path) == []
