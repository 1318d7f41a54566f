"""Recall against brute force, hot vectors, edge cases."""

import numpy as np

from timelens.llm import nn_search as nn


def brute(good, queries, k=10):
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - np.array(good[q], np.float64)) ** 2).sum(1))
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in sorted(nn.query(spark, str(tmp_path)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return got


def test_recall_and_hot_vector(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    vectors = {i: [float(np.float32(v)) for v in centres[i % 8] + 0.5 * rng.normal(size=24)] for i in range(2500)}
    vectors |= {i: vectors[100] for i in range(3000, 3700)}
    bad = [(None, vectors[1], "x"), (9000, None, "x"), (9100, [0.0] * 24, "x"), (9200, [float("nan")] + [1.0] * 23, "x"), (9300, [None] + [1.0] * 23, "x"), (9400, [float("inf")] + [1.0] * 23, "x"), (9500, [1.0, 2.0], "x"), (9600, [], "x")]
    rows = [(i, v, "x") for i, v in vectors.items()]
    got = run(spark, tmp_path, [*rows, *bad])
    want = brute(vectors, [i for i in vectors if i % 100 == 0])
    assert got.keys() == want.keys()
    found = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    for q in want:
        assert [r for _, _, r in got[q]] == list(range(1, 11))
        assert all(abs(s - float(np.sqrt(((np.array(vectors[q]) - np.array(vectors[v])) ** 2).sum()))) < 1e-9 for v, s, _ in got[q])
        if vectors[q] == vectors[100]:
            assert [v for v, _, _ in got[q]] == [v for v, _ in want[q]]


def test_small_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == {}
    assert run(spark, tmp_path / "b", [(100, [1.0], "x")]) == {}
    got = run(spark, tmp_path / "c", [(i, [float(i + 1)], "x") for i in (0, 1, 2, 100)])
    assert [v for v, _, _ in got[0]] == [1, 2, 100] and [v for v, _, _ in got[100]] == [2, 1, 0]


def test_lengths_and_repeated_ids(spark, tmp_path):
    """Each length is a space of its own; rows with one id are rows of their own, as queries and as candidates."""
    rows = [(0, [0.0, 1.0], "x"), (1, [0.0, 2.0], "x"), (2, [0.0, 4.0], "x"), (100, [1.0, 0.0, 0.0], "x"), (3, [3.0, 0.0, 0.0], "x"), (200, [0.0, 9.0], "x"), (200, [0.0, 9.0], "x"), (200, [0.0, 7.0], "x")]
    got = run(spark, tmp_path, rows)
    assert [v for v, _, _ in got[100]] == [3] and [v for v, _, _ in got[0]] == [1, 2, 200, 200, 200]
    # its two equal rows have each other, the third row with its id, then 2, 1, 0; the third has both
    assert sorted((v, r) for v, _, r in got[200]) == sorted([(200, 1), (200, 2), (2, 3), (1, 4), (0, 5)] * 2 + [(200, 1), (200, 2), (2, 3), (1, 4), (0, 5)])


def test_doubles_are_scored_as_they_are(spark, tmp_path):
    vectors = {i: [1.0 + i * 1e-9, 1.0] for i in range(5)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r["vec_id"], r["score"]) for r in nn.query(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(v, s) for v, s in brute(vectors, [0])[0]]


def test_small_parts_of_the_graph_are_completed(spark, tmp_path, monkeypatch):
    """Without rounds, blocks of few nodes are parts of their own: ten rows are found all the same, and they are the nearest."""
    for name, value in (("TREES", 1), ("LEAF", 8), ("ROUNDS", 0), ("RECALL", 0.0), ("BLOCK", 3)):
        monkeypatch.setattr(nn, name, value)
    x = np.random.default_rng(8).normal(size=(900, 6)).astype(np.float32)
    vectors = {i: [float(v) for v in x[i]] for i in range(900)}
    got, want = run(spark, tmp_path, [(i, v, "x") for i, v in vectors.items()]), brute(vectors, range(0, 900, 100))
    assert all(len(got[q]) == 10 for q in want)
    assert sum([v for v, _, _ in got[q]] == [v for v, _ in want[q]] for q in want) >= 5


def test_recall_with_a_narrow_first_beam(spark, tmp_path, monkeypatch):
    """A poor graph and a beam of a fifteenth of the rows, as a fixed beam is on a large table: the search widens until recall is reached."""
    for name, value in (("TREES", 2), ("LEAF", 40), ("ROUNDS", 0), ("BEAM", 100)):
        monkeypatch.setattr(nn, name, value)
    x = np.random.default_rng(3).normal(size=(1500, 64)).astype(np.float32)
    vectors = {i: [float(v) for v in x[i]] for i in range(1500)}
    got = run(spark, tmp_path, [(i, v, "x") for i, v in vectors.items()])
    want = brute(vectors, [i for i in vectors if i % 100 == 0])
    recall = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.95, recall


def test_one_very_long_vector(spark, tmp_path):
    """It must not cost the others their digits."""
    x = np.random.default_rng(12).normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700] *= 1e8
    vectors = {i: [float(v) for v in x[i].astype(np.float32)] for i in range(1500)}
    got = run(spark, tmp_path, [(i, v, "x") for i, v in vectors.items()])
    want = brute(vectors, [i for i in vectors if i % 100 == 0])
    recall = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.95 and all(len(got[q]) == 10 for q in want), recall


def test_recall_over_shards_without_codes_along_edges(spark, tmp_path, monkeypatch):
    """Shards of their own find the nearest of all, and the graph's edges ship no vectors: rows of a join or a group were 64 for each node and round."""
    for name, value in (("LEAST", 300), ("LEAF", 60)):
        monkeypatch.setattr(nn, name, value)
    x = np.random.default_rng(5).normal(size=(2400, 32)).astype(np.float32)
    vectors = {i: [float(v) for v in x[i]] for i in range(2400)}
    made, build = [], nn.build_graph
    monkeypatch.setattr(nn, "build_graph", lambda *a: made.append(build(*a)) or made[0])
    got = run(spark, tmp_path, [(i, v, "x") for i, v in vectors.items()])
    want = brute(vectors, [i for i in vectors if i % 100 == 0])
    recall = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    index, shards = made[0]
    assert recall >= 0.95 and shards == 8, (recall, shards)
    assert index.count() == 2400 and index.select("shard").distinct().count() == 8


def test_codes_keep_each_vectors_digits():
    import pyarrow as pa

    x = np.array([[1.0, -2.0, 0.5], [1e8, 1.0, -3e7], [1e-20, 2e-20, 0.0], [0.0, 0.0, 0.0], [1e30, -1e30, 2e30]])
    code = nn.coded(x)
    back = nn.unpacked(pa.array(code, pa.binary()), 3)
    assert np.allclose(back, x, rtol=1e-3, atol=0) or np.all(np.abs(back - x) <= np.abs(x).max(axis=1, keepdims=True) * 1e-3)
