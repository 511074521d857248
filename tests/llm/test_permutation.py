from __future__ import annotations

import numpy as np
import pytest

from litrewise.llm import permutation


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % 50 == 0):
        cosines = unit @ unit[k]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[k]), key=lambda j: (-round(cosines[j], 12), ids[j]))[:5]
        out[int(ids[k])] = [(int(ids[j]), cosines[j]) for j in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("shard_rows", [permutation.SHARD_ROWS, 300])
def test_recall_and_scores(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(permutation, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(permutation, "QUERY_ROWS", 10)
    monkeypatch.setattr(permutation, "LEAST_RERANKED", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(1500)]
    got, want = by_query(permutation.nearest_neighbours(frame(spark, [(*r, 0) for r in rows]))), exact(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q in want:
        true = dict(want[q])
        assert all(abs(score - true[i]) < 1e-12 for i, score in got[q] if i in true)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    common = rng.standard_normal(8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(400)]
    got = by_query(permutation.nearest_neighbours(frame(spark, [(*r, 0) for r in rows])))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]
    assert [i for i, _ in got[150]] == [0, 3, 6, 9, 12]


def test_vectors_with_one_pivot_order_are_all_reranked():
    """A third of a shard are scaled copies of one vector, and a third are moved very slightly."""
    rng = np.random.default_rng(7)
    pivots = rng.standard_normal((64, 16))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    common, other = rng.standard_normal(16), rng.standard_normal(16)
    n = 2400
    matrix = rng.standard_normal((n, 16))
    ids = rng.permutation(n)
    matrix[:800] = common * 2.0 ** rng.permutation(800)[:, None].astype(float) * 2.0**-400
    matrix[800:1600] = other + 1e-9 * rng.standard_normal((800, 16))
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    places = permutation.pivot_places(unit, pivots)
    shard = permutation.Shard(ids, [v.tobytes() for v in matrix], [p.tobytes() for p in places])
    assert max(permutation.LEAST_RERANKED, permutation.RERANKED_SHARE * n) < 800
    for k in (0, 5, 400):
        got = [i for i, _ in shard.search(int(ids[k]), matrix[k], places[k])]
        assert got == sorted(int(i) for i in ids[:800] if i != ids[k])[:5]
    for k in (800, 1000, 1500):
        assert set(range(800, 1600)) <= {int(i) for e in shard.candidates(places[k]) for i in np.flatnonzero(ids == shard.ids[e][0])}


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (50, [2.0, 0.0], 0),
        (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0),
        (8, [1.0, 2.0, 3.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (100, None, 0),
    ]
    got = by_query(permutation.nearest_neighbours(frame(spark, rows)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [50, 1, 2], 50: [0, 1, 2]}


@pytest.mark.parametrize("magnitude", [1e-310, 1e-200, 1.0, 1e200, 1e308])
def test_magnitudes_do_not_matter(spark, magnitude):
    rng = np.random.default_rng(11)
    plain = rng.uniform(0.1, 1.0, (120, 6))
    rows = [(i, (v * (magnitude if i % 2 else 1.0)).tolist()) for i, v in enumerate(plain)]
    got = by_query(permutation.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = exact([(i, v.tolist()) for i, v in enumerate(plain)])
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got[q], want[q]))


def test_a_sample_of_unusable_vectors_stops_nothing(spark, monkeypatch):
    monkeypatch.setattr(permutation, "SAMPLE_ROWS", 20)
    rng = np.random.default_rng(12)
    rows = [(i, [0.0] * 4 if i % 10 else rng.standard_normal(4).tolist(), 0) for i in range(400)]
    got = by_query(permutation.nearest_neighbours(frame(spark, rows)))
    assert set(got) == set(range(0, 400, 50)) and all(len(v) == 5 for v in got.values())


def test_empty(spark):
    found = permutation.nearest_neighbours(frame(spark, []))
    assert found.count() == 0 and found.columns == ["query_id", "rank", "vec_id", "score"]
    assert permutation.nearest_neighbours(frame(spark, [(0, None, 1)])).count() == 0
