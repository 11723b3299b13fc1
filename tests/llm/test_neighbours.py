"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import numpy as np
import pytest

from plotline.llm import neighbours, queries


def brute(rows, every=50, count=5):
    good = [(k, np.array(v, float)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (k, v) in enumerate(good):
        if k is not None and k % every == 0:
            hits = sorted(((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j if j is not None else 1 << 62) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)))
            out.setdefault(k, []).append([(j, -c) for c, j in hits[:count]])
    return out


@pytest.mark.parametrize(("folder", "rows", "asked"), [("/root/testdata/sf0.001", 8192, 512), ("/root/testdata/sf0.1", 600, 7)])
def test_recall_and_scores(spark, folder, rows, asked):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = {}
    for r in neighbours.nearest(table, block_rows=rows, block_queries=asked).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], r["score"])
    assert got.keys() == want.keys()
    right = 0
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    for k, hits in got.items():
        assert sorted(hits) == list(range(1, 6))
        right += len({j for j, _ in hits.values()} & {j for j, _ in want[k][0]})
        for j, c in hits.values():
            assert c == pytest.approx(vectors[k] @ vectors[j] / np.linalg.norm(vectors[k]) / np.linalg.norm(vectors[j]), abs=1e-12)
        assert [c for _, c in sorted((n, x[1]) for n, x in hits.items())] == sorted((x[1] for x in hits.values()), reverse=True)
    assert right >= 0.97 * 5 * len(got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 120)]
    rows += [(100, [1.0, 0, 0, 0, 0, 0])] + [(300 + i, [2.0, 0, 0, 0, 0, 0]) for i in range(200)]
    rows += [(500, None), (550, []), (600, [0.0] * 6), (650, [1.0, None, 0, 0, 0, 0]), (700, [float("nan")] * 6), (750, [float("inf")] + [1.0] * 5), (800, [1.0, 2.0]), (801, [2.0, 1.0]), (None, [3.0, 0, 0, 0, 0, 0])]
    rows = [(k, v and [None if x is None else float(x) for x in v]) for k, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "'x' as score")
    got = {}
    for r in neighbours.nearest(frame, block_rows=64).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["score"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert [j for _, j, _ in sorted(got[800])] == [801]
    for k in (50, 300, 350):
        assert [j for _, j, _ in sorted(got[k])] == [j for j, _ in want[k][0]]
    # Two rows have the key 100; each finds the equal vectors with the smallest keys.
    assert len(got[100]) == 10
    assert {j for _, j, c in got[100] if c > 0.9999} == {300, 301, 302, 303, 304}
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_law_and_query(spark):
    draws = (np.random.default_rng(0).standard_normal((20_000, 8)) ** 2).sum(1)
    assert np.mean(draws <= neighbours.stop_ratio(0.9)) == pytest.approx(0.9, abs=0.01)
    assert queries.projected_neighbours(spark, "/root/testdata/sf0.001").columns == ["query_id", "rank", "vec_id", "score"]
