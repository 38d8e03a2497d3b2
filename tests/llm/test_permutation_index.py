"""The permutation index against brute force: recall, exact distances, copies, odd rows."""

import math

import duckdb
import numpy as np
import pytest

from tessera.llm import permutation_index, queries

SCHEMA = "vec_id long, embedding array<double>, rank int, score double, dim string"


def brute(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i in asked:
            near = sorted((math.dist(v, w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out[i] = [(r + 1, j, d) for r, (d, j) in enumerate(near)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def same(a, b):
    return [(r, i) for r, i, _ in a] == [(r, i) for r, i, _ in b] and np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-12)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, [1.0, 2.0]), (301, [1.0, 3.0]), (302, [5.0]), (303, [1e200] * 5), (304, [-1e200] * 5), (305, [1e-200] * 5), (306, [2e-200] * 5)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [float("nan")] + [1.0] * 4), (404, [None] + [1.0] * 4), (405, [float("inf")] * 5), (None, [1.0] * 5)]
    vectors = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA)
    asked = {0, 7, 200, 229, 300, 302, 303, 305, 400, 402, 403}
    index = permutation_index.build(vectors)
    got = found(permutation_index.search(index, vectors.filter(vectors.vec_id.isin(*asked)), k=10))
    want = {i: x for i, x in brute(rows, asked, 10).items() if x}
    assert got.keys() == want.keys() and 302 not in got and len(got[300]) == 1
    for i in want:
        assert same(got[i], want[i]), i
    assert permutation_index.search(index, vectors.limit(0)).count() == 0
    assert permutation_index.search(permutation_index.build(vectors.limit(0)), vectors).count() == 0


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 2.0])]
    vectors = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in permutation_index.search(permutation_index.build(vectors), vectors.filter("vec_id = 1")).collect())
    assert got == [(1, 1, 2), (1, 1, 3), (1, 2, 2), (1, 2, 2), (1, 3, 2), (1, 3, 3)]


@pytest.mark.parametrize("shape", ["sphere", "clusters", "copies"])
def test_recall(spark, monkeypatch, shape):
    """Rows of several segments and query blocks; 0.9 of the true neighbours at least, all distances exact."""
    monkeypatch.setattr(permutation_index, "SEGMENT", 2000)
    monkeypatch.setattr(permutation_index, "QUERIES", 30)
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(n, 32))
    if shape == "clusters":
        x = x[:40][rng.integers(0, 40, n)] + 0.1 * x
    if shape == "copies":
        x[::3] = x[0]
        x[1::6] = x[1] + 0.001 * x[1::6]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    asked = {i for i in range(0, n, 100)}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(permutation_index.search(permutation_index.build(vectors), vectors.filter("vec_id % 100 = 0"))), brute(rows, asked, 10)
    hits = [len({j for _, j, _ in got[i]} & {j for _, j, _ in want[i]}) / 10 for i in want]
    assert np.mean(hits) >= 0.9, np.mean(hits)
    for i, near in got.items():
        assert [r for r, *_ in near] == list(range(1, 11)) and np.allclose([np.linalg.norm(x[i] - x[j]) for _, j, _ in near], [d for *_, d in near], rtol=1e-12)
        if shape == "copies" and i % 3 == 0:
            assert near == want[i]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    got, want = found(queries.op12_permutation_index(spark, sf)), brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    assert got.keys() == want.keys()
    assert np.mean([len({j for _, j, _ in got[i]} & {j for _, j, _ in want[i]}) / 10 for i in want]) >= 0.9
