"""Hard negatives against brute force: ranges, ties, labels, odd rows; pruning that passes over anchor groups."""

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row int, scores string"


def brute(rows, asks, least=30, most=90, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in ok:
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in ok if len(w) == len(v))
            for p, j, _ in [s for s in scored if s[2] == y and s[1] != i][:5]:
                hard = [s for s in scored if s[2] != y and -least * p <= -100 * s[0] <= -most * p][:10]
                out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(hard)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [8192, 70])
def test_against_brute_force(spark, monkeypatch, size):
    for name, value in (("SEGMENT", size), ("ANCHORS", size // 10), ("LEAF", 16), ("ANCHOR_LEAF", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 6))
    rows = [(i, [float(x) for x in base[i % 9] * 0.5 + rng.normal(size=6) * rng.choice([0.0, 0.1, 0.6])], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(200)]  # one vector in a third of all rows
    rows += [(2000, [0.0] * 6, 1), (2001, [-1.0] * 6, 1), (2010, [1.0, 2.0], 0), (2011, [1.0, 1.0], 0), (2012, [1.0, 0.7], 1), (2020, [3.0], 9), (2030, [], 0), (2040, [2.0] * 6, None), (2050, None, 1)]
    rows += [(2060, [float("nan")] + [1.0] * 5, 1), (2070, [None] + [1.0] * 5, 1), (2080, [float("-inf")] * 6, 1), (None, [1.0] * 6, 1), (2090, [900.0, 0.5, 0.0, 0.0, 0.0, 0.0], 2), (2100, [800.0, 0.5, 0.0, 0.0, 0.0, 0.0], 2), (2110, [700.0, 0.5, 0.0, 0.0, 0.0, 0.0], 3)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert mined(hard_negatives.mine(vectors, "vec_id % 10 = 0")) == brute(rows, lambda i: i % 10 == 0)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [1.0, 0.2], 0), (2, [1.0, 0.2], 0), (3, [0.5, 0.0], 1), (3, [0.5, 0.0], 1)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = mined(hard_negatives.mine(vectors, "vec_id = 1"))
    assert len(got) == 8 and {(g[0], g[1], g[3]) for g in got} == {(1, 2, 3)} and sorted(g[2] for g in got) == [1, 1, 1, 1, 2, 2, 2, 2]
    assert hard_negatives.mine(vectors, "vec_id = 77").count() == 0
    assert hard_negatives.mine(vectors.limit(0), "vec_id = 1").count() == 0
    odd = spark.createDataFrame([(1, [1e9, 0.0], "a"), (2, [2e9, 0.0], "a"), (4, [0.5, 0.0], "b"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert mined(hard_negatives.mine(odd, "vec_id = 1")) == [(1, 2, 1, 4, 65536, 32768)]


def test_large_integers_are_exact():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-(1 << 29), 1 << 29, (20, 3)), rng.integers(-(1 << 29), 1 << 29, (90, 3))
    c[5] = c[4] + [0, 0, 1]
    found, score, there = hard_negatives.best(a, c, np.full((20, 1), -(1 << 61)), np.full((20, 1), 1 << 61), 7, lambda i, j: np.ones((len(i), len(j)), bool))
    for i in range(20):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(a[i], r)), j) for j, r in enumerate(c))[:7]
        assert there[i].all() and list(zip((-score[i, 0]).tolist(), found[i, 0].tolist())) == want


def test_groups_of_anchors_are_passed_over():
    """Of clusters far apart only the near one is scored for each group."""
    rng = np.random.default_rng(1)
    base = np.eye(16, dtype=np.int64) * 200
    rows = np.repeat(base, 512, axis=0) + rng.integers(-4, 5, (8192, 16))
    anchors = np.repeat(base, 64, axis=0) + rng.integers(-4, 5, (1024, 16))
    pairs = 0

    def usable(i, j):
        nonlocal pairs
        pairs += len(i) * len(j)
        return np.ones((len(i), len(j)), bool)

    found, _, there = hard_negatives.best(anchors, rows, np.full((1024, 1), -(1 << 61)), np.full((1024, 1), 1 << 61), 5, usable)
    assert there.all() and (found[:, 0] // 512 == (np.arange(1024) // 64)[:, None]).all()
    assert pairs < 0.2 * len(anchors) * len(rows), pairs
