"""The two-sided vector join against brute force; far blocks don't meet."""

import numpy as np
import pytest

from tessera.operators import retrieval as R


def frames(spark, docs, queries):
    kinds = "long, embedding array<double>, cosine double"
    return (spark.createDataFrame([(i, v, 0.0) for i, v in side], f"{name} {kinds}") for side, name in ((docs, "doc_id"), (queries, "query_id")))


@pytest.mark.parametrize("block", [4096, 60])
def test_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    x = np.concatenate((base[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 8)), np.repeat(base[:1], 200, axis=0)))
    docs = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, 2.0]), (904, [float("nan")] * 8), (905, [None] * 8), (None, [1.0] * 8)]
    asked = [(i, (x[i] * 1e200).tolist()) for i in range(0, 700, 9)] + [(1000, [3.0, 6.0]), (1001, None), (1002, [1.0] * 3)]
    v, q = frames(spark, docs, asked)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got, want = {}, {}
    for r in R.nearest(v, q, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for i, _ in asked[:-3]:
        c = np.round(unit @ unit[i], 9)
        want[i] = [(r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(700), -c))[:7])]
    assert {i: sorted(p) for i, p in got.items()} == want | {1000: [(1, 903)]}
    pairs = {(r.query_id, r.doc_id) for r in R.close_pairs(v, q, 0.95).collect()}
    assert pairs == {(i, int(j)) for i, _ in asked[:-3] for j in np.flatnonzero(unit @ unit[i] >= 0.95)} | {(1000, 903)}
    assert R.nearest(v.limit(0), q, 3).count() == 0 and R.close_pairs(v, q.limit(0), 0.5).count() == 0


def test_many_queries_and_far_blocks(spark, monkeypatch):
    """10,000 queries; of 20 clusters a block of queries meets few."""
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(24, 24)))[0][:20]
    x = np.repeat(base, 1000, axis=0) + 0.01 * rng.normal(size=(20_000, 24))
    monkeypatch.setattr(R, "BLOCK", 400)
    met = []
    written = R.shared.written
    monkeypatch.setattr(R.shared, "written", lambda df, name: (met.append(out) if name in ("pairs", "balls") else None, out)[1] if (out := written(df, name)) is not None else None)
    docs, asked = [(i, v.tolist()) for i, v in enumerate(x)], [(i, x[i].tolist()) for i in range(0, 20_000, 2)]
    v, q = frames(spark, docs, asked)
    got = R.nearest(v, q, 3)
    rows = got.filter("rank = 1 and query_id = doc_id").count()
    assert rows == 10_000 and got.filter("query_id div 1000 <> doc_id div 1000").count() == 0
    blocks, asking, pairs = (d.count() for d in met)
    assert pairs < 0.25 * blocks * asking, (pairs, blocks, asking)


def test_vectors_are_sent_once_for_many_blocks_of_queries(spark, monkeypatch):
    """Blocks of queries that meet the same block of vectors do so together: vectors aren't sent to each."""
    monkeypatch.setattr(R, "BLOCK", 300)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    v, q = frames(spark, [(i, u.tolist()) for i, u in enumerate(x)], [(i, x[i].tolist()) for i in range(0, 3000, 30)])
    sent = []
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for asked in (1, 40, 1000):
        got = R._meetings(v, q, lambda pairs: pairs, lambda ids, cosine: np.nonzero(cosine >= 0.5), asked)
        assert {(r.query_id, r.doc_id) for r in got.collect()} == {(i, int(j)) for i in range(0, 3000, 30) for j in np.flatnonzero(unit @ unit[i] >= 0.5)}
        groups = R._meetings(v, q, lambda pairs: pairs, lambda ids, cosine: (np.array([0]), np.array([0])), asked).count()
        sent.append(groups)
    blocks = R._meetings(v, q.limit(1), lambda pairs: pairs, lambda ids, cosine: (np.array([0]), np.array([0]))).count()
    assert sent[0] > 4 * blocks and sent[1] <= 4 * blocks and sent[2] == blocks, (sent, blocks)


def test_first_close_hands_on_one_row_a_query(spark, monkeypatch):
    """The smallest id of all that are close, of the same group, and of the target where there is one."""
    monkeypatch.setattr(R, "BLOCK", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 8))[rng.integers(0, 5, 900)] + 0.05 * rng.normal(size=(900, 8))
    docs = [(i, v.tolist(), i % 3, f"t{i % 4}" if i % 4 else "") for i, v in enumerate(x)]
    v = spark.createDataFrame(docs, "doc_id long, embedding array<double>, within int, target string").repartition(3)
    q = spark.createDataFrame([(9000 + i, e, w, t or None) for i, e, w, t in docs[::11]], "query_id long, embedding array<double>, within int, target string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for i, _, w, t in docs[::11]:
        want[9000 + i] = min(int(j) for j in np.flatnonzero(unit @ unit[i] >= 0.9) if docs[j][2] == w and (not t or docs[j][3] == t))
    made = []
    meetings = R._meetings
    monkeypatch.setattr(R, "_meetings", lambda *a: (made.append(out := meetings(*a)), out)[1])
    assert {r.query_id: r.doc_id for r in R.first_close(v, q, 0.9).collect()} == want
    assert made[0].count() < 0.2 * sum((unit @ unit[i] >= 0.9).sum() for i in range(0, 900, 11))


def test_equal_vectors_are_asked_once(spark, monkeypatch):
    """Products grow with the vectors that are asked, not with the queries that have them; an id with several vectors, or with one twice, ranks all that they find."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    asked = [(1000 + i, x[i % 5].tolist()) for i in range(300)] + [(2000, x[0].tolist()), (2000, x[1].tolist()), (2001, x[2].tolist()), (2001, x[2].tolist())]
    v, q = frames(spark, [(i, u.tolist()) for i, u in enumerate(x)], asked)
    made, meetings = [], R._meetings
    monkeypatch.setattr(R, "_meetings", lambda *a: (made.append(out := meetings(*a)), out)[1])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = [sorted((-round(float(c), 9), j) for j, c in enumerate(unit @ unit[i])) for i in range(5)]
    want = {1000 + i: near[i % 5][:6] for i in range(300)} | {2000: sorted(near[0] + near[1])[:6], 2001: sorted(near[2] * 2)[:6]}
    got = {}
    for r in R.nearest(v, q, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    assert {i: sorted(p) for i, p in got.items()} == {i: [(r + 1, j) for r, (_, j) in enumerate(p)] for i, p in want.items()}
    assert made[0].count() == 5 * 6
