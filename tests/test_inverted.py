"""The inverted index against scoring everything: exact ranks, few blocks opened, documents removed."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.operators import inverted as I

TOKEN = re.compile(r"[a-zà-ÿ0-9][a-zà-ÿ0-9\-]*")
STOP = "the of and to in a is that it was".split()


def brute(docs, queries, k):
    each = {i: Counter(TOKEN.findall((t or "").lower())) for i, t in docs}
    length = {i: sum(c.values()) for i, c in each.items()}
    n, avg = len(each), sum(length.values()) / len(each)
    df = Counter(t for c in each.values() for t in c)
    out = {}
    for q, text in queries:
        asked = set(TOKEN.findall((text or "").lower()))
        scores = {}
        for i, c in each.items():
            for t in asked & c.keys():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                scores[i] = scores.get(i, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[i] / avg))
        out[q] = [(i, s) for s, i in sorted((-round(s, 6), i) for i, s in scores.items())[:k]]
    return {q: [(i, -s) for i, s in v] for q, v in out.items() if v}


def found(hits):
    out = {}
    for r in hits.rows.collect():
        out.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    return {q: [(i, -s) for s, i in sorted(v)] for q, v in out.items()}


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and [s for _, s in a[q]] == pytest.approx([s for _, s in b[q]], abs=2e-6), q


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    common = [f"word{i}" for i in range(2000)]
    weight = [1 / (i + 1) for i in range(2000)]
    rows = [(i, " ".join(rng.choices(STOP, k=rng.randint(8, 60)) + rng.choices(common, weight, k=rng.randint(1, 40)))) for i in range(4000)]
    return rows + [(4000 + i, "the same text of word7 and word3") for i in range(40)] + [(5000, ""), (5001, None), (5002, "the " * 3000), (5003, "word1900")]


QUERIES = [(1, "the word900 of word1200 and the rest"), (2, "is it word3"), (3, "the of and"), (4, "nowhere"), (5, None), (6, ""), (7, "Word7 WORD7 word3"), (8, "that was word1999 word1500 word800 in the word3")]


@pytest.mark.parametrize("k", [1, 10, 60])
def test_like_scoring_everything(spark, docs, k):
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"), block=64)
    queries = spark.createDataFrame([(*q, 1) for q in QUERIES], "query_id long, text string, df int")
    same(found(I.search(index, queries, k)), brute(docs, QUERIES, k))
    if k == 10:
        gone = [i for i, _ in docs if i % 3 == 0 or 4000 <= i < 4010]
        left = I.removed(I.removed(index, spark.createDataFrame([(i,) for i in gone[:700]] + [(99_999,), (None,)], "doc_id long")), spark.createDataFrame([(i,) for i in gone[600:]], "doc_id long"))
        rest = [d for d in docs if d[0] not in set(gone)]
        assert left.n == len(rest)  # documents without a token count too
        same(found(I.search(left, queries, k)), brute(rest, QUERIES, k))


def test_few_blocks_are_opened(spark, docs):
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"), block=16)
    asked = "word900 word1200 the of and to in a is that it was"
    hits = I.search(index, spark.createDataFrame([(1, asked)], "query_id long, text string"), 5)
    same(found(hits), brute(docs, [(1, asked)], 5))
    there = index.blocks.filter(index.blocks.token.isin(*asked.split())).count()
    assert there > 1500 and hits.opened.count() < 0.2 * there


def test_empty_tables(spark):
    none = I.build(spark.createDataFrame([], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert I.search(none, asked, 3).rows.count() == 0
    some = I.build(spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string"))
    assert I.search(some, asked.limit(0), 3).rows.count() == 0 and [r.doc_id for r in I.search(some, asked, 3).rows.collect()] == [1]


def test_index_is_kept_until_files_change(spark, tmp_path):
    from tessera.sources import shared

    at, made = f"{tmp_path}/a folder with é and %20", []

    def asked():
        return shared.kept(spark.read.schema("id long").parquet(at), "numbers", lambda: made.append(1) or len(made))

    spark.range(3).write.parquet(at)
    assert [asked(), asked()] == [1, 1]
    spark.range(1).write.mode("append").parquet(at)
    assert [asked(), asked()] == [2, 2]


def test_frequent_words_bring_no_pairs(spark, docs, monkeypatch):
    """Queries of frequent words alone: what a search writes doesn't grow with documents that have a word, and parts and groups of queries give the same."""
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"), block=500)
    rows, written = [], I.shared.written
    monkeypatch.setattr(I.shared, "written", lambda df, name: (rows.append(out.count()), out)[1] if (out := written(df, name)) is not None else None)
    monkeypatch.setattr(I, "ASKED", 7)
    rng = random.Random(5)
    asked = [(i, " ".join(rng.sample(STOP, 5))) for i in range(20)]
    same(found(I.search(index, spark.createDataFrame(asked, "query_id int, text string"), 10)), brute(docs, asked, 10))
    assert sum(rows) < 1000, rows  # 20 queries meet 80,000 documents


def test_repeated_ids_count_as_in_sql(spark):
    """Rows that share an id count one by one; those alike in length too are one document of a token."""
    docs = [(1, "a b c"), (1, "a b c"), (1, "a d"), (2, "a"), (3, ""), (4, "b b e")]
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert (index.n, index.length) == (6, 12) and {r.token: r.df for r in index.terms.collect()} == {"a": 3, "b": 2, "c": 1, "d": 1, "e": 1}
    left = I.removed(index, spark.createDataFrame([(1,)], "doc_id long"))
    assert (left.n, left.length) == (3, 4) and {r.token: r.df for r in left.terms.collect()} == {"a": 1, "b": 1, "e": 1}


def test_queries_of_the_same_tokens_are_looked_for_once(spark, docs, monkeypatch):
    """What is looked for grows with the sets of tokens that are asked, not with the queries that have them."""
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"), block=500)
    asked = [(100 * i + j, t) for i in range(30) for j, t in enumerate(("the word900 of word1200", "of THE word1200, word900 word900", "of the and", "word3"))]
    rows, written = {}, I.shared.written
    monkeypatch.setattr(I.shared, "written", lambda df, name: (rows.__setitem__(name, out.count()), out)[1] if (out := written(df, name)) is not None else None)
    hits = I.search(index, spark.createDataFrame([(f"q{q}", t) for q, t in asked], "query_id string, text string"), 10)
    same(found(hits), {f"q{q}": v for q, v in brute(docs, asked, 10).items()})
    assert rows["asked"] == 4 + 3 + 1 and rows["sets"] == 3, rows


def test_frequent_words_are_sent_once_for_many_queries(spark, docs, monkeypatch):
    """1,500 different queries of frequent words: a part gets the block of a word once, not again for each thousand of queries."""
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"), block=500)
    rows, written = {}, I.shared.written
    monkeypatch.setattr(I.shared, "written", lambda df, name: (rows.__setitem__(name, out.count()), out)[1] if (out := written(df, name)) is not None else None)
    frequent = [*STOP, "word0", "word1", "word2"]
    asked = [(i, t) for i in range(2000) if len((t := " ".join(w for j, w in enumerate(frequent) if i >> j & 1)).split()) > 3][:1500]
    hits = found(I.search(index, spark.createDataFrame(asked, "query_id long, text string"), 10))
    assert len(hits) == len(asked) == rows["sets"] > 1024 and rows["askers"] <= len(frequent), rows
    same({q: hits[q] for q, _ in asked[::100]}, brute(docs, asked[::100], 10))
