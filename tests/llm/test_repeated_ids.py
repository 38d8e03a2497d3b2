"""Rows that share an id and have different texts: each is judged, cut and kept by its own text."""

import random
import sys
import os

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tessera.llm import paragraph_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_no long, text_key string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t), 1, "x") for i, t in rows], SCHEMA)


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_passages_are_cut_from_the_text_that_has_them(spark):
    rng = random.Random(5)
    p, x, y, unique = prose(rng, 60), prose(rng, 25), prose(rng, 30), prose(rng, 100)
    docs = table(spark, [(1, p), (2, f"{x} {p} {y}"), (2, unique), (2, unique), (3, prose(rng, 40) + "\n" + p), (3, unique + " and more")])
    cut = dict.fromkeys(texts(paragraph_dedup.without(docs, paragraph_dedup.repeats(docs))))
    got = [t for i, t in cut if i == 2]
    assert unique in got and any(t.split() == f"{x} {y}".split() for t in got)
    assert (1, p) in cut and not any(p in t for i, t in cut if i != 1)


def test_one_of_each_keeps_unique_texts(spark):
    rng = random.Random(6)
    p, unique, other = prose(rng, 60), prose(rng, 50), prose(rng, 50)
    docs = table(spark, [(1, p), (2, p), (2, unique), (3, p + " end"), (3, other), (None, p)])
    got = texts(corpus_pipeline.one_of_each(spark, docs.filter("doc_id is not null"), ""))
    assert got == sorted([(1, p), (2, unique), (3, other)])
    assert corpus_pipeline.one_of_each(spark, docs, "").filter("doc_id is null").count() == 1


def test_contaminated_rows_go_alone(spark, tmp_path):
    rng = random.Random(7)
    question = "If Alice has 7 apples and gives 3 of them to Bob then how many apples does she still have"
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = prose(rng, 80)
    docs = table(spark, [(4, prose(rng, 20) + ". " + question + " now?"), (4, clean), (4, clean), (5, question), (5, prose(rng, 9))])
    got = texts(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)))
    assert [i for i, _ in got] == [4, 4, 5] and [t for i, t in got if i == 4] == [clean, clean]
