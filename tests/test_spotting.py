"""Spotting by an automaton against one pattern for each term."""

import random
import re

import pytest

from tessera.operators import spotting as P

NEGATORS = ("no", "no longer", r"suspend\w{0,20}", "não")


def by_pattern(term, text):
    """None where a term isn't, else whether one of its places is free: term by term and place by place."""
    body = r"\s+".join(re.escape(w) for w in term.split())
    places = [m.start() for m in re.finditer(rf"(?i)(?<![\w-])(?={body}(?![\w-]))", text)]
    if not places:
        return None
    return any(not any(re.search(rf"(?i)\b(?:{n})\b[^.;!?]{{0,40}}\Z", text[:p]) for n in NEGATORS) for p in places)


def test_like_patterns():
    rng = random.Random(2)
    terms = ["lithium", "ácido valpróico", "a b", "b", "x-ray", "no longer", "é", "İstanbul", "in in", "日本"] + [f"t{i} u{i}" for i in range(300)]
    pieces = [*terms[:16], "no", "No longer", "suspendeu", "não", "not", ".", ";", "  ", "\n", "\t ", " ", ", ", "-", "_", "word", "ÁCIDO\n VALPRÓICO", "LITHIUM", "xx yy zz " * 6, "t5\n\nu5", "İSTANBUL"]
    spotter = P.Spotter([P.plain(t) for t in terms], NEGATORS)
    some = 0
    for _ in range(1500):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))
        want = {P.plain(t): f for t in terms if "İ" not in t and (f := by_pattern(t, text)) is not None}
        got = {t: f for t, f in spotter.spots(text).items() if "İ" not in t}  # patterns and lower case differ on this letter
        some += sum(not f for f in want.values())
        assert got == want, text
    assert some > 300


@pytest.mark.parametrize("slice_", [4_000_000, 50])
def test_slices_of_the_terms(spark, monkeypatch, slice_):
    monkeypatch.setattr(P, "SLICE", slice_)
    terms = [f"term {i}" for i in range(100)] + [None, " ", "Term 7"]
    texts = [(1, "x", "a TERM 7, no term  9 and term 99"), (2, "x", None), (3, "x", ""), (None, "x", "term 1" + " y" * 200_000)]
    df = spark.createDataFrame([(*r, 5) for r in texts], "id long, free string, text string, term int").drop("free", "term")
    got = {(r.id, r.term, r.free) for r in P.spotted(df, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], NEGATORS).collect()}
    assert got == {(1, "term 7", True), (1, "term 9", False), (1, "term 99", False), (None, "term 1", True)}
    assert P.spotted(df, spark.createDataFrame([], "term string"), ["id"]).count() == 0


@pytest.mark.parametrize("slice_", [1_000_000, 40])
def test_quotations_in_texts(spark, monkeypatch, slice_):
    monkeypatch.setattr(P, "SLICE", slice_)
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "a", "of", "lithium", "é", "日本", "x-y"])
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None), (91, "the " * 50_000), (0, "the same id again")]
    quotes = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(70, "he of"), (71, "t"), (72, ""), (73, None), (0, "lithium"), (5, "a of")]
    got = sorted(tuple(r) for r in P.holding(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, t string, item_id int"), spark.createDataFrame([(*q, 1) for q in quotes], "item_id long, q string, doc_id int")).distinct().collect())
    assert got == sorted({(i, d) for i, q in quotes for d, t in texts if q and t and q in t})
    assert P.holding(spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame([], "item_id long, q string")).count() == 0
