"""The filter audit against counting every order document by document."""

import itertools
import random
import re

import pytest

from tessera.llm import filter_audit

GAP = re.compile(r"[\x20\x09-\x0D]+")


def fails(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, _ in rows:
        t = text or ""
        w = [x for x in GAP.split(t) if x]
        yield {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }


def brute(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    each = [(source or "", f, i in good, i in toxic) for (i, _, source), f in zip(rows, fails(rows))]
    out, total = {}, {}
    for part in {p for p, *_ in each}:
        docs = [x[1:] for x in each if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, letter in enumerate(order):
                gone = [x for x in left if x[0][letter]]
                left = [x for x in left if not x[0][letter]]
                alone = sum(f[letter] and sum(f.values()) == 1 for f, *_ in docs)
                out[part, order, k + 1] = [len(left), len(gone), sum(f[letter] for f, *_ in docs) - len(gone), alone, sum(g for _, g, _ in gone), sum(t for *_, t in gone)]
                total[part, letter] = total.get((part, letter), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "GAMMA", "d#e", "é", "delta", "|"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice((3, 40, 307))], k=rng.choice((1, 90, 220, 400)))) for _ in range(60)]
    texts += texts[:25] + ["", None, "", "  \t\n ", "x" * 50_000, "A b " * 30_000, "日本語 " * 300]
    rows = [(i, t, rng.choice(("s", "t", "", None))) for i, t in enumerate(rng.sample(texts, len(texts)))]
    rows += [(3, rows[3][1], "s"), (3, rows[9][1], "s"), (9, "only here", "u"), (None, rows[4][1], "t"), (None, None, None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 90, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 5.0) for r in rows], "doc_id long, text string, source string, good int, mask double")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.interactions(docs, marks).collect()}
    assert got == brute(rows, labels)
    assert filter_audit.interactions(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.interactions(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_walk_swaps_neighbours_and_sees_every_order(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in filter_audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_hot_text(spark):
    """A third of all rows with one text, over many sources, are one copy after the other."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same words', concat('text ', id)) AS text", "concat('s', id % 7) AS source")
    got = filter_audit.interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' and step = 1").collect()
    assert len(got) == 7 and sum(r.removed for r in got) == 999 and sum(r.kept for r in got) == 2001
