"""Chains grounded anew: guards on the step, the name and the answer, one trap each."""

import json

from tessera.operators import reground as G
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def step(claim, supported, evidence=None):
    return {"claim": claim, "supported": supported, "evidence": evidence}


def link(index, now, evidence):
    return {"index": index, "now_supported": now, "evidence": evidence}


def test_guards(spark):
    chain = [step("a", False), step('b "quoted"', True, "PMID:1"), step("c", None, ""), step("d", False, "x")]
    cases = {
        1: (chain, json.dumps([link(1, True, "PMID: 7 "), link(3, True, "8"), link(4, True, "99")]), ["7", "8"]),
        2: (chain, json.dumps([link(2, True, "7"), link(0, True, "7"), link(5, True, "7"), link(1, False, "7"), link(1, None, "7"), link(1, True, None)]), ["7"]),
        3: (chain, json.dumps([link(1, True, "7"), link(1, True, "8")]), ["7", "8"]),
        4: (chain, '[{"index": 1, "now_supported": true, "evi', ["7"]),
        5: (chain, None, ["7"]),
        6: (chain, json.dumps([link(1, True, "7")]), []),
        7: ([step("a", True, "PMID:1")], json.dumps([link(1, True, "7")]), ["7"]),
        8: ([], "[]", ["7"]),
        9: (None, json.dumps([link(1, True, "7")]), None),
    }
    chains = spark.createDataFrame([(i, None if c is None else json.dumps(c)) for i, (c, _, _) in cases.items()], "hypothesis_id int, chain_json string")
    answers = spark.createDataFrame([(i, a) for i, (_, a, _) in cases.items()], "hypothesis_id int, answer_json string")
    shown = spark.createDataFrame([(i, s) for i, (_, _, s) in cases.items() if s is not None], "hypothesis_id int, ids array<string>")
    got = {r.hypothesis_id: r for r in G.reground(chains, answers, shown).collect()}
    assert [(i, got[i].anchored, got[i].refused, got[i].marked) for i in sorted(got)] == [
        (1, 2, 1, True), (2, 0, 1, True), (3, 2, 0, True), (4, 0, 0, False), (5, 0, 0, False), (6, 0, 0, True), (7, 0, 0, False), (8, 0, 0, False), (9, 0, 0, False)
    ]
    assert json.loads(got[1].chain_json) == [step("a", True, "PMID:7"), chain[1], step("c", True, "PMID:8"), chain[3]]
    assert json.loads(got[3].chain_json)[0] == step("a", True, "PMID:8")  # the last link of a step holds
    assert all(json.loads(got[i].chain_json) == chain for i in (2, 4, 5, 6)) and got[9].chain_json is None


def test_queries_show_all_cases(spark):
    rows = catalogue.queries()["regrounded_chains"](spark, SF).collect()
    assert sum(r.anchored for r in rows) > 5 and sum(r.refused for r in rows) > 5 and {r.marked for r in rows} == {True, False}
    assert all(catalogue.queries()[q](spark, SF).count() > 0 for q in ("pending_pursuit", "pending_reground", "approved_sources"))
    outcomes = catalogue.queries()["chunk_outcomes"](spark, SF).toPandas()
    assert (outcomes[["yielding", "annihilated", "sterile"]].sum() > 0).all() and (outcomes.yielding + outcomes.annihilated + outcomes.sterile <= outcomes.seen).all()
