"""Queries and operators that SQL can't express, against loops over whole tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import deliver as D
from tessera.operators import guard as G
from tessera.operators import memory as M
from tessera.operators import screen as S
from tessera.operators import text as X
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def split(text, limit=1600, overlap=200):
    """Chunks by the rule: pack sentences; flush and cut what is over the limit."""
    text = text.strip()
    if len(text) <= limit:
        return [text] * bool(text)
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text):
        if len(s) > limit:
            out += [now] + [s[i : i + limit] for i in range(0, len(s), limit - overlap)]
            now = ""
        elif len(now) + len(s) + 1 > limit:
            out.append(now)
            now = now[-overlap:] + " " + s
        else:
            now = (now + " " + s).strip()
    return [c.strip() for c in [*out, now] if c.strip()]


def test_chunk_pack(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, i): (len(c), hashlib.md5(c.encode()).hexdigest()) for r in docs for i, c in enumerate(split(r.text or ""))}
    got = {(r.doc_id, r.ord): (r.chars, r.digest) for r in QUERIES["chunk_pack"](spark, SF).collect()}
    assert got == want and len(got) > len(docs)


def test_negation_scope(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        for term in ("and", "der"):
            for m in re.finditer(rf"(?i)(?<![\w-]){term}(?![\w-])", r.text or ""):
                before = re.search(r"[^.;!?]*$", (r.text or "")[: m.start()])[0]
                # a negator that ends no more than 40 characters before the term, in its sentence
                if not any(len(before) - n.end() <= 40 for n in re.finditer(r"(?i)\b(?:not|no|of|nicht\w{0,10})\b", before)):
                    want.add((r.doc_id, term))
    assert {(r.doc_id, r.concept) for r in QUERIES["negation_scope"](spark, SF).collect()} == want and want


def test_page_queries(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["page_refusal"](spark, SF).collect()}
    read = {r.page_id: r for r in QUERIES["html_text"](spark, SF).collect()}
    for p in pages:
        title, text = X.read_page(p.html)
        host = re.match(r"[a-z]+://([^/?#:]+)", p.url)[1]
        probe = (title + " " + text[:300]).lower()
        want = "robots" if host.endswith(".org") else "interstitial" if any(m in probe for m in X.INTERSTITIAL) else "short" if len(text) < 1000 else "read"
        assert got[p.page_id].verdict == want and got[p.page_id].truncated == (want == "read" and len(text) > 24_000)
        assert got[p.page_id].rate_per_s == (0.25 if want == "read" and host.startswith("m.") else None)
        assert (read[p.page_id].title, read[p.page_id].chars, read[p.page_id].digest) == (title, len(text), hashlib.md5(text.encode()).hexdigest())
    assert len(got) == len(pages) == len(read)


@pytest.mark.parametrize("kind,text,discontinuation,fires", [
    ("user", "I take valproate", False, True), ("user", "I never took valproate", False, False), ("user", "never. I take valproate", False, True), ("reply", "never valproate", False, True),
    ("user", "no longer on valproate, but valproate helped once and " + "x" * 50 + " valproate", False, True), ("user", "I run aurora here", False, False), ("evidence", "aurora levels", False, True), ("user", "suspendi valproate", True, True),
    ("evidence", "the patient denies valproate use", False, False), ("user", None, False, False),
])
def test_screen_terms(spark, kind, text, discontinuation, fires):
    seg = spark.createDataFrame([(1, kind, "r1", text)], "turn int, kind string, ref string, text string")
    assert (S.alerts(seg, (S.Rule("k", "high", ("valproate", "aurora"), (), discontinuation),), "turn", frozenset({"aurora"})).count() == 1) is fires


def test_screen_co_terms_are_of_the_turn(spark):
    rule = (S.Rule("b", "medium", ("valproate",), ("pregnant",)), S.Rule("a", "high", ("valproate",)))
    rows = [(1, "user", "q", "she is pregnant"), (1, "evidence", "p1", "valproate worked"), (2, "evidence", "p2", "valproate worked"), (3, "user", "q", "not pregnant, never pregnant"), (3, "evidence", "p3", "valproate"), (4, "user", "q", "never pregnant"), (4, "reply", "r", "valproate"), (5, "user", "q", "")]
    got = {(r.turn, r.rule, r.severity_rank, r.first_ref) for r in S.alerts(spark.createDataFrame(rows, "turn int, kind string, ref string, text string"), rule, "turn").collect()}
    # in turn 3 one mention has no negator of the list before it; in turn 4 a reply makes negations count nowhere
    assert got == {(1, "b", 1, "p1"), (1, "a", 0, "p1"), (2, "a", 0, "p2"), (3, "b", 1, "p3"), (3, "a", 0, "p3"), (4, "b", 1, "r"), (4, "a", 0, "r")}


def test_queue_log(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(1, 1, 1, "queued"), (2, 1, 2, "queued"), (2, 2, 3, "claimed"), (3, 1, 4, "queued"), (3, 22, 5, "claimed"), (4, 1, 6, "claimed"), (4, 2, 7, "failed"), (4, 3, 8, "claimed"), (4, 4, 9, "failed"), (5, 1, 10, "claimed"), (5, 2, 11, "done"), (6, 1, 12, "cancelled")]
    log = spark.createDataFrame([(t, at(h), e, v) for t, h, e, v in rows], "task_id int, at string, entry_id int, verb string").withColumn("at", F.to_timestamp("at"))
    got = {r.task_id: (r.state, r.attempts, r.orphan) for r in G.queue_state(log, F.lit(at(23)).cast("timestamp"), 7200, 2).collect()}
    assert got == {1: ("pending", 0, False), 2: ("pending", 1, True), 3: ("running", 1, False), 4: ("dead", 2, False), 5: ("done", 1, False), 6: ("cancelled", 0, False)}


def test_jobs_that_were_never_seen_start_their_clock(spark):
    jobs = spark.createDataFrame([("a", 60, True, None), ("b", 60, False, None), ("c", 60, False, "2024-01-01 00:00:00"), ("d", 3600, False, "2024-01-01 00:30:00")], "name string, interval_s int, run_on_start boolean, last_run string").withColumn("last_run", F.to_timestamp("last_run"))
    got = {r.name: (r.due, str(r.stored)) for r in G.due(jobs, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {"a": (True, "2024-01-01 01:00:00"), "b": (False, "2024-01-01 01:00:00"), "c": (True, "2024-01-01 01:00:00"), "d": (False, "2024-01-01 00:30:00")}


@pytest.mark.parametrize("field", range(5))
def test_each_answer_counts(spark, field):
    row = [True, True, 2, None]
    bad = [False, False, 1, "blocked"]
    if field < 4:
        row[field] = bad[field]
    df = spark.createDataFrame([tuple(row)], "a boolean, b boolean, c int, d string")
    assert df.select(G.sufficient(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] is (field == 4)
    answers = [True, False, False, False]
    if field < 4:
        answers[field] = not answers[field]
    df = spark.createDataFrame([tuple(answers)], "a boolean, b boolean, c boolean, d boolean")
    assert df.select(G.entailed(*map(F.col, "abcd"))).first()[0] is (field == 4)


def test_views_fail_closed(spark):
    rows = [(1, "recon", True, True, 1), (2, "recon", True, True, 2), (3, "chat", True, True, None), (4, "research", True, False, None), (5, "chat", False, False, None), (6, "research", True, True, None)]
    m = spark.createDataFrame(rows, "memory_id int, source string, confirmed boolean, active boolean, focus_id int")
    now = spark.createDataFrame([(1,)], "focus_id int")
    assert {tuple(r) for r in M.views(m, now).collect()} == {("recon", 1), ("user", 3), ("declined", 5), ("research", 6)}
    assert {tuple(r) for r in M.views(m, now.limit(0)).collect()} == {("user", 3), ("declined", 5), ("research", 6)}


def test_templates_are_strict(spark):
    with pytest.raises(ValueError, match="no value"):
        D.render("a $b $c", {"b": F.lit(1)})
    with pytest.raises(ValueError, match="no placeholder"):
        D.render("a $b", {"b": F.lit(1), "x": F.lit(2)})
    assert spark.range(1).select(D.render("$a$b.", {"a": F.lit(1), "b": F.lit(None)})).first()[0] == "1."


def test_paced_like_a_loop(spark):
    rows = [(h, i, float(t)) for h, times in ((1, [0, 0, 0, 5, 5, 100]), (2, [7])) for i, t in enumerate(times)]
    got = {(r.h, r.i): round(r.starts, 9) for r in D.paced(spark.createDataFrame(rows, "h int, i int, t double"), "h", "t", "i", 0.5).collect()}
    want, last = {}, {}
    for h, i, t in rows:
        want[h, i] = last[h] = max(t, last.get(h, -1e9) + 2)
    assert got == want
