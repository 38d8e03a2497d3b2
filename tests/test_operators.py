"""Operators on small frames: one trap each, against loops written for the test."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import levels as L
from tessera.functions.semantics import cosine, folded_key, marker_to_null, text_key, tokens
from tessera.operators import deliver as D
from tessera.operators import guard as G
from tessera.operators import retrieval as R
from tessera.operators import text as X
from tessera.operators import weight as W
from tessera.operators import work as K
from tessera.sources.evidence import Evidence

SF = "/root/testdata/sf0.001"


def test_weight_is_the_product_and_fails_closed(spark):
    ev = Evidence(spark, SF)
    rows = W.claim_weight(ev).collect()
    g, d = dict(L.GRADES), dict(L.DIRECTNESS)
    assert rows and len({r.claim_id for r in rows}) == len(rows)
    assert {(r.grade, r.directness) for r in rows} == {(a, b) for a in g for b in d}
    for r in rows:
        assert r.weight == pytest.approx(g[r.grade] * d[r.directness] * r.confidence, rel=1e-12) and not r.claim_id % 17 == 0 and r.claim_id % 5
    for bad in ("abc", "", "3", "99"):
        assert W.claim_weight(Evidence(spark, SF, active=bad)).count() == 0


def test_loss_classes_cover_all_verified_claims(spark):
    ev = Evidence(spark, SF)
    n = {r.loss_class: r.claims for r in W.loss_classes(ev).collect()}
    assert sum(n.values()) == ev.claims.filter("verified").count() and n["weighted"] == W.claim_weight(ev).filter("verified").count()
    assert set(n) == {"weighted", "unjudged", "off_scale", "out_of_scope"}


def test_scoreboard_keeps_hypotheses_without_links(spark):
    ev = Evidence(spark, SF)
    assert W.scoreboard(ev).count() == ev.hypotheses.count()


def seats(hits, k, n=2):
    hits = sorted(hits, key=lambda h: (-h[1], h[0]))
    head, tail = hits[:k], hits[k:]
    need = max(0, n - sum(h[2] for h in head))
    up = [h for h in tail if h[2] and h[3]][:need]
    low = [h for h in reversed(head) if not h[2]][: len(up)]
    up = up[: len(low)]
    return {h[0] for h in head} - {h[0] for h in low} | {h[0] for h in up}


def test_counter_seats_like_a_loop(spark):
    rng = random.Random(7)
    lists = {q: [(i, rng.randint(0, 20) / 4, rng.random() < 0.2, rng.random() < 0.5) for i in range(rng.randint(0, 40))] for q in range(80)}
    df = spark.createDataFrame([(q, *h) for q, hs in lists.items() for h in hs], "query_id int, claim_id int, score double, contra boolean, semantic boolean")
    got = {q: set() for q in lists}
    for r in R.counter_seats(df, 10).collect():
        got[r.query_id].add(r.claim_id)
    assert got == {q: seats(hs, 10) for q, hs in lists.items()}


def test_minmax(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (2, 2.0), (3, 4.0), (3, 4.0)], "q int, v double")
    got = df.select("q", R.minmax(df, "q", "v").alias("m")).orderBy("q", "m").collect()
    assert [round(r.m, 6) for r in got] == [1.0, 0.05, 0.525, 1.0, 1.0, 1.0]


def test_rank_fusion(spark):
    df = spark.createDataFrame([(1, 10, 1, 1.0, True), (1, 10, 2, 1.0, False), (1, 11, 1, 0.5, False)], "query_id int, doc_id int, rank int, share double, semantic boolean")
    got = {r.doc_id: (r.fused, r.semantic) for r in R.fuse(df).collect()}
    assert got[10] == (pytest.approx(1 / 61 + 1 / 62), True) and got[11] == (pytest.approx(0.5 / 61), False)


def test_cosine_of_nothing_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 0.0], [5.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


def test_percentiles_by_offset(spark):
    rng = random.Random(5)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 4), ("d", 5), ("e", 500)) for v in (rng.randint(0, 90) for _ in range(n))] + [("a", None), ("none", None), (None, 1.0)]
    got = {r.g: (r.p50, r.p99) for r in K.percentiles_by_offset(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p99": 0.99}).collect() if r.g}
    want = {}
    for g in "abcde":
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = tuple(v[min(len(v) - 1, int(len(v) * q))] for q in (0.5, 0.99))
    assert got == {**want, "none": (None, None)}


def test_history_budget(spark):
    rows = [(1, 3, 500), (1, 2, 90), (1, 1, 10), (2, 1, 900), (2, 0, 1)]
    df = spark.createDataFrame(rows, "c int, t int, n int")
    got = {(r.c, r.t) for r in K.within_budget(df, "c", -F.col("t"), F.col("n"), 595).collect()}
    assert got == {(1, 3), (1, 2), (2, 1)}


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, K.upsert(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", None)]
    assert [tuple(r) for r in K.insert_ignore(old, new, ["k"]).collect()] == [(3, "c", None)]


def test_allowance_replay(spark):
    df = spark.createDataFrame([([True, True, False, True, True, True, True, False],)], "o array<boolean>")
    got = df.select(K.allowances(F.col("o"), 8)).first()[0]
    for start in range(1, 9):
        a = start
        for pressed in (True, True, False, True, True, True, True, False):
            a = max(1, a // 2) if pressed else min(8, a + 1)
        assert got[start - 1] == a


def test_retry_delay(spark):
    assert [r[0] for r in spark.range(1, 4).select(K.retry_delay(F.col("id"))).collect()] == [30.0, 60.0, 120.0]


def test_chunks_of_known_texts(spark):
    """Expected chunks worked out by hand: limit 30, overlap 8."""
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(X.packed_chunks(F.col("t"), 30, 8)).first()[0]
    assert cut("") == cut("  \n ") == [] and cut(" One two. Three. ") == ["One two. Three."]
    # what is carried over may make a chunk longer than the limit
    assert cut("a. B." + " c" * 13) == ["a.", "a. B." + " c" * 13]
    # two sentences fit exactly, the third begins with the last eight characters
    assert cut("Alpha beta gam. Delta eps zet. Eta theta iota.") == ["Alpha beta gam. Delta eps zet.", "eps zet. Eta theta iota."]
    # a sentence over the limit ends what is there and is cut every 22 characters; nothing of it carries over
    long = "X" + "y" * 49
    assert cut("Abc def. " + long + ". Ghi.") == ["Abc def.", (long + ".")[:30], (long + ".")[22:52], (long + ".")[44:], "Ghi."]
    # an exact fit stays whole
    assert cut("Z" * 30) == ["Z" * 30] and cut("Z" * 31) == ["Z" * 30, "Z" * 9]


def test_chunks_cover_their_texts(spark):
    """Every sentence of a text stands whole in a chunk unless it is over the limit, and no chunk is over it by more than the overlap."""
    rng = random.Random(3)
    texts = [" ".join(("W" + "y" * rng.randint(0, 300)) + rng.choice([".", "", "!"]) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.packed_chunks(F.col("t"))).collect()]
    for t, chunks in zip(texts, got):
        assert all(len(c) <= 1600 + 201 for c in chunks)
        for s in re.split(X.SENTENCE_END, t):
            assert any(s.strip() in c for c in chunks) if len(s) <= 1600 else all(any(s[k : k + 1600].strip() in c for c in chunks) for k in range(0, len(s), 1400))


@pytest.mark.parametrize("quote,text,ok", [("a b", "x a b y", True), ("A  b", "x a\nB y", True), ("a c", "a b", False), ("  ", "a", False), ("b a", "a b", False)])
def test_quotes(spark, quote, text, ok):
    assert spark.range(1).select(X.anchored(F.lit(quote), F.lit(text))).first()[0] is ok


@pytest.mark.parametrize("text,want", [("PMID: 123", "123"), ("see 123 there", "123"), ("PMC123", None), ("1.5", None), ("prose", None), ("123456789", None)])
def test_pmid(spark, text, want):
    assert spark.range(1).select(X.pmid(F.lit(text))).first()[0] == want


def test_negation_has_a_scope(spark):
    texts = ["a bleed", "no bleed", "no pain. A bleed", "no " + "x" * 50 + " bleed", "bleeding", "pre-bleed", "not a BLEED; bleed"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i for r in X.concept_hits(df, "i", "t", {"b": ("bleed",)}, ("no", "not")).collect()}
    assert got == {0, 2, 3, 6}


def test_html_reader():
    body = "word " * 20
    html = f"<html><head><title> A <b>b</b> </title><script>var x;</script></head><body><nav><form>menu</form>{body}</nav><p>{body}</p><p>short</p>&amp;</body>"
    title, text = X.read_page(html)
    assert title == "A b" and text == body.strip() and X.read_page(None) == ("", "")
    assert X.read_page(f"<title>{body}</title><p>x") == (body.strip(), body.strip())  # a title is text as well
    # broken pages: what comes before and behind the break is read, closing tags too many don't hide text
    assert X.read_page(f"</nav></nav><p>{body}<p")[1].startswith(body.strip())
    assert X.read_page(f"<p>{body}&am")[1] == (body + "&am").strip()
    assert X.read_page(f"one{chr(10)}{body}<br/>{body}")[1] == body.strip() + chr(10) + body.strip()


@pytest.mark.parametrize("text,want", [
    ("apikey=abcd&key=SECRETSECRET token=ab+cdefgh/ijkl== secret=ab12!", "apikey=«redigido»&key=«redigido» token=«redigido» secret=«redigido»"),
    ('{"access_token": "x/y+z="}', '{"access_token": "«redigido»"}'), ("X-Subscription-Token: abc", "X-Subscription-Token: «redigido»"), ("a token of thanks", "a token of thanks"),
])
def test_secrets(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.redacted(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("url,more,want", [
    ("https://pubmed.ncbi.nlm.nih.gov/30712879/", "10.1234/abc", ("pubmed", "30712879")), ("https://a.org/12345", "", None), ("https://pubmed.ncbi.nlm.nih.gov/1234567890", "", None),
    ("https://a.org/x", "see 10.1234/abc.d).", ("doi", "10.1234/abc.d")), ("https://doi.org/10.1000/x_1", None, ("doi", "10.1000/x_1")), ("https://a.org", "10.1234/.,", None), (None, None, None),
])
def test_leads(spark, url, more, want):
    got = spark.createDataFrame([(url, more)], "u string, m string").select(X.lead(F.col("u"), F.col("m"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_page_verdicts(spark):
    long = "word " * 300
    rows = [("https://a.org", True, "t", long, "read"), ("https://a.org", True, "Just a Moment", long, "interstitial"), ("https://a.org", True, "t", "x" * 295 + "captcha" + long, "read"), ("https://a.org", True, "t", "captcha " + long, "interstitial"),
            ("https://x.pubmed.ncbi.nlm.nih.gov/1", True, "t", long, "evidence"), ("https://a.org", False, "t", long, "robots"), ("https://a.org", True, "t", "x" * 999, "short"), ("https://a.org", None, "t", "x" * 1000, "read")]
    df = spark.createDataFrame(rows, "u string, ok boolean, t string, x string, want string")
    assert [r[0] for r in df.filter(X.page_verdict(F.col("u"), F.col("ok"), F.col("t"), F.col("x")) != F.col("want")).collect()] == []


def test_text_semantics(spark):
    row = spark.range(1).select(text_key(F.lit(" A\t b\n")), marker_to_null(F.lit(" None ")), marker_to_null(F.lit("Drug")), tokens(F.lit("Foo-bar baz's É"))).first()
    assert tuple(row) == ("a b", None, "Drug", ["foo-bar", "baz", "s", "é"])


def test_evidence_is_unchanged_by_more_conversations(spark):
    """What is remembered never filters evidence: weights read no conversation table."""
    ev = Evidence(spark, SF)
    plan = W.claim_weight(ev)._jdf.queryExecution().toString()
    assert "conversations" not in plan


def test_folded_keys_meet_in_every_form(spark):
    rows = ["Straße  é", "STRASSE é", " strasse É ", "strasse e", "ASCII only", "ascii  ONLY ", None, "", "ﬁn", "FIN"]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(folded_key(F.col("t")).alias("k")).collect()]
    assert got[0] == got[1] == got[2] == "strasse é" and got[3] == "strasse e" and got[4] == got[5] == "ascii only" and got[6] is None and got[7] == "" and got[8] == got[9] == "fin"


def test_repairs_are_bounded(spark):
    good, bad = '{"k": 1}', '{"k": 99}'
    tries = {1: [good], 2: [bad, good], 3: [bad, "{oops", good], 4: [bad, bad, bad, good], 5: [bad], 6: [bad, " ", good], 7: [good, ""], 8: ['{"k": 1', bad], 9: [None]}
    rows = [(i, n, b, 7) for i, bs in tries.items() for n, b in enumerate(bs)] + [(1, None, bad, 7), (10, 5, good, 7)]
    df = spark.createDataFrame(rows, "request int, attempt int, body string, last int").drop("last")
    got = {r.request: (r.outcome, r.attempts, r.refused, r.said) for r in D.repaired_answers(df, "request", "attempt", "body", "k bigint", {"range": F.col("answer.k") <= 50}).collect()}
    assert got == {
        1: ("valid", 1, None, None), 2: ("valid", 2, None, None), 3: ("valid", 3, None, None), 4: ("invalid", 3, "range", bad), 5: ("open", 1, "range", bad), 6: ("truncated", 2, "truncated", " "),
        7: ("valid", 1, None, None), 8: ("open", 2, "range", bad), 9: ("truncated", 1, "truncated", None),
    }


def test_chunks_of_a_long_text_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("A sentence of some length that ends here. "), n).alias("t"))
        began = time.time()
        assert df.select(F.size(X.packed_chunks(F.col("t")))).first()[0] > n / 60
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 60  # 1.7 MB


def test_reading_budget_and_cut_bodies(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(G.read_chars(F.lit(n))) for n in (8192, 512, 0, 2048)] == [29220, 2000, 2000, 4644]
    assert [one(G.confidence(F.lit(x).cast("boolean"))) for x in (True, False, None)] == [0.8, 0.5, 0.5]
    body = F.encode(F.lit("aé日😀b"), "UTF-8")
    assert [one(G.capped_text(body, n)) for n in (1, 3, 6, 10, 11, 99)] == ["a", "aé", "aé日", "aé日😀", "aé日😀b", "aé日😀b"]
    assert all(one(G.capped_text(body, n)).startswith("a") and "�" in one(G.capped_text(body, n)) for n in (2, 4, 5, 7, 8, 9)) and one(G.capped_text(F.lit(None).cast("binary"), 5)) is None


def test_labels_and_references(spark):
    rows = ["step 3 of [12] sigma-1, 5-HT1A", "7", "  a\n\t b 10 ", "x" * 200, None, ""]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(X.plain_label(F.col("t")).alias("k")).collect()]
    assert got == ["step of sigma-1, 5-HT1A", "", "a b", "x" * 90, None, ""]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.search_label(F.lit(t).cast("string"))) for t in ("spec:41", "41", "a-1-b", None)] == ["spec", "?", "a--b", "?"]
    refs = F.create_map(F.lit(1), F.lit("see [2] there"), F.lit(2), F.lit(""), F.lit(7), F.lit("seven"))
    assert [one(X.resolved(F.lit(t).cast("string"), refs)) for t in ("[1][7]", "a [2] b [3] c [07]", "[12345]", "", "plain", None)] == ["see [2] thereseven", "a [2] b [3] c seven", "[12345]", "", "plain", None]
