"""Readers of landed responses on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import records as S

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle>One</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2001 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>
<Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText Label="END">Seen.</AbstractText></Abstract><PublicationTypeList><PublicationType>Comment</PublicationType><PublicationType>Randomized Controlled Trial</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = S.articles(spark, str(tmp_path / "a.xml")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.external_id, r.title, r.journal, r.year, r.doi, r.design) == ("11", "One", "J", 2001, "10.1/x", "rct")
    assert [tuple(p) for p in r.passages] == [("AIM", "To see."), ("END", "Seen.")]


def test_json_responses(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"esearchresult": {"idlist": ["3", "4", "3"]}}))
    assert sorted(r[0] for r in S.search_ids(spark, str(tmp_path / "s.json")).collect()) == ["3", "4"]
    (tmp_path / "f.json").write_text(json.dumps({"a": [{"b": {"c": "deep"}}], "n": 5}))
    assert tuple(S.fetched(spark, str(tmp_path / "f.json"), {"x": "a.0.b.c", "y": "n", "z": "a.1.b"}).first()) == ("deep", "5", None)


def test_web_results(spark, tmp_path):
    hits = [{"title": "t", "url": "", "description": "d"}, {"title": "u", "url": "http://x", "description": "d", "extra_snippets": ["e", "f"]}, {"title": "v", "url": "http://y", "description": "g"}]
    (tmp_path / "w.json").write_text(json.dumps({"web": {"results": hits}}))
    assert [(r.position, r.url, r.text) for r in S.web_results(spark, str(tmp_path / "w.json"), 1).collect()] == [(1, "http://x", "d e f")]


@pytest.mark.parametrize("status,rules,allow,rate", [(404, "", True, None), (500, "", False, None), (200, "User-agent: *\nDisallow: /\n", False, None), (200, "Crawl-delay: 2\nDisallow: /x", True, 0.5), (200, "Crawl-delay: z", True, None)])
def test_robots(spark, status, rules, allow, rate):
    r = spark.range(1).select(S.robots_policy(F.lit(status), F.lit(rules)).alias("p")).first()[0]
    assert (r.allow, r.rate_per_s) == (allow, rate)


def test_profile(spark, tmp_path):
    root = tmp_path / "demo"
    root.mkdir()
    levels = "\n".join(f"[directness.{x}]\nprose='p'" for x in ("direct", "partial", "indirect", "extrapolated"))
    (root / "focus.toml").write_text(f"slug='demo'\ntarget='t'\n[[standing_risks]]\nname='r'\npattern='harm'\nprose='may harm'\nmust_not_match=['help']\n{levels}")
    (root / "strategies.toml").write_text("[[strategies]]\nname='s'\nqueries=['a','b']\n")
    assert [r.query for r in S.search_specs(spark, S.load_profile(str(root))).orderBy("query").collect()] == ["a", "b"]
    (root / "focus.toml").write_text("slug='other'\ntarget=' '")
    with pytest.raises(ValueError, match="slug.*blank.*four"):
        S.load_profile(str(root))
    (tmp_path / "g.toml").write_text("[[cases]]\nid='a'\nodd=1\n")
    with pytest.raises(ValueError, match="odd"):
        S.load_cases(str(tmp_path / "g.toml"))


def test_profile_checks(spark, tmp_path):
    from tessera.operators.screen import alerts

    root = tmp_path / "demo"
    root.mkdir()
    levels = "\n".join(f"[directness.{x}]\nprose='p'" for x in ("direct", "partial", "indirect", "extrapolated"))
    risk = "[[standing_risks]]\nname='r'\npattern='harm'\nprose='may\\n harm'\n"
    (root / "focus.toml").write_text("slug='demo'\ntarget='t'\nextract_bind='mind the harm'\n" + risk.replace("'may\\n harm'", '"may\\n harm"') + levels)
    (root / "taxonomy.toml").write_text("[[classes]]\nlabel='l'\nkeywords=['a','b']\n")
    (root / "safety.toml").write_text("[[concepts]]\nkey='c'\nforms=['form one']\n[[rules]]\nkey='k'\nseverity='high'\nconcepts=['c']\n")
    p = S.load_profile(str(root))
    assert sorted(r.keyword for r in S.classes_of(spark, p).collect()) == ["a", "b"]
    seg = spark.createDataFrame([(1, "reply", "x", "a Form  one here"), (2, "reply", "y", "none")], "turn int, kind string, ref string, text string")
    assert [(r.turn, r.rule, r.severity) for r in alerts(seg, S.rules_of(p), "turn").collect()] == [(1, "k", "high")]
    (root / "safety.toml").write_text("[[concepts]]\nkey='c'\n[[rules]]\nkey='k'\nconcepts=['d']\n[[rules]]\nkey='m'\n")
    (root / "focus.toml").write_text("slug='demo'\ntarget='t'\nscaffold_pending=true\nextract_bind='nothing'\n[[standing_risks]]\nname='r'\npattern='harm'\nprose='no'\nmust_not_match=['harmless']\n[[standing_risks]]\nname='q'\npattern='('\n" + levels)
    with pytest.raises(ValueError) as e:
        S.load_profile(str(root))
    for part in ("scaffold_pending", "misses its own prose", "hits 'harmless'", "risk q: the pattern is none", "extract_bind names no", "unknown concepts ['d']", "rule m: neither"):
        assert part in str(e.value)


@pytest.mark.parametrize("case,problem", [("id='a'\n[[cases]]\nid='a'", "repeats"), ("id='a'\nexpect='maybe'", "maybe"), ("id='a'\n[cases.requires]\nmin_source=1", "min_source"), ("id='a'\nexpect='answerable'\n[cases.requires]\nmin_sources=1", None)])
def test_cases_are_strict(tmp_path, case, problem):
    (tmp_path / "g.toml").write_text("[[cases]]\n" + case)
    if problem:
        with pytest.raises(ValueError, match=problem):
            S.load_cases(str(tmp_path / "g.toml"))
    else:
        assert len(S.load_cases(str(tmp_path / "g.toml"))) == 1


def test_probes(spark, tmp_path):
    import pytest

    from tessera.operators.screen import Rule, probed
    from tessera.sources.records import load_probes

    good = """
[[probes]]
id = "alone"
why = "the reason"
must_fire = ["mono"]
must_not_fire = ["other"]
[[probes.segments]]
kind = "evidence"
text = "Sertraline was added."
[[probes]]
id = "denied"
must_fire = []
must_not_fire = ["mono", "other"]
[[probes.segments]]
kind = "user"
text = "I never took sertraline"
[[probes]]
id = "fails"
must_fire = ["other", "gone"]
must_not_fire = ["mono"]
segments = [{kind = "reply", text = "sertraline"}]
"""
    at = tmp_path / "probes.toml"
    at.write_text(good)
    rules = (Rule("mono", "high", ("sertraline",)), Rule("other", "low", ("lithium",)))
    got = {r.probe: (sorted(r.missing), r.wrong) for r in probed(spark, load_probes(str(at)), rules).collect()}
    assert got == {"alone": ([], []), "denied": ([], []), "fails": (["gone", "other"], ["mono"])}
    for bad in (good.replace("why =", "reason ="), good.replace('id = "denied"', 'id = "alone"'), good.replace("must_fire = []\n", ""), good.replace("segments = [", "x = ["), good.replace('segments = [{kind = "reply", text = "sertraline"}]', "segments = []")):
        at.write_text(bad)
        with pytest.raises(ValueError):
            load_probes(str(at))
