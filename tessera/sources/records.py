"""Readers of landed source responses: search results, articles, pages' rules, profiles.

The engine makes no network calls; responses that a harvester has stored as files
are read as tables."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.levels import GRADES
from tessera.operators.screen import Rule

# Publication types of articles and the evidence grades that they stand for.
TYPE_GRADES = {
    "Meta-Analysis": "meta_analysis",
    "Network Meta-Analysis": "meta_analysis",
    "Systematic Review": "systematic_review",
    "Practice Guideline": "systematic_review",
    "Guideline": "systematic_review",
    "Consensus Development Conference": "systematic_review",
    "Randomized Controlled Trial": "rct",
    "Controlled Clinical Trial": "rct",
    "Case Reports": "case_report",
    "Observational Study": "cohort",
    "Comparative Study": "cohort",
    "Editorial": "opinion",
    "Comment": "opinion",
    "Letter": "opinion",
    "Review": "opinion",
}
ARTICLE = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,
  Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>, PublicationTypeList: struct<PublicationType: array<string>>>>,
  PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"""


def dig(payload: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, numbers being list places; null where a step is missing."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(payload, "$" + steps)


def search_ids(spark: SparkSession, path: str, id_path: str = "esearchresult.idlist") -> DataFrame:
    """Identifiers listed in stored search responses, each file one response."""
    return ids_in(spark.read.text(path, wholetext=True), id_path)


def ids_in(responses: DataFrame, id_path: str = "esearchresult.idlist") -> DataFrame:
    """external_id of all that responses (value) list, each once; null and malformed responses list nothing."""
    ids = F.from_json(dig(F.col("value"), id_path), "array<string>")
    return responses.select(F.explode(ids).alias("external_id")).distinct()


def fetched(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row for each stored JSON response, with the fields that a declaration names by path."""
    return fields_of(spark.read.text(path, wholetext=True), fields)


def fields_of(responses: DataFrame, fields: dict[str, str], *keep: str) -> DataFrame:
    """The declared fields of responses (value), beside the columns to keep; null where a path leads nowhere."""
    return responses.select(*keep, *[dig(F.col("value"), p).alias(n) for n, p in fields.items()])


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of stored XML: external_id, title, journal, year, doi, design, passages (label, text).

    Articles that can't be parsed or have no abstract are left out; the design is
    the strongest grade of the publication types."""
    return articles_in(spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "DROPMALFORMED").schema(ARTICLE).load(path))


def articles_in(raw: DataFrame) -> DataFrame:
    """The same from parsed articles (columns of ARTICLE)."""
    a, issue = "MedlineCitation.Article", "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    rank = {g: i for i, (g, _) in enumerate(GRADES)}
    types = F.col(f"{a}.PublicationTypeList.PublicationType")
    found = [F.when(F.array_contains(types, t), F.struct(F.lit(rank[g]).alias("r"), F.lit(g).alias("g"))) for t, g in TYPE_GRADES.items()]
    year = F.coalesce(F.col(f"{issue}.Year"), F.substring(f"{issue}.MedlineDate", 1, 4)).try_cast("int")
    doi = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "doi")
    passages = F.filter(F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda x: F.struct(x["_Label"].alias("section"), F.trim(x["_VALUE"]).alias("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    out = raw.select(
        F.col("MedlineCitation.PMID").alias("external_id"), F.trim(F.col(f"{a}.ArticleTitle")).alias("title"), F.col(f"{a}.Journal.Title").alias("journal"), year.alias("year"),
        F.try_element_at(doi, F.lit(1))["_VALUE"].alias("doi"), F.array_min(F.array_compact(F.array(*found)))["g"].alias("design"), passages.alias("passages"),
    )
    return out.filter(F.col("external_id").isNotNull() & (F.size("passages") > 0))


def web_results(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """Hits of stored web searches: response, position, title, url, text; hits without an address are left out."""
    raw = spark.read.schema(HITS).json(path, multiLine=True).select(F.input_file_name().alias("response"), "web")
    return hits_in(raw, limit)


HITS = "web struct<results: array<struct<title: string, url: string, description: string, extra_snippets: array<string>>>>"


def hits_in(responses: DataFrame, limit: int = 10) -> DataFrame:
    """The same from parsed responses (response, web)."""
    raw = responses.select("response", F.posexplode("web.results").alias("place", "hit"))
    hits = raw.filter(F.coalesce(F.trim("hit.url"), F.lit("")) != "")
    text = F.concat_ws(" ", F.col("hit.description"), F.array_join(F.coalesce(F.col("hit.extra_snippets"), F.array()), " "))
    ranked = hits.withColumn("position", F.row_number().over(Window.partitionBy("response").orderBy("place"))).filter(F.col("position") <= limit)
    return ranked.select("response", "position", "hit.title", "hit.url", text.alias("text"))


def crawl_delay(rules: Column) -> Column:
    """Seconds between requests that a rules file asks for; null if it doesn't or the number is bad."""
    found = F.regexp_extract(rules, r"(?im)^\s*crawl-delay\s*:\s*([0-9.]+)", 1)
    return F.when(found != "", found.try_cast("double"))


def robots_policy(status: Column, rules: Column, url: Column | None = None, agent: str = "tessera") -> Column:
    """allow, rate_per_s: no rules file (404, 410) allows, any other failure forbids; else the rules for
    the agent decide about the address (the host's root if none is given), and a delay limits the rate."""

    @F.pandas_udf("boolean")
    def allowed(rules: pd.Series, url: pd.Series) -> pd.Series:
        out, parsed = [], {}
        for text, at in zip(rules, url):
            text = text or ""
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            out.append(parsed[text].can_fetch(agent, at or "/"))
        return pd.Series(out)

    allow = F.when(status.isin(404, 410), True).when(status != 200, False).otherwise(allowed(rules, F.lit("/") if url is None else url))
    return F.struct(F.coalesce(allow, F.lit(False)).alias("allow"), F.try_divide(F.lit(1.0), crawl_delay(rules)).alias("rate_per_s"))


def _table(path: Path) -> dict:
    return tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


#: Texts of a profile that must each name one of its standing risks.
BOUND_TEXTS = ("extract_bind", "question_bind", "speculation_bind")


def _risk_problems(focus: dict) -> list[str]:
    """What is wrong with the standing risks: patterns that miss their own prose or hit a counter-example, and texts that name no risk."""
    out, patterns = [], []
    for risk in focus.get("standing_risks", []):
        try:
            patterns.append(pattern := re.compile(risk["pattern"], re.IGNORECASE))
        except re.error as e:
            out.append(f"risk {risk['name']}: the pattern is none ({e})")
            continue
        if not pattern.search(" ".join(risk.get("prose", "").split())):
            out.append(f"risk {risk['name']}: the pattern misses its own prose")
        out += [f"risk {risk['name']}: the pattern hits {x!r}" for x in risk.get("must_not_match", []) if pattern.search(x)]
    if patterns:
        out += [f"{name} names no standing risk" for name in BOUND_TEXTS if name in focus and not any(p.search(" ".join(focus[name].split())) for p in patterns)]
    return out


def _safety_problems(safety: dict) -> list[str]:
    """What is wrong with the rules: unknown concepts, and rules that nothing can set off."""
    known = {c["key"] for c in safety.get("concepts", [])}
    out = [] if known else ["safety: no concepts"]
    for rule in safety.get("rules", []):
        if extra := sorted(set(rule.get("concepts", [])) - known):
            out.append(f"rule {rule['key']}: unknown concepts {extra}")
        if not rule.get("concepts") and not rule.get("terms"):
            out.append(f"rule {rule['key']}: neither concepts nor terms")
    return out


def load_profile(folder: str) -> dict:
    """A focus profile from its TOML files focus, strategies, taxonomy and safety, checked; every problem is named in one error.

    The slug is the folder's name, a target is given, the four directness levels are there and no
    other, risks tell their prose from their counter-examples, bound texts name a risk, rules point at concepts
    that exist; a copy that nobody has gone over yet (scaffold_pending) is refused. safety = false in focus.toml does without rules."""
    root = Path(folder)
    focus, problems = _table(root / "focus.toml"), []
    if focus.get("scaffold_pending"):
        problems.append("the profile is still a copy of another (scaffold_pending)")
    if focus.get("slug") != root.name:
        problems.append("the slug differs from the folder's name")
    if not str(focus.get("target", "")).strip():
        problems.append("the target is blank")
    if set(focus.get("directness", {})) != {"direct", "partial", "indirect", "extrapolated"}:
        problems.append("directness needs its four levels")
    problems += _risk_problems(focus)
    safety = {} if focus.get("safety") is False else _table(root / (focus["safety"] if isinstance(focus.get("safety"), str) else "safety.toml"))
    problems += _safety_problems(safety) if safety else []
    if problems:
        raise ValueError("; ".join(problems))
    return {**focus, "strategies": _table(root / "strategies.toml").get("strategies", []), "classes": _table(root / "taxonomy.toml").get("classes", []), "safety": safety}


def rules_of(profile: dict) -> tuple[Rule, ...]:
    """The rules of a profile for ``screen.alerts``: their terms and the forms of their concepts."""
    forms = {c["key"]: tuple(c.get("forms", ())) for c in profile["safety"].get("concepts", [])}
    return tuple(
        Rule(r["key"], r.get("severity", "medium"), (*r.get("terms", ()), *(f for c in r.get("concepts", ()) for f in forms[c])), tuple(r.get("co_terms", ())), bool(r.get("discontinuation")))
        for r in profile["safety"].get("rules", [])
    )


def classes_of(spark: SparkSession, profile: dict) -> DataFrame:
    """label and keyword of the classes of a profile's taxonomy."""
    rows = [(c["label"], k) for c in profile["classes"] for k in c.get("keywords", [])]
    return spark.createDataFrame(rows, "label string, keyword string")


def search_specs(spark: SparkSession, profile: dict) -> DataFrame:
    """One row for each strategy and query of a profile."""
    rows = [(s["name"], s.get("expected_directness"), float(s.get("priority", 0.5)), int(s.get("limit", 20)), q) for s in profile["strategies"] for q in s["queries"]]
    return spark.createDataFrame(rows, "strategy string, expected_directness string, priority double, limit int, query string")


CASE_KEYS = frozenset({"id", "question", "expect", "why", "must_cite", "requires"})
REQUIRED = frozenset({"min_sources", "max_sources", "design", "text"})


def load_cases(path: str, keys: frozenset[str] = CASE_KEYS) -> list[dict]:
    """Cases of a gold set. Unknown keys, repeated ids, other expectations than answerable and unanswerable, and preconditions with unknown keys are errors."""
    cases, seen = _table(Path(path)).get("cases", []), set()
    for c in cases:
        if extra := set(c) - keys:
            raise ValueError(f"case {c.get('id')}: unknown keys {sorted(extra)}")
        if c.get("id") in seen:
            raise ValueError(f"case {c.get('id')}: the id repeats")
        seen.add(c.get("id"))
        if c.get("expect", "answerable") not in ("answerable", "unanswerable"):
            raise ValueError(f"case {c.get('id')}: expect {c['expect']!r}")
        if extra := set(c.get("requires", {})) - REQUIRED:
            raise ValueError(f"case {c.get('id')}: unknown preconditions {sorted(extra)}")
    return cases


PROBE_KEYS, SEGMENT_KEYS = frozenset({"id", "why", "must_fire", "must_not_fire", "segments"}), frozenset({"kind", "text", "ref"})


def load_probes(path: str) -> list[dict]:
    """Probes of a rule set: turns with the rules that must fire on them and those that must not. A probe needs both lists, and segments; unknown keys and repeated ids are errors."""
    probes, seen = _table(Path(path)).get("probes", []), set()
    for p in probes:
        if extra := set(p) - PROBE_KEYS:
            raise ValueError(f"probe {p.get('id')}: unknown keys {sorted(extra)}")
        if missing := {"id", "must_fire", "must_not_fire"} - set(p):
            raise ValueError(f"probe {p.get('id')}: {sorted(missing)} missing")
        if p["id"] in seen:
            raise ValueError(f"probe {p['id']}: the id repeats")
        seen.add(p["id"])
        if not p.get("segments") or any(set(s) - SEGMENT_KEYS or "text" not in s for s in p["segments"]):
            raise ValueError(f"probe {p['id']}: segments need a kind and a text and nothing else")
    return probes
