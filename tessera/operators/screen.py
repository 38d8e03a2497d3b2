"""Screening of a turn's texts by rules: terms in one text, co-terms anywhere in the turn."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.spotting import plain, spotted
from tessera.sources import shared

# Kinds of texts in which a term behind a negation isn't one; words that negate, up to 40 characters before in the same sentence; order of severity.
NEGATION_AWARE = ("user", "memory", "evidence")
NEGATORS = (r"não", r"nao", r"nunca", r"jamais", r"sem", r"suspend\w{0,20}", r"interromp\w{0,20}", r"never", r"denies", r"denied", r"without", r"no longer")
SEVERITY = {"high": 0, "medium": 1}


@dataclass(frozen=True)
class Rule:
    key: str
    severity: str
    terms: tuple[str, ...]
    co_terms: tuple[str, ...] = ()
    discontinuation: bool = False


def rule_tables(spark: SparkSession, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rules as tables: (rule, severity, severity_rank, discontinuation, paired) and their terms (rule, role, term, found); found is the term as it is spotted."""
    rules = list(rules)
    heads = [(r.key, r.severity, SEVERITY.get(r.severity, 9), r.discontinuation, bool(r.co_terms)) for r in rules]
    terms = {(r.key, role, t, plain(t)) for r in rules for role, some in (("term", r.terms), ("co", r.co_terms)) for t in some}
    return (
        spark.createDataFrame(heads, "rule string, severity string, severity_rank int, discontinuation boolean, paired boolean"),
        spark.createDataFrame(sorted(terms), "rule string, role string, term string, found string"),
    )


def alerts(segments: DataFrame, rules: tuple[Rule, ...] | tuple[DataFrame, DataFrame], turn: str, ambiguous: frozenset[str] = frozenset(), negators: tuple[str, ...] = NEGATORS) -> DataFrame:
    """turn, rule, severity, severity_rank, texts (how many set it off) and first_ref (the least of them) of every alert.

    segments: turn, kind, ref, text; rules: as such or as ``rule_tables``.  A term of an aware text (NEGATION_AWARE) counts only outside of
    negations, unless the rule is about stopping.  A person's own text doesn't count for ambiguous
    forms, such as a name that the system itself has.  Co-terms may be in another text of the turn; negations count for them only
    if they do for every text of the turn.  A term that begins in one text and ends in the next isn't found.

    Texts are read once whatever the rules are; what is found meets the rules in joins."""
    spark = segments.sparkSession
    heads, terms = rules if rules and isinstance(rules[0], DataFrame) else rule_tables(spark, rules)
    aware = F.coalesce(F.col("kind").isin(*NEGATION_AWARE), F.lit(False))
    own = F.col("kind") == "user"
    s = segments.select(F.col(turn).alias("turn"), F.col("ref").alias("ref"), aware.alias("aware"), F.coalesce(own, F.lit(False)).alias("own"), "text")
    hits = spotted(s, terms.select("term"), ["turn", "ref", "aware", "own"], negators).withColumnRenamed("term", "found")
    barred = terms.select("rule", "role", "found", F.col("term").isin(*ambiguous).alias("ambiguous")) if ambiguous else terms.select("rule", "role", "found", F.lit(False).alias("ambiguous"))
    met = shared.written(hits.join(barred, "found").join(heads.select("rule", "discontinuation"), "rule"), "hits")
    fired = met.filter((F.col("role") == "term") & ~(F.col("own") & F.col("ambiguous")) & (F.col("free") | ~F.col("aware") | F.col("discontinuation")))
    fired = fired.groupBy("turn", "rule").agg(F.count_distinct(F.coalesce("ref", F.lit(""))).alias("texts"), F.min("ref").alias("first_ref"))
    turns = s.groupBy("turn").agg(F.min("aware").alias("all_aware"))
    beside = met.filter("role = 'co'").groupBy("turn", "rule").agg(F.max(F.col("free") | F.col("discontinuation")).alias("plain"))
    out = fired.join(heads, "rule").join(beside, ["turn", "rule"], "left").join(turns, "turn")
    out = out.filter(~F.col("paired") | (F.col("plain").isNotNull() & (F.col("plain") | ~F.col("all_aware"))))
    return out.select(F.col("turn").alias(turn), "rule", "severity", "severity_rank", "texts", "first_ref")


def implicated(texts: DataFrame, key: str, forms: dict[str, tuple[str, ...]], properties: dict[str, tuple[str, ...]], phrases: dict[str, tuple[str, ...]], negators: tuple[str, ...] = ()) -> DataFrame:
    """key and concept of texts that name a concept by one of its forms, or a property that it has by one of the property's phrases; with negators only outside of negations."""
    names = {(concept, form) for concept, own in forms.items() for form in (*own, *(p for prop in properties.get(concept, ()) for p in phrases.get(prop, ())))}
    table = texts.sparkSession.createDataFrame(sorted((c, t, plain(t)) for c, t in names), "concept string, term string, found string")
    hits = spotted(texts.select(F.col(key).alias("key"), "text"), table.select("term"), ["key"], negators).filter("free")
    return hits.withColumnRenamed("term", "found").join(table, "found").select(F.col("key").alias(key), "concept").distinct()


def probed(spark: SparkSession, probes: list[dict], rules: Iterable[Rule], ambiguous: frozenset[str] = frozenset()) -> DataFrame:
    """probe, missing (rules that must fire and don't) and wrong (rules that must not and do) of every probe; a rule that doesn't exist is missing."""
    segments = spark.createDataFrame([(p["id"], s.get("kind", "user"), s.get("ref", ""), s["text"]) for p in probes for s in p["segments"]], "probe string, kind string, ref string, text string")
    fired = alerts(segments, tuple(rules), "probe", ambiguous).groupBy("probe").agg(F.collect_set("rule").alias("fired"))
    asked = spark.createDataFrame([(p["id"], list(p["must_fire"]), list(p["must_not_fire"])) for p in probes], "probe string, must array<string>, never array<string>")
    a = asked.join(fired, "probe", "left").withColumn("fired", F.coalesce("fired", F.array().cast("array<string>")))
    return a.select("probe", F.array_except("must", "fired").alias("missing"), F.array_intersect("never", "fired").alias("wrong"))
