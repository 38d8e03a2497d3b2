"""Weights of claims relative to a focus, and why claims have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import count_if
from tessera.sources.evidence import Evidence


def levels_of(ev: Evidence, axis: str, key: str, prefix: str) -> DataFrame:
    """The levels of one axis with columns named for a join: scale, key, weight and rank."""
    lv = ev.levels.filter(F.col("axis") == axis)
    return lv.select(F.col("scale_id").alias("level_scale"), F.col("value").alias(key), F.col("weight").alias(f"{prefix}_weight"), F.col("rank").alias(f"{prefix}_rank"))


def with_level(df: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    return df.join(levels, (df["scale_id"] == levels["level_scale"]) & (df[key] == levels[key])).drop("level_scale").drop(levels[key])


def claim_weight(ev: Evidence) -> DataFrame:
    """Verified or not, every claim that has a weight for the active focus: weight = grade x directness x confidence.

    Inner joins on purpose: without a judgment for the focus, a level on the
    focus's scale, or a focus, a claim has no weight; out-of-scope claims neither."""
    c = ev.claims.crossJoin(ev.active_focus).filter(F.col("scale_id") == F.col("focus_scale"))
    judged = ev.directness.filter(~F.col("out_of_scope")).select("claim_id", "focus_id", "directness")
    c = c.join(judged, ["claim_id", "focus_id"])
    c = with_level(c, levels_of(ev, "grade", "grade", "grade"), "grade")
    c = with_level(c, levels_of(ev, "directness", "directness", "directness"), "directness")
    return c.withColumn("weight", F.col("grade_weight") * F.col("directness_weight") * F.col("confidence"))


def loss_classes(ev: Evidence) -> DataFrame:
    """Verified claims by what became of their weight, one pass."""
    c = ev.claims.filter("verified").join(ev.active_focus, F.lit(True), "left")
    j = ev.directness.select("claim_id", "focus_id", "directness", "out_of_scope")
    c = c.join(j, ["claim_id", "focus_id"], "left")
    kind = (
        F.when(F.col("focus_scale").isNull(), "no_focus").when(~F.col("scale_id").eqNullSafe(F.col("focus_scale")), "off_scale")
        .when(F.col("directness").isNull(), "unjudged").when(F.col("out_of_scope"), "out_of_scope").otherwise("weighted")
    )
    return c.groupBy(kind.alias("loss_class")).agg(F.count(F.lit(1)).alias("claims"))


def scoreboard(ev: Evidence) -> DataFrame:
    """Support and contradiction of each hypothesis; claims without a weight are counted, not weighed."""
    cw = claim_weight(ev).filter("verified").select("claim_id", "weight")
    linked = ev.links.join(cw, "claim_id", "left")
    product = F.col("weight") * F.col("modulator")
    per = linked.groupBy("hypothesis_id").agg(
        F.sum(F.when(F.col("polarity") == "supports", product)).alias("support"), F.sum(F.when(F.col("polarity") == "contradicts", product)).alias("contra"),
        F.count(F.lit(1)).alias("n_claims"), count_if(F.col("weight").isNull()).alias("n_unweighted"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ev.hypotheses.join(per, "hypothesis_id", "left").select("hypothesis_id", "focus_id", "tier", "statement", zero("support"), zero("contra"), zero("n_claims"), zero("n_unweighted"))


def chain_scores(ev: Evidence) -> DataFrame:
    """Chain length, anchored steps and plausibility of each hypothesis (0 without a chain)."""
    anchored = F.col("supported") & (F.coalesce("evidence", F.lit("")) != "")
    per = ev.chain.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("steps"), count_if(anchored).alias("anchored"))
    h = ev.hypotheses.join(per, "hypothesis_id", "left").fillna(0, ["steps", "anchored"])
    return h.withColumn("plausibility", F.coalesce(F.try_divide("anchored", "steps"), F.lit(0.0)))


def coverage(ev: Evidence) -> DataFrame:
    """Per intervention: counts, total weight, direction counts, best grade and directness, conflict and gap."""
    cw = claim_weight(ev).filter("verified").withColumn("key", F.lower(F.trim("intervention"))).filter("key <> ''")
    d = F.col("direction")
    g = cw.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), count_if(d == "positive").alias("pos"), count_if(d == "negative").alias("neg"),
        count_if(d.isin("null", "mixed")).alias("neutral"), F.min_by("grade", "grade_rank").alias("best_grade"), F.min_by("directness", "directness_rank").alias("best_directness"), F.max("directness_weight").alias("best_weight"),
    )
    both = F.col("pos") + F.col("neg")
    conflict = F.when(both >= 2, 1 - F.abs(F.col("pos") - F.col("neg")) / both).otherwise(0.0)
    return g.withColumn("conflict", conflict).withColumn("gap", 1 - F.col("best_weight")).drop("best_weight")
