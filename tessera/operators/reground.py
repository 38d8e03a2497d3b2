"""Chains of reasoning as JSON, read, grounded anew in evidence and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = "array<struct<claim: string, supported: boolean, evidence: string>>"
LINKS = "array<struct<index: int, now_supported: boolean, evidence: string>>"


def steps(chain_json: Column) -> Column:
    """The steps of a chain; an empty list where none is there."""
    return F.coalesce(F.from_json(chain_json, STEPS), F.array().cast(STEPS))


def anchored_steps(chain: Column) -> Column:
    """How many steps are supported by named evidence."""
    return F.size(F.filter(chain, lambda s: F.coalesce(s["supported"], F.lit(False)) & (F.coalesce(s["evidence"], F.lit("")) != "")))


def reground(chains: DataFrame, answers: DataFrame, shown: DataFrame) -> DataFrame:
    """Chains after an answer says which assumed steps the evidence supports now.

    chains: hypothesis_id, chain_json; answers: hypothesis_id, answer_json (links with the number of a step from 1, whether it is supported
    now, and by what); shown: hypothesis_id, ids (the evidence that the answer was given).  A link counts if its step was assumed and it names
    evidence that was shown; the last link of a step holds.  A chain without an assumed step is left alone; one without evidence is only
    marked; an answer that is missing or can't be read changes and marks nothing.

    Returns hypothesis_id, chain_json, anchored (links that counted), refused (links on assumed steps that name something else), marked.
    """
    c = chains.join(answers, "hypothesis_id", "left").join(shown, "hypothesis_id", "left")
    c = c.withColumn("steps", steps(F.col("chain_json"))).withColumn("links", F.from_json("answer_json", LINKS)).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    assumed = lambda i: ~F.coalesce(F.try_element_at("steps", i)["supported"], F.lit(False))
    named = lambda x: F.regexp_replace(F.replace(x, F.lit("PMID:"), F.lit("")), r"^\s+|\s+$", "")
    on_steps = F.filter("links", lambda x: F.coalesce(x["index"].between(1, F.size("steps")) & x["now_supported"] & assumed(F.greatest(x["index"], F.lit(1))), F.lit(False)))
    c = c.withColumn("open", F.exists("steps", lambda s: ~F.coalesce(s["supported"], F.lit(False)))).withColumn("links", F.when(F.col("open") & (F.size("ids") > 0), on_steps))
    c = c.withColumn("links", F.transform("links", lambda x: F.struct(x["index"].alias("index"), named(x["evidence"]).alias("name"))))
    c = c.withColumn("taken", F.coalesce(F.filter("links", lambda x: F.coalesce(F.array_contains("ids", x["name"]), F.lit(False))), F.array().cast("array<struct<index: int, name: string>>")))

    def renewed(s: Column, i: Column) -> Column:
        mine = F.filter("taken", lambda x: x["index"] == i + 1)
        name = F.try_element_at(mine, F.lit(-1))["name"]
        return F.struct(s["claim"].alias("claim"), (F.coalesce(s["supported"], F.lit(False)) | name.isNotNull()).alias("supported"), F.when(name.isNotNull(), F.concat(F.lit("PMID:"), name)).otherwise(s["evidence"]).alias("evidence"))

    written_back = F.to_json(F.transform("steps", renewed), {"ignoreNullFields": "false"})
    return c.select(
        "hypothesis_id", F.when(F.size("taken") > 0, written_back).otherwise(F.col("chain_json")).alias("chain_json"), F.size("taken").alias("anchored"),
        (F.coalesce(F.size("links"), F.lit(0)) - F.size("taken")).alias("refused"), (F.col("open") & ((F.size("ids") == 0) | F.col("links").isNotNull())).alias("marked"),
    )
