"""Weights and thresholds of the evidence model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Weights of evidence grades and of directness, strongest first; a rank is the position from 1.
GRADES = (
    ("meta_analysis", 1.00), ("systematic_review", 0.95), ("rct", 0.85), ("cohort", 0.55), ("case_control", 0.45),
    ("case_series", 0.25), ("case_report", 0.15), ("preclinical", 0.10), ("opinion", 0.05),
)
DIRECTNESS = (("direct", 1.00), ("partial", 0.60), ("indirect", 0.30), ("extrapolated", 0.12))
# Retrieval and ranking.
RRF_K, MIN_COSINE, MINMAX_FLOOR, CONTRA_SEATS = 60, 0.45, 0.05, 2
NOVELTY_WEIGHT, CONFLICT_WEIGHT, GAP_WEIGHT = 0.45, 0.35, 0.20
# Limits.
COVERAGE_CAP, CONFLICT_CAP, MAX_ROUNDS, HUMAN_QUEUE, AUTO_QUEUE, IN_FLIGHT, MIN_ARTICLES, EVIDENCE_K = 40, 10, 3, 5, 15, 4, 2, 10
CHUNK_CHARS, OVERLAP_CHARS, MIN_CHARS = 1600, 200, 40


def scale_levels(spark: SparkSession) -> DataFrame:
    """scale_id, axis, value, weight and rank; scale 2 halves the directness weights of scale 1."""
    rows = [(s, "grade", v, w, r) for s in (1, 2) for r, (v, w) in enumerate(GRADES, 1)]
    rows += [(s, "directness", v, w / s, r) for s in (1, 2) for r, (v, w) in enumerate(DIRECTNESS, 1)]
    return spark.createDataFrame(rows, "scale_id int, axis string, value string, weight double, rank int")


def levels_sql() -> str:
    rows = [f"({s},'grade','{v}',{w}::DOUBLE,{r})" for s in (1, 2) for r, (v, w) in enumerate(GRADES, 1)]
    rows += [f"({s},'directness','{v}',{w}::DOUBLE/{s},{r})" for s in (1, 2) for r, (v, w) in enumerate(DIRECTNESS, 1)]
    return "scale_levels(scale_id, axis, value, weight, rank) AS (VALUES " + ", ".join(rows) + ")"
