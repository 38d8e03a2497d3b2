"""Corpus pipeline: toxicity filter, near-duplicate removal, passage removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; it is written as Parquet and read again as the next one's documents.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, paragraph_dedup, toxicity
from tessera.llm.runtime import clear, table, written, written_so_far


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects (score >= 0.3); all others stay as they are.

    Null and empty texts have no hits and stay, as do rows with null or repeated ids; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document with the smallest id.

    Rows that repeat an id go one by one, as their texts have it; copies under the smallest id, and rows with a null id, stay."""
    found = jaccard_join.near_duplicates(docs, percent=80)
    gone = written(found.filter("component_id <> doc_id").select("doc_id", "text_no").distinct(), "gone")
    return docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_no"]), "left_anti")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated paragraphs and passages out of the texts, but for their first place.

    No row is dropped; n_chars is that of the text that is left."""
    spans = written(paragraph_dedup.repeats(docs, percent=80), "spans")
    cut = paragraph_dedup.without(docs, spans)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold the template of a benchmark item; of rows that repeat an id those whose text does; rows with a null id stay."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = written(found.filter("doc_id is not null").select("doc_id", "text_key").distinct(), "leaks")
    return docs.join(leaks.hint("shuffle_hash"), (docs["doc_id"] == leaks["doc_id"]) & (decontaminate.text_key(docs["text"]) == leaks["text_key"]), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each row of documents; a null text counts as an empty one; an empty table gives no rows."""
    return bpe.encode_decode(docs, bpe.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("paragraph_dedup", drop_passages),
    ("decontaminate", drop_contaminated),
    ("bpe", tokens),
]

#: The first stage scores with a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has written for itself goes with it."""
    docs, before = table(spark, sf_dir, "documents"), written_so_far(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, before, docs)
    return docs
