"""A stored inverted index with upper bounds: the best documents of a query without a row for each pair of a query and a document that share a word.

Documents are dealt to parts of bounded size by a hash of their ids; a part has a row for each of its tokens, a block, with the
token's postings there and how much any of them can add to a score.

A search takes one of two ways for each query, and is exact on both.  Where the rarest tokens, with few postings together, give
scores that all other tokens together stay below, only documents found by these can be among the best, and of the
other tokens only the blocks of candidates that may still be among them are opened.  All other queries meet the postings
of their tokens part by part: a part adds up its scores in arrays and hands on the best of each query alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.semantics import tokens
from tessera.sources import shared

K1, B = 1.2, 0.75
#: Documents of a part, about.
BLOCK = 16_384
#: Postings of a query's rarest tokens that are looked at one by one.
FEW = 1024
#: A token that one in so many documents of a part has takes a row over all of them, so rows take no more than so many times the postings.
OFTEN = 8
#: Queries that a part answers at a time.
ASKED = 16_384
#: Scores are ranked by six decimals, so what is closer than this is not told apart by bounds.
MARGIN = 2e-6
BLOCKS = "part long, token string, df long, max_tf int, min_dl int, ids array<bigint>, tfs array<int>, dls array<int>"


class Index(NamedTuple):
    """blocks (part, token, df, max_tf, min_dl, and ids, tfs, dls of its postings), terms (token, df, max_tf, min_dl), words (part, doc_id, words) of the documents,
    how many parts, removed doc_ids, how many documents and tokens there are.

    The block of the token "" has all documents of its part, tfs being how many rows are alike."""

    blocks: DataFrame
    terms: DataFrame
    words: DataFrame
    parts: int
    removed: DataFrame | None
    n: int
    length: int


class Hits(NamedTuple):
    """rows (query_id, doc_id, score) and the blocks that were opened for them (token, part)."""

    rows: DataFrame
    opened: DataFrame


def _gain(tf, dl, average: float):
    """Of columns as of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _part(doc_id: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("long")


def _postings(blocks: DataFrame, *columns: str) -> DataFrame:
    """columns, and doc_id, tf and dl of each posting."""
    names = {"ids": "doc_id", "tfs": "tf", "dls": "dl"}
    return blocks.select(*columns, F.inline(F.arrays_zip(*names))).withColumnsRenamed(names)


def _inverted(table: pa.Table) -> pa.Table:
    """Blocks of one part, from rows (part, doc_id, words); rows alike in id and length are one document."""
    words = table["words"].combine_chunks()
    split = pc.split_pattern(words, " ")
    sizes = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy())
    docs, at, alike = np.unique(np.stack((table["doc_id"].to_numpy(), sizes), axis=1), axis=0, return_inverse=True, return_counts=True)
    flat = split.flatten()
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    order = pc.array_sort_indices(flat.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # token and document of each posting as one number; the documents themselves come first, as the token ""
    key = (place[flat.indices.to_numpy()] + 1) * len(docs) + np.repeat(at.reshape(-1), sizes)
    key, tf = np.unique(key, return_counts=True)
    key, tf = np.concatenate((np.arange(len(docs)), key)), np.concatenate((alike, tf)).astype(np.int32)
    token, doc = np.divmod(key, len(docs))
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    ends = np.append(starts[1:], len(token))
    dl = docs[doc, 1].astype(np.int32)
    lists = pa.array(np.append(starts, len(token)), pa.int32())
    return pa.table({
        "part": pa.array(np.full(len(starts), table["part"][0].as_py())), "token": pa.concat_arrays([pa.array([""]), flat.dictionary.take(pa.array(order))]), "df": pa.array(ends - starts),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts)), "min_dl": pa.array(np.minimum.reduceat(dl, starts)),
        "ids": pa.ListArray.from_arrays(lists, pa.array(docs[doc, 0])), "tfs": pa.ListArray.from_arrays(lists, pa.array(tf)), "dls": pa.ListArray.from_arrays(lists, pa.array(dl)),
    })


def _blocks(words: DataFrame) -> DataFrame:
    return words.groupBy("part").applyInArrow(_inverted, BLOCKS)


def _counts(blocks: DataFrame) -> tuple[int, int]:
    """How many documents and tokens there are."""
    whole = _postings(blocks.filter("token = ''")).agg(F.sum("tf"), F.sum(F.col("tf") * F.col("dl").cast("long"))).first()
    return whole[0] or 0, whole[1] or 0


def build(docs: DataFrame, block: int = BLOCK) -> Index:
    """Index of docs (doc_id, text), written to the shared folder; the texts' tokens are shuffled once, to the parts of their documents.

    Null texts have no tokens and count as documents; rows without an id are left out; an empty table has an index that finds nothing."""
    words = F.coalesce(F.array_join(tokens(F.col("text")), " "), F.lit(""))  # no token has a blank
    words = shared.written(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")), "words")
    parts = max(1, -(-words.count() // block))
    words = words.select(_part("doc_id", parts).alias("part"), "doc_id", "words")
    blocks = shared.written(_blocks(words), "blocks")
    terms = blocks.filter("token <> ''").groupBy("token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    return Index(blocks, shared.written(terms, "terms"), words, parts, None, *_counts(blocks))


def removed(index: Index, gone: DataFrame) -> Index:
    """The index without the documents ``gone`` (doc_id): they are remembered as removed, and counts are those of what is left.

    Blocks stay as they are; their bounds hold for the rest too.  Ids that the index doesn't have change nothing."""
    gone = gone.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    if index.removed is not None:
        gone = gone.join(index.removed, "doc_id", "left_anti")
    gone = shared.written(gone, "removed")
    # what the removed documents alone have
    lost = shared.written(_blocks(index.words.join(gone, "doc_id", "left_semi")).select("token", "df", *(F.when(F.col("token") == "", F.col(c)).alias(c) for c in ("ids", "tfs", "dls"))), "lost")
    n, length = _counts(lost)
    lost = lost.groupBy("token").agg(F.sum("df").alias("lost"))
    left = index.terms.join(lost, "token", "left").withColumn("df", F.col("df") - F.coalesce("lost", F.lit(0))).drop("lost").filter("df > 0")
    all_ = gone if index.removed is None else gone.unionByName(index.removed)
    return Index(index.blocks, shared.written(left, "terms"), index.words, index.parts, shared.written(all_, "removed"), index.n - n, index.length - length)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, doc_id, score) of each query by six decimals, smaller ids first."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bound(rows: DataFrame, k: int) -> DataFrame:
    """query_id and least: what the k best reach, of queries that have so many."""
    return _best(rows, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "least")


def _best_of_part(k: int, average: float) -> Callable[[pa.Table], pa.Table]:
    """The k best documents of a part for each query, from blocks with their token's idf and queries; a row without idf has documents that were removed."""

    def run(table: pa.Table) -> pa.Table:
        gone = table.filter(pc.is_null(table["idf"]))["ids"].combine_chunks().flatten().to_numpy()
        table = table.filter(pc.is_valid(table["idf"]))
        ids, asked = table["ids"].combine_chunks(), table["queries"].combine_chunks()
        coded = ids.flatten().dictionary_encode()  # only the documents are sorted, not their postings
        order = np.argsort(coded.dictionary.to_numpy())
        docs, place = coded.dictionary.to_numpy()[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[coded.indices.to_numpy()]
        out = np.flatnonzero(np.isin(docs, gone))
        ends = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int64)
        tf, dl = (table[c].combine_chunks().flatten().to_numpy() for c in ("tfs", "dls"))
        gain = np.repeat(table["idf"].to_numpy(), np.diff(ends)) * _gain(tf.astype(float), dl, average)
        # postings of a token that many documents have are added up as a row over all documents
        often, whole = np.diff(ends) * OFTEN >= len(docs), {}
        queries = asked.flatten().dictionary_encode()
        code, block = queries.indices.to_numpy(), pc.list_parent_indices(asked).to_numpy()
        by_query = np.argsort(code, kind="stable")
        found, rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q, blocks in enumerate(np.split(block[by_query], np.cumsum(np.bincount(code, minlength=len(queries.dictionary)))[:-1])):
            spans = [slice(ends[b], ends[b + 1]) for b in blocks if not often[b]]
            score = np.bincount(np.concatenate([at[:0], *(at[s] for s in spans)]), np.concatenate([gain[:0], *(gain[s] for s in spans)]), len(docs)).astype(float)
            score[out] = 0
            some = np.flatnonzero(score > 0)  # k of these alone reach ``least``
            for b in blocks[often[blocks]].tolist():
                if b not in whole:
                    whole[b] = np.bincount(at[ends[b] : ends[b + 1]], gain[ends[b] : ends[b + 1]], len(docs))
                    whole[b][out] = 0
                score += whole[b]
            least = np.partition(score[some], len(some) - k)[len(some) - k] - MARGIN if len(some) > k else 0.0
            some = np.flatnonzero(score > max(least, 0.0))
            value = np.round(score[some], 6)
            if len(some) > k:
                enough = value >= np.partition(value, len(some) - k)[len(some) - k]
                some, value = some[enough], value[enough]
            some = some[np.lexsort((some, -value))[:k]]  # documents are in order of their ids
            found.append(np.full(len(some), q))
            rows.append(docs[some])
            scores.append(score[some])
        return pa.table({"query_id": queries.dictionary.take(pa.array(np.concatenate(found))), "doc_id": pa.array(np.concatenate(rows)), "score": pa.array(np.concatenate(scores))})

    return run


def search(index: Index, queries: DataFrame, k: int) -> Hits:
    """The k best documents of each query (query_id, text) by BM25, ranked by six decimals of the score and then by id; fewer where fewer have a token.

    Queries without a known token, with a null text or id find nothing."""
    average = index.length / index.n if index.length else 1.0
    # a query's tokens in order; what has the same ones is looked for once, under the number of their set
    words = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text")))))), " ")  # no token has a blank
    said = shared.written(queries.filter("query_id is not null").groupBy("query_id").agg(words.alias("words")).filter("words <> ''"), "said")
    sets = shared.written(said.select("words").distinct().select("words", F.monotonically_increasing_id().alias("set")), "sets")
    asked = sets.select(F.col("set").alias("query_id"), F.explode(F.split("words", " ")).alias("token"))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    t = asked.join(index.terms, "token").withColumn("idf", idf).withColumn("most", F.col("idf") * _gain(F.col("max_tf"), F.col("min_dl"), average))
    rare_first = Window.partitionBy("query_id").orderBy(F.desc("most"), "token").rowsBetween(Window.unboundedPreceding, 0)
    t = shared.written(t.withColumn("few", F.sum("df").over(rare_first) <= FEW).select("query_id", "token", "idf", "most", "few"), "asked")

    def scored(terms: DataFrame) -> DataFrame:
        p = _postings(index.blocks.join(terms.select("token", "query_id", "idf"), "token"), "query_id", "idf")
        p = p if index.removed is None else p.join(index.removed, "doc_id", "left_anti")
        return p.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * _gain(F.col("tf"), F.col("dl"), average)).alias("score"))

    found = shared.written(scored(t.filter("few")), "found")
    # queries of which what isn't found by few postings can't be among the best; tail: what the other tokens add at most
    tail = t.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("few"), F.col("most"))), F.lit(0.0)).alias("tail"))
    narrow = tail.join(_bound(found, k), "query_id", "left").filter((F.col("tail") == 0) | (F.col("tail") < F.col("least") - MARGIN))
    narrow = shared.written(narrow, "narrow")
    wide = shared.written(t.join(narrow.select("query_id"), "query_id", "left_anti"), "wide")

    kept = found.join(narrow, "query_id").fillna(0.0, ["least"]).filter(F.col("score") + F.col("tail") >= F.col("least") - MARGIN)
    others = t.filter("not few").join(narrow.select("query_id"), "query_id", "left_semi")
    # what the blocks of the other tokens can add to a candidate
    open_ = kept.join(others.select("query_id", "token", "idf"), "query_id").withColumn("part", _part("doc_id", index.parts))
    open_ = open_.join(index.blocks.select("token", "part", "max_tf", "min_dl"), ["token", "part"])
    open_ = open_.withColumn("add", F.sum(F.col("idf") * _gain(F.col("max_tf"), F.col("min_dl"), average)).over(Window.partitionBy("query_id", "doc_id")))
    open_ = shared.written(open_.filter(F.col("score") + F.col("add") >= F.col("least") - MARGIN).select("query_id", "doc_id", "token", "part", "idf"), "open")
    opened = open_.select("token", "part").distinct()
    rows = _postings(index.blocks.join(opened, ["token", "part"], "left_semi"), "token")
    more = open_.join(rows, ["token", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * _gain(F.col("tf"), F.col("dl"), average)).alias("more"))
    done = kept.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

    groups = -(-wide.select("query_id").distinct().count() // ASKED)
    if groups:
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("asking")
        askers = shared.written(wide.groupBy(group, "token").agg(F.max("idf").alias("idf"), F.collect_list("query_id").alias("queries")), "askers")  # about ASKED at most
        met = index.blocks.join(askers, "token").select("part", "asking", "idf", "queries", "ids", "tfs", "dls")
        if index.removed is not None:
            gone = index.removed.groupBy(_part("doc_id", index.parts).alias("part")).agg(F.collect_list("doc_id").alias("ids"))  # at most the documents of a part
            met = met.unionByName(gone.crossJoin(askers.select("asking").distinct()), allowMissingColumns=True)
        done = done.unionByName(met.groupBy("part", "asking").applyInArrow(_best_of_part(k, average), "query_id long, doc_id long, score double"))
    looked_at = t.filter("few").select("token").unionByName(wide.select("token")).distinct()
    first = index.blocks.select("token", "part").join(looked_at, "token", "left_semi")
    rows = _best(done, k).select(F.col("query_id").alias("set"), "doc_id", "score").join(said.join(sets, "words").select("query_id", "set"), "set")
    return Hits(rows.select("query_id", "doc_id", "score"), first.unionByName(opened).distinct())
