"""Queries on retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.functions.semantics import tokens
from tessera.operators import inverted as I
from tessera.operators import retrieval as R
from tessera.operators import weight as W
from tessera.plans.registry import query
from tessera.plans.weighing import BASE, CW
from tessera.sources import shared
from tessera.sources.evidence import CHUNKS, Evidence, with_

TOKEN = "regexp_extract_all(lower(text), '[a-zà-ÿ0-9][a-zà-ÿ0-9\\-]*')"
BM = f"""tk AS (SELECT doc_id, len(t) AS dl, t FROM (SELECT chunk_id AS doc_id, {TOKEN} AS t FROM chunks)),
  p AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS token FROM tk) GROUP BY ALL),
  asked AS (SELECT item_id AS query_id, unnest(list_distinct({TOKEN})) AS token FROM benchmark), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk),
  bm AS (SELECT query_id, doc_id, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))) AS score FROM asked JOIN df USING (token) JOIN p USING (token), st GROUP BY 1,2),
  bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,6) DESC, doc_id) AS rank FROM bm)"""
#: The vector that stands for a question: the one with the question's number.  A vector belongs to the first chunk of the document of its number.
VEC = f"""qv AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS q FROM benchmark b JOIN embeddings e ON e.vec_id=b.item_id),
  vs AS (SELECT query_id, vec_id*{CHUNKS} AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS cosine FROM embeddings, qv),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine,9) DESC, doc_id) AS rank FROM vs)"""


def questions(ev: Evidence) -> DataFrame:
    return ev.read("benchmark").select(F.col("item_id").alias("query_id"), "text")


def question_vectors(ev: Evidence) -> DataFrame:
    return questions(ev).select("query_id").join(ev.read("embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def vectors(ev: Evidence) -> DataFrame:
    return ev.read("embeddings").select((F.col("vec_id") * CHUNKS).alias("doc_id"), "embedding")


def chunk_index(ev: Evidence) -> I.Index:
    """The stored index of the chunks, built when an application first asks for it and again when the documents' files change."""
    docs = ev.read("documents")
    return shared.kept(docs, "chunk-index", lambda: I.build(ev.chunks.select(F.col("chunk_id").alias("doc_id"), "text")))


def by_text(ev: Evidence, k: int) -> DataFrame:
    return R.ranked(I.search(chunk_index(ev), questions(ev), k).rows, "query_id", F.desc(F.round("score", 6)), "doc_id")


def by_vector(ev: Evidence, k: int) -> DataFrame:
    return R.nearest(vectors(ev), question_vectors(ev), k)


@query("fts_tokens", f"SELECT item_id, array_to_string({TOKEN}, ' ') AS tokens, len({TOKEN}) AS n FROM benchmark")
def fts_tokens(ev: Evidence) -> DataFrame:
    t = tokens(F.col("text"))
    return ev.read("benchmark").select("item_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query("bm25_topk", with_("chunks", "SELECT query_id, doc_id, rank, round(score,5) AS score FROM bmr WHERE rank<=10", BM))
def bm25_topk(ev: Evidence) -> DataFrame:
    return by_text(ev, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


LEFT = BM.replace("FROM chunks)", "FROM chunks WHERE source_id%10<>9)")


@query("bm25_after_removal", with_("chunks", "SELECT query_id, doc_id, rank, round(score,5) AS score FROM bmr WHERE rank<=10", LEFT))
def bm25_after_removal(ev: Evidence) -> DataFrame:
    """The index without the chunks of sources that aren't approved, as after their deletion."""
    index = I.removed(chunk_index(ev), ev.chunks.filter("source_id % 10 = 9").select(F.col("chunk_id").alias("doc_id")))
    found = R.ranked(I.search(index, questions(ev), 10).rows, "query_id", F.desc(F.round("score", 6)), "doc_id")
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("vector_topk", f"WITH {VEC} SELECT query_id, doc_id, rank, round(1-cosine,6) AS distance FROM vr WHERE rank<=20")
def vector_topk(ev: Evidence) -> DataFrame:
    return by_vector(ev, 20).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("cosine"), 6).alias("distance"))


FUSED = f"""{BM}, {VEC}, both_ AS (SELECT query_id, doc_id, rank, FALSE AS semantic FROM bmr WHERE rank<=40 UNION ALL SELECT query_id, doc_id, rank, TRUE FROM vr WHERE rank<=40 AND cosine>={L.MIN_COSINE}),
  fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE/({L.RRF_K}+rank)) AS fused, bool_or(semantic) AS semantic FROM both_ GROUP BY 1,2),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused,9) DESC, doc_id) AS rank FROM fu)"""


def fused(ev: Evidence) -> DataFrame:
    t = by_text(ev, 40).select("query_id", "doc_id", "rank", F.lit(1.0).alias("share"), F.lit(False).alias("semantic"))
    v = by_vector(ev, 40).filter(F.col("cosine") >= L.MIN_COSINE).select("query_id", "doc_id", "rank", F.lit(1.0).alias("share"), F.lit(True).alias("semantic"))
    # at most 80 rows a question: written, so that the tables they are joined to need no shuffle
    return shared.written(R.ranked(R.fuse(t.unionByName(v)), "query_id", F.desc(F.round("fused", 9)), "doc_id"), "fused")


@query("rrf_fusion", with_("chunks", "SELECT query_id, doc_id, round(fused,8) AS fused FROM fr", FUSED))
def rrf_fusion(ev: Evidence) -> DataFrame:
    return fused(ev).select("query_id", "doc_id", F.round("fused", 8).alias("fused"))


@query("hybrid_chunks", with_("sources chunks", "SELECT query_id, chunk_id, fr.rank, semantic, ord, title, md5(text) AS digest FROM fr JOIN chunks ON chunk_id=doc_id JOIN sources USING (source_id) WHERE fr.rank<=12", FUSED))
def hybrid_chunks(ev: Evidence) -> DataFrame:
    c = fused(ev).filter("rank <= 12").join(ev.chunks, F.col("doc_id") == F.col("chunk_id")).join(ev.sources.select("source_id", "title"), "source_id")
    return c.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "semantic", "ord", "title", F.md5("text").alias("digest"))


RETRIEVED = BASE + " sources chunks claim_chunks"
HITS = FUSED + """, mm AS (SELECT *, CASE WHEN max(fused) OVER w = min(fused) OVER w THEN 1.0 ELSE 0.05+0.95*(fused-min(fused) OVER w)/(max(fused) OVER w-min(fused) OVER w) END AS relevance
  FROM fr WHERE rank<=60 WINDOW w AS (PARTITION BY query_id)),
  rel AS (SELECT query_id, claim_id, max(relevance) AS relevance, bool_or(semantic) AS semantic FROM mm JOIN claim_chunks ON chunk_id=doc_id GROUP BY 1,2),
  hits AS (SELECT query_id, claim_id, round(relevance*(1+weight),7) AS score, direction IN ('negative','null') AS contra, semantic, cw.source_id, title FROM rel JOIN cw USING (claim_id) JOIN sources USING (source_id) WHERE verified)"""


def claim_hits(ev: Evidence) -> DataFrame:
    """Claims with a retrieved chunk: the best relevance among the chunks that a claim names, times one plus its weight."""
    c = fused(ev).filter("rank <= 60")
    c = c.withColumn("relevance", R.minmax(c, "query_id", "fused"))
    best = c.join(ev.claim_chunks.select("claim_id", "chunk_id"), F.col("doc_id") == F.col("chunk_id")).groupBy("query_id", "claim_id").agg(F.max("relevance").alias("relevance"), F.max("semantic").alias("semantic"))
    cw = W.claim_weight(ev).filter("verified").select("claim_id", "source_id", "direction", "weight")
    score = F.round(F.col("relevance") * (1 + F.col("weight")), 7)
    hits = best.join(cw, "claim_id").join(ev.sources.select("source_id", "title"), "source_id")
    return hits.select("query_id", "claim_id", score.alias("score"), F.col("direction").isin("negative", "null").alias("contra"), "semantic", "source_id", "title")


@query("claim_search", with_(RETRIEVED, "SELECT query_id, claim_id, score, source_id, title FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS r FROM hits) WHERE r<=15", CW + ", " + HITS))
def claim_search(ev: Evidence) -> DataFrame:
    h = R.ranked(claim_hits(ev), "query_id", F.desc("score"), "claim_id").filter("rank <= 15")
    return h.select("query_id", "claim_id", "score", "source_id", "title")


SEATS = f"""r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS r FROM hits),
  need AS (SELECT query_id, least(greatest(0, {L.CONTRA_SEATS}-count(*) FILTER (r<=15 AND contra)), count(*) FILTER (r>15 AND contra AND semantic), count(*) FILTER (r<=15 AND NOT contra)) AS m FROM r1 GROUP BY 1),
  up AS (SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS t FROM r1 WHERE r>15 AND contra AND semantic),
  low AS (SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS t FROM r1 WHERE r<=15 AND NOT contra)"""


@query("counter_seats", with_(RETRIEVED, """SELECT query_id, claim_id, contra, FALSE AS seated FROM r1 WHERE r<=15 AND NOT EXISTS (SELECT 1 FROM low JOIN need USING (query_id) WHERE low.query_id=r1.query_id AND low.claim_id=r1.claim_id AND t<=m)
  UNION ALL SELECT query_id, claim_id, TRUE, TRUE FROM up JOIN need USING (query_id) WHERE t<=m""", CW + ", " + HITS + ", " + SEATS))
def counter_seats(ev: Evidence) -> DataFrame:
    return R.counter_seats(claim_hits(ev), 15).select("query_id", "claim_id", "contra", "seated")


AGAIN = 10_000_000


@query("semantic_dedup", with_("questions", f"""SELECT a.question_id+{AGAIN} AS question_id, min(b.question_id) AS duplicate_of FROM questions a JOIN questions b ON a.focus_id=b.focus_id
  AND (trim(coalesce(a.target,''))='' OR lower(trim(a.target))=lower(trim(b.target))) AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])>=0.78 WHERE a.question_id%10=0 AND a.status<>'parked' GROUP BY 1"""))
def semantic_dedup(ev: Evidence) -> DataFrame:
    """Questions that are proposed (some of those there are, asked again) and close to one of the same focus and target (any target where none is given)."""
    target = F.coalesce(F.lower(F.trim("target")), F.lit(""))
    q = ev.questions.select("question_id", F.col("focus_id").alias("within"), target.alias("target"), "embedding", "status")
    new = q.filter("question_id % 10 = 0 and status <> 'parked'").withColumn("query_id", F.col("question_id") + AGAIN).withColumn("target", F.nullif("target", F.lit("")))
    near = R.first_close(q.withColumnRenamed("question_id", "doc_id"), new, 0.78)
    return near.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("duplicate_of"))


GAPS = 5


@query("lesson_round_robin", f"""WITH g AS (SELECT vec_id AS gap, embedding::DOUBLE[] AS q FROM embeddings WHERE label=0 ORDER BY vec_id LIMIT {GAPS}), gi AS (SELECT *, row_number() OVER (ORDER BY gap) AS gi FROM g),
  d AS (SELECT vec_id, gi, row_number() OVER (PARTITION BY gi ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q),9) DESC, vec_id) AS depth FROM embeddings, gi),
  f AS (SELECT vec_id AS lesson_id, min((depth, gi)) AS k FROM d GROUP BY 1) SELECT lesson_id, row_number() OVER (ORDER BY k) AS position FROM f QUALIFY position<=8""")
def lesson_round_robin(ev: Evidence) -> DataFrame:
    """One lesson of each gap's ranking in turn, each lesson once; the first eight."""
    g = ev.read("embeddings").filter("label = 0").orderBy("vec_id").limit(GAPS)
    g = g.select(F.row_number().over(Window.orderBy("vec_id")).alias("query_id"), "embedding")  # a handful of rows
    d = R.nearest(ev.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), g, 8)
    first = d.groupBy(F.col("doc_id").alias("lesson_id")).agg(F.min(F.struct("rank", "query_id")).alias("k")).orderBy("k").limit(8)
    return first.select("lesson_id", F.row_number().over(Window.orderBy("k")).cast("long").alias("position"))
