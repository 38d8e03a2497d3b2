"""Queries on weights, boards, coverage and the corpus."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.functions.semantics import count_if
from tessera.operators import reground as G
from tessera.operators import weight as W
from tessera.operators.text import pmid
from tessera.plans.registry import query
from tessera.sources.evidence import Evidence, with_

BASE = "claims directness scale_levels active_focus"
CW = """cw AS (SELECT c.*, d.directness, g.weight AS gw, g.rank AS gr, x.weight AS dw, x.rank AS dr, g.weight*x.weight*c.confidence AS weight
  FROM claims c, active_focus f JOIN directness d ON d.claim_id=c.claim_id AND d.focus_id=f.focus_id AND NOT d.out_of_scope
  JOIN scale_levels g ON g.scale_id=c.scale_id AND g.axis='grade' AND g.value=c.grade
  JOIN scale_levels x ON x.scale_id=c.scale_id AND x.axis='directness' AND x.value=d.directness WHERE c.scale_id=f.focus_scale)"""
CW = CW.replace("FROM claims c, active_focus f JOIN", "FROM claims c CROSS JOIN active_focus f JOIN")


def r9(c: str, name: str | None = None):
    return F.round(c, 9).alias(name or c)


@query("claim_weight", with_(BASE, "SELECT claim_id, grade, directness, round(weight,9) AS weight FROM cw", CW))
def claim_weight(ev: Evidence) -> DataFrame:
    return W.claim_weight(ev).select("claim_id", "grade", "directness", r9("weight"))


@query("claims_top", with_(BASE, "SELECT claim_id, source_id, intervention, direction, round(weight,9) AS weight FROM cw WHERE verified ORDER BY round(weight,9) DESC, claim_id LIMIT 20", CW))
def claims_top(ev: Evidence) -> DataFrame:
    return W.claim_weight(ev).filter("verified").select("claim_id", "source_id", "intervention", "direction", r9("weight")).orderBy(F.desc("weight"), "claim_id").limit(20)


@query("weight_loss_classes", with_(BASE, """SELECT CASE WHEN c.scale_id IS DISTINCT FROM f.focus_scale THEN 'off_scale' WHEN d.directness IS NULL THEN 'unjudged' WHEN d.out_of_scope THEN 'out_of_scope' ELSE 'weighted' END AS loss_class,
  count(*) AS claims FROM claims c CROSS JOIN active_focus f LEFT JOIN directness d ON d.claim_id=c.claim_id AND d.focus_id=f.focus_id WHERE c.verified GROUP BY 1"""))
def weight_loss_classes(ev: Evidence) -> DataFrame:
    return W.loss_classes(ev)


@query("claim_weight_no_focus", with_(BASE, "SELECT count(*) AS claims FROM cw", CW, active="abc"))
def claim_weight_no_focus(ev: Evidence) -> DataFrame:
    return W.claim_weight(replace(ev, active="abc")).agg(F.count(F.lit(1)).alias("claims"))


@query("claim_weight_retired_focus", with_(BASE, "SELECT count(*) AS claims FROM cw", CW, active="3"))
def claim_weight_retired_focus(ev: Evidence) -> DataFrame:
    return W.claim_weight(replace(ev, active="3")).agg(F.count(F.lit(1)).alias("claims"))


SB = CW + """, sb AS (SELECT h.hypothesis_id, h.focus_id, h.tier, coalesce(sum(CASE WHEN polarity='supports' THEN weight*modulator END),0) AS support,
  coalesce(sum(CASE WHEN polarity='contradicts' THEN weight*modulator END),0) AS contra, count(l.claim_id) AS n_claims, count(l.claim_id)-count(w.claim_id) AS n_unweighted
  FROM hypotheses h LEFT JOIN links l USING (hypothesis_id) LEFT JOIN (SELECT claim_id, weight FROM cw WHERE verified) w ON w.claim_id=l.claim_id GROUP BY ALL)"""


@query("hypothesis_scoreboard", with_(BASE + " hypotheses links", "SELECT hypothesis_id, tier, round(support,6) AS support, round(contra,6) AS contra, n_claims, n_unweighted FROM sb", SB))
def hypothesis_scoreboard(ev: Evidence) -> DataFrame:
    return W.scoreboard(ev).select("hypothesis_id", "tier", F.round("support", 6).alias("support"), F.round("contra", 6).alias("contra"), "n_claims", "n_unweighted")


@query("scoreboard_top_active", with_(BASE + " hypotheses links", """SELECT hypothesis_id, round(support+contra,6) AS total FROM sb JOIN active_focus USING (focus_id) WHERE tier<>'rejected'
  ORDER BY total DESC, hypothesis_id LIMIT 15""", SB))
def scoreboard_top_active(ev: Evidence) -> DataFrame:
    sb = W.scoreboard(ev).join(ev.active_focus, "focus_id").filter("tier <> 'rejected'")
    return sb.select("hypothesis_id", F.round(F.col("support") + F.col("contra"), 6).alias("total")).orderBy(F.desc("total"), "hypothesis_id").limit(15)


PL = """pl AS (SELECT h.*, coalesce(steps,0) AS steps, coalesce(anchored,0) AS anchored, coalesce(anchored/steps,0) AS plausibility FROM hypotheses h LEFT JOIN
  (SELECT hypothesis_id, count(*) AS steps, count(*) FILTER (supported AND coalesce(evidence,'')<>'') AS anchored FROM chain GROUP BY 1) USING (hypothesis_id))"""


@query("plausibility", with_("hypotheses chain", "SELECT hypothesis_id, steps, anchored, round(plausibility,9) AS plausibility FROM pl", PL))
def plausibility(ev: Evidence) -> DataFrame:
    return W.chain_scores(ev).select("hypothesis_id", "steps", "anchored", r9("plausibility"))


@query("speculation_board", with_("hypotheses chain active_focus", """SELECT hypothesis_id, novelty, round(plausibility*novelty,9) AS score FROM pl JOIN active_focus USING (focus_id)
  WHERE tier='speculative' AND survives IS DISTINCT FROM FALSE ORDER BY score DESC, hypothesis_id""", PL))
def speculation_board(ev: Evidence) -> DataFrame:
    b = W.chain_scores(ev).join(ev.active_focus, "focus_id").filter("tier = 'speculative' and survives is distinct from false")
    return b.select("hypothesis_id", "novelty", F.round(F.col("plausibility") * F.col("novelty"), 9).alias("score")).orderBy(F.desc("score"), "hypothesis_id")


@query("refuted_hypotheses", with_("hypotheses", "SELECT hypothesis_id, statement FROM hypotheses WHERE tier='speculative' AND survives=FALSE ORDER BY hypothesis_id DESC LIMIT 10"))
def refuted_hypotheses(ev: Evidence) -> DataFrame:
    return ev.hypotheses.filter("tier = 'speculative' and survives = false").orderBy(F.desc("hypothesis_id")).limit(10).select("hypothesis_id", "statement")


BOARD = PL + """, board AS (SELECT pl.*, pursued_at, regrounded_at FROM pl JOIN active_focus USING (focus_id) LEFT JOIN pursuits USING (hypothesis_id) WHERE tier='speculative' AND survives)"""


def surviving(ev: Evidence) -> DataFrame:
    """Speculative hypotheses of the active focus that have survived criticism, with their chains' scores and pursuits."""
    b = W.chain_scores(ev).join(ev.active_focus, "focus_id").filter("tier = 'speculative' and survives")
    return b.join(ev.pursuits, "hypothesis_id", "left")


@query("pending_pursuit", with_("hypotheses chain active_focus pursuits", "SELECT hypothesis_id, round(plausibility*coalesce(novelty,0),9) AS promise FROM board WHERE pursued_at IS NULL ORDER BY promise DESC, hypothesis_id LIMIT 3", BOARD))
def pending_pursuit(ev: Evidence) -> DataFrame:
    """The most promising hypotheses that no search has been made for."""
    promise = F.round(F.col("plausibility") * F.coalesce("novelty", F.lit(0.0)), 9)
    return surviving(ev).filter("pursued_at is null").select("hypothesis_id", promise.alias("promise")).orderBy(F.desc("promise"), "hypothesis_id").limit(3)


@query("pending_reground", with_("hypotheses chain active_focus pursuits", "SELECT hypothesis_id, steps-anchored AS assumed, regrounded_at FROM board WHERE pursued_at IS NOT NULL AND anchored<steps ORDER BY regrounded_at NULLS FIRST, hypothesis_id LIMIT 5", BOARD))
def pending_reground(ev: Evidence) -> DataFrame:
    """Pursued hypotheses with a step that is still assumed, those never or longest ago grounded anew first."""
    b = surviving(ev).filter("pursued_at is not null and anchored < steps")
    return b.select("hypothesis_id", (F.col("steps") - F.col("anchored")).alias("assumed"), "regrounded_at").orderBy(F.asc_nulls_first("regrounded_at"), "hypothesis_id").limit(5)


#: Claims that an answer is given as evidence.
SHOWN = 12


def shown_evidence(ev: Evidence) -> DataFrame:
    """hypothesis_id and ids: the sources of the claims that support a hypothesis most."""
    l = ev.links.filter("polarity = 'supports'").join(ev.claims.select("claim_id", "source_id"), "claim_id")
    first = Window.partitionBy("hypothesis_id").orderBy(F.desc("modulator"), "claim_id")
    l = l.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SHOWN)
    return l.groupBy("hypothesis_id").agg(F.collect_set(F.col("source_id").cast("string")).alias("ids"))


REGROUND = f"""ids AS (SELECT DISTINCT hypothesis_id, source_id FROM (SELECT hypothesis_id, source_id, row_number() OVER (PARTITION BY hypothesis_id ORDER BY modulator DESC, claim_id) AS n FROM links JOIN claims USING (claim_id) WHERE polarity='supports') WHERE n<={SHOWN}),
  spec AS (SELECT p_partkey AS hypothesis_id, p_size%7<>0 AS readable FROM part WHERE p_partkey%3=0), steps AS (SELECT chain.* FROM chain JOIN spec USING (hypothesis_id)),
  said AS (SELECT l_partkey AS hypothesis_id, l_linenumber-1 AS step, o_orderkey%n_docs AS source_id, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN spec ON hypothesis_id=l_partkey, n
    WHERE l_linenumber<7 AND l_returnflag<>'N' AND readable),
  took AS (SELECT a.*, i.source_id IS NOT NULL AS ok FROM said a JOIN steps s ON s.hypothesis_id=a.hypothesis_id AND s.step=a.step AND NOT s.supported LEFT JOIN ids i ON i.hypothesis_id=a.hypothesis_id AND i.source_id=a.source_id WHERE a.hypothesis_id IN (SELECT hypothesis_id FROM ids)),
  last AS (SELECT hypothesis_id, step, max_by(source_id, l_orderkey*10+l_linenumber) AS source_id FROM took WHERE ok GROUP BY 1, 2),
  cnt AS (SELECT hypothesis_id, count(*) FILTER (ok) AS anchored, count(*) FILTER (NOT ok) AS refused FROM took GROUP BY 1),
  new AS (SELECT s.hypothesis_id, s.step, s.supported OR l.source_id IS NOT NULL AS supported, CASE WHEN l.source_id IS NOT NULL THEN 'PMID:'||l.source_id ELSE s.evidence END AS evidence, s.supported AS was FROM steps s LEFT JOIN last l USING (hypothesis_id, step))"""


@query("regrounded_chains", with_("chain links claims", """SELECT hypothesis_id, to_json(list({'claim': 'step '||step, 'supported': supported, 'evidence': evidence} ORDER BY step))::VARCHAR AS chain_json, coalesce(any_value(anchored),0) AS anchored, coalesce(any_value(refused),0) AS refused,
  bool_or(NOT was) AND (hypothesis_id NOT IN (SELECT hypothesis_id FROM ids) OR (any_value(readable) AND hypothesis_id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber<7))) AS marked, count(*) FILTER (supported AND coalesce(evidence,'')<>'') AS supported_links
  FROM new LEFT JOIN cnt USING (hypothesis_id) JOIN spec USING (hypothesis_id) GROUP BY 1""", REGROUND))
def regrounded_chains(ev: Evidence) -> DataFrame:
    """Chains of speculative hypotheses after an answer about the evidence that was shown; what can't be read or names other evidence changes nothing."""
    chains = ev.chain_texts.join(ev.hypotheses.filter("tier = 'speculative'").select("hypothesis_id"), "hypothesis_id", "left_semi")
    out = G.reground(chains, ev.answers, shown_evidence(ev))
    return out.withColumn("supported_links", G.anchored_steps(G.steps(F.col("chain_json"))))


REF = "nullif(regexp_extract(evidence, '(?i)(?:^|[^0-9A-Za-z_.])(?:pmid[:\\s]*)?([0-9]{1,8})(?:[^0-9A-Za-z_.]|$)', 1), '')"


@query("citation_gate", with_("chain sources", f"""SELECT hypothesis_id, string_agg(CASE WHEN kept THEN '1' ELSE '0' END, '' ORDER BY step) AS kept, string_agg(CASE WHEN kept THEN 'PMID:'||ref ELSE coalesce(evidence,'') END, '|' ORDER BY step) AS evidence,
  count(*) FILTER (supported AND NOT kept) AS refused FROM (SELECT c.*, supported AND s.external_id IS NOT NULL AS kept FROM (SELECT *, {REF} AS ref FROM chain) c LEFT JOIN sources s ON s.external_id=c.ref) GROUP BY 1"""))
def citation_gate(ev: Evidence) -> DataFrame:
    """Supported steps of a chain keep their support only if they name a source of the corpus; its name then has one form."""
    c = ev.chain.withColumn("ref", pmid(F.col("evidence"))).join(ev.sources.select("external_id"), F.col("ref") == F.col("external_id"), "left")
    c = c.withColumn("kept", F.col("supported") & F.col("external_id").isNotNull())
    said = F.when(F.col("kept"), F.concat(F.lit("PMID:"), "ref")).otherwise(F.coalesce("evidence", F.lit("")))
    # a chain has a few steps
    g = c.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(F.struct("step", "kept", said.alias("said")))).alias("s"), count_if(F.col("supported") & ~F.col("kept")).alias("refused"))
    flags = F.transform("s", lambda x: x["kept"].cast("int").cast("string"))
    return g.select("hypothesis_id", F.array_join(flags, "").alias("kept"), F.array_join(F.transform("s", lambda x: x["said"]), "|").alias("evidence"), "refused")


COV = CW + """, cov AS (SELECT lower(trim(intervention)) AS key, count(*) AS n, sum(weight) AS total, count(*) FILTER (direction='positive') AS pos, count(*) FILTER (direction='negative') AS neg,
  count(*) FILTER (direction IN ('null','mixed')) AS neutral, arg_min(grade, gr) AS best_grade, arg_min(directness, dr) AS best_directness, 1-max(dw) AS gap FROM cw WHERE verified AND trim(intervention)<>'' GROUP BY 1),
  cov2 AS (SELECT *, CASE WHEN pos+neg>=2 THEN 1-abs(pos-neg)/(pos+neg) ELSE 0 END AS conflict FROM cov)"""


@query("coverage_by_intervention", with_(BASE, "SELECT key, n, round(total,6) AS total, pos, neg, neutral, best_grade, best_directness, round(conflict,9) AS conflict, round(gap,9) AS gap FROM cov2", COV))
def coverage_by_intervention(ev: Evidence) -> DataFrame:
    return W.coverage(ev).select("key", "n", F.round("total", 6).alias("total"), "pos", "neg", "neutral", "best_grade", "best_directness", r9("conflict"), r9("gap"))


TOP = COV + f", top AS (SELECT *, row_number() OVER (ORDER BY round(total,6) DESC, key) AS rn, count(*) OVER () AS all_n FROM cov2 QUALIFY rn<={L.COVERAGE_CAP})"


def _capped(ev: Evidence) -> DataFrame:
    c = W.coverage(ev)
    kept = c.orderBy(F.desc(F.round("total", 6)), "key").limit(L.COVERAGE_CAP)
    return kept.crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("all_n"))))


@query("coverage_capped", with_(BASE, f"SELECT key, round(total,6) AS total, greatest(0, all_n-{L.COVERAGE_CAP}) AS omitted FROM top", TOP))
def coverage_capped(ev: Evidence) -> DataFrame:
    return _capped(ev).select("key", F.round("total", 6).alias("total"), F.greatest(F.lit(0), F.col("all_n") - L.COVERAGE_CAP).alias("omitted"))


@query("conflicts_top", with_(BASE, f"SELECT key, round(conflict*total,6) AS heat FROM top WHERE conflict>0 ORDER BY heat DESC, key LIMIT {L.CONFLICT_CAP}", TOP))
def conflicts_top(ev: Evidence) -> DataFrame:
    """From the capped coverage, as the report shows them."""
    c = _capped(ev).filter("conflict > 0").select("key", F.round(F.col("conflict") * F.col("total"), 6).alias("heat"))
    return c.orderBy(F.desc("heat"), "key").limit(L.CONFLICT_CAP)


CLASSES = (("sevens", "agent 7"), ("tens", "agent 1"), ("nothing", "placebo"), ("ninety", "agent 9x"))


@query("untouched_classes", with_(BASE, "SELECT label FROM k WHERE NOT EXISTS (SELECT 1 FROM cov2 WHERE contains(key, keyword))", COV + ", k(label, keyword) AS (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in CLASSES) + ")"))
def untouched_classes(ev: Evidence) -> DataFrame:
    k = F.broadcast(ev.spark.createDataFrame(list(CLASSES), "label string, keyword string"))
    touched = W.coverage(ev).select("key").join(k, F.contains("key", "keyword")).select("label").distinct()
    return k.join(F.broadcast(touched), "label", "left_anti").select("label")


ASKED = ("agent 7", "agent", "ent 33", "absent")


@query("state_lookup", with_(BASE, """SELECT name, coalesce(e.key, s.key) AS found, coalesce(e.n, s.n, 0) AS n FROM q LEFT JOIN cov2 e ON e.key=q.name
  LEFT JOIN (SELECT name, arg_min(key, o) AS key, arg_min(n, o) AS n FROM (SELECT q.name, key, n, row_number() OVER (ORDER BY round(total,6) DESC, key) AS o FROM cov2 JOIN q ON contains(key, q.name)) GROUP BY 1) s USING (name)""", COV + ", q(name) AS (VALUES " + ", ".join(f"('{a}')" for a in ASKED) + ")"))
def state_lookup(ev: Evidence) -> DataFrame:
    """The intervention of that name, else the weightiest whose name contains it, else nothing covered."""
    q = F.broadcast(ev.spark.createDataFrame([(a,) for a in ASKED], "name string"))
    c = W.coverage(ev).select("key", "n", F.round("total", 6).alias("total"))
    part = c.join(q, F.contains("key", "name")).groupBy("name").agg(F.min(F.struct((-F.col("total")).alias("t"), "key", "n")).alias("s"))
    out = q.join(c.select(F.col("key").alias("name"), F.col("n").alias("en")), "name", "left").join(part, "name", "left")
    found = F.when(F.col("en").isNotNull(), F.col("name")).otherwise(F.col("s.key"))
    return out.select("name", found.alias("found"), F.coalesce("en", "s.n", F.lit(0)).alias("n"))


@query("question_priority", with_(BASE + " questions", f"""SELECT question_id, round(greatest(0.01, least(1, ({L.NOVELTY_WEIGHT}/(1+coalesce(total,0)) + {L.CONFLICT_WEIGHT}*coalesce(conflict,0) + {L.GAP_WEIGHT}*coalesce(gap,1))
  / CASE kind WHEN 'synthesis' THEN 1.5 WHEN 'methodological' THEN 3 ELSE 1 END)), 6) AS score FROM questions q LEFT JOIN cov2 ON key='agent '||(question_id%40)""", COV))
def question_priority(ev: Evidence) -> DataFrame:
    """Novelty, conflict and gap of what a question is about, against the cost of its kind."""
    c = W.coverage(ev).select("key", "total", "conflict", "gap")
    q = ev.questions.withColumn("about", F.concat(F.lit("agent "), (F.col("question_id") % 40).cast("string"))).join(c, F.col("about") == F.col("key"), "left")
    value = L.NOVELTY_WEIGHT / (1 + F.coalesce("total", F.lit(0.0))) + L.CONFLICT_WEIGHT * F.coalesce("conflict", F.lit(0.0)) + L.GAP_WEIGHT * F.coalesce("gap", F.lit(1.0))
    cost = F.when(F.col("kind") == "synthesis", 1.5).when(F.col("kind") == "methodological", 3.0).otherwise(1.0)
    return q.select("question_id", F.round(F.greatest(F.lit(0.01), F.least(F.lit(1.0), value / cost)), 6).alias("score"))


@query("gap_queries", with_(BASE, """SELECT text FROM (SELECT 'conflict about '||key AS text, 0 AS part, rank() OVER (ORDER BY round(conflict*total,6) DESC, key) AS o FROM top WHERE conflict>0 QUALIFY o<=10
  UNION ALL SELECT 'nothing on '||label, 1, rank() OVER (ORDER BY label) FROM k WHERE NOT EXISTS (SELECT 1 FROM cov2 WHERE contains(key, keyword))) ORDER BY part, o LIMIT 8""", TOP + ", k(label, keyword) AS (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in CLASSES) + ")"))
def gap_queries(ev: Evidence) -> DataFrame:
    c = conflicts_top(ev).select(F.concat(F.lit("conflict about "), "key").alias("text"), F.lit(0).alias("part"), (-F.col("heat")).alias("o"), "key")
    u = untouched_classes(ev).select(F.concat(F.lit("nothing on "), "label").alias("text"), F.lit(1).alias("part"), F.lit(0.0).alias("o"), F.col("label").alias("key"))
    return c.unionByName(u).orderBy("part", "o", "key").limit(8).select("text")


COUNTS = (
    ("sources", "sources", "true"), ("chunks", "chunks", "true"), ("claims", "claims", "true"), ("hypotheses", "hypotheses", "true"), ("links", "links", "true"), ("questions", "questions", "true"), ("tasks", "tasks", "true"), ("runs", "runs", "true"),
    ("verified", "claims", "verified"), ("approved", "sources", "approved"), ("speculative", "hypotheses", "tier='speculative'"), ("supported", "hypotheses", "tier='supported'"),
    ("open_questions", "questions", "status='open'"), ("escalated_questions", "questions", "status='escalated'"), ("pending_tasks", "tasks", "status='pending'"),
)


@query("gap_queries_default", "SELECT 'what is new in the field' AS text")
def gap_queries_default(ev: Evidence) -> DataFrame:
    """Without coverage, as without an active focus, there is one general query."""
    return or_default(gap_queries(replace(ev, active="none")).filter("text like 'conflict%'"), "what is new in the field")


def or_default(queries: DataFrame, text: str) -> DataFrame:
    """The queries (a handful), or the one text if there are none."""
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    return queries.unionByName(n.filter("n = 0").select(F.lit(text).alias("text")))


@query("corpus_counts", with_("sources chunks claims hypotheses links questions tasks runs", " UNION ALL ".join(f"SELECT '{w}' AS what, count(*) AS n FROM {t} WHERE {c}" for w, t, c in COUNTS)))
def corpus_counts(ev: Evidence) -> DataFrame:
    """Rows of the tables and of parts of them; each table is read once."""
    out = None
    for t in dict.fromkeys(t for _, t, _ in COUNTS):
        own = [(w, c) for w, at, c in COUNTS if at == t]
        row = getattr(ev, t).agg(*[F.coalesce(count_if(F.expr(c)), F.lit(0)).alias(w) for w, c in own])
        part = row.unpivot([], [w for w, _ in own], "what", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("barren_sources", with_("sources claims", "SELECT source_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.source_id=s.source_id AND c.verified)"))
def barren_sources(ev: Evidence) -> DataFrame:
    return ev.sources.join(ev.claims.filter("verified").select("source_id"), "source_id", "left_anti").select("source_id")


@query("intervention_representatives", with_(BASE, """SELECT coalesce(nullif(lower(trim(intervention)),''), 'id:'||claim_id) AS key, count(*) AS n, count(*) FILTER (direction='positive') AS n_pos,
  count(*) FILTER (direction IN ('negative','null')) AS n_contra, arg_min(claim_id, (-round(weight,9), statement, claim_id)) AS claim_id FROM cw WHERE verified GROUP BY 1""", CW))
def intervention_representatives(ev: Evidence) -> DataFrame:
    key = F.coalesce(F.nullif(F.lower(F.trim("intervention")), F.lit("")), F.concat(F.lit("id:"), F.col("claim_id").cast("string")))
    d = F.col("direction")
    return W.claim_weight(ev).filter("verified").groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), count_if(d == "positive").alias("n_pos"), count_if(d.isin("negative", "null")).alias("n_contra"),
        F.min_by("claim_id", F.struct(-F.round("weight", 9), F.col("statement"), F.col("claim_id"))).alias("claim_id"),
    )


@query("weakest_directness", with_(BASE, "SELECT source_id, arg_max(directness, dr) AS weakest, count(*) AS n FROM cw GROUP BY 1", CW))
def weakest_directness(ev: Evidence) -> DataFrame:
    return W.claim_weight(ev).groupBy("source_id").agg(F.max_by("directness", "directness_rank").alias("weakest"), F.count(F.lit(1)).alias("n"))


ART = "art AS (SELECT *, coalesce(nullif(trim(lower(doi)),''), kind||':'||external_id) AS article_key FROM sources)"


@query("article_identity", with_("sources", "SELECT article_key, count(*) AS records, min(source_id) AS first_source FROM art GROUP BY 1", ART))
def article_identity(ev: Evidence) -> DataFrame:
    return ev.sources.groupBy(article_key().alias("article_key")).agg(F.count(F.lit(1)).alias("records"), F.min("source_id").alias("first_source"))


def article_key():
    return F.coalesce(F.nullif(F.trim(F.lower("doi")), F.lit("")), F.concat_ws(":", "kind", "external_id"))


@query("evidence_fingerprint", with_(BASE + " sources hypotheses links", """SELECT hypothesis_id, md5(count(*)||':'||bit_xor(h)||':'||sum(h)) AS fingerprint, count(DISTINCT article_key) AS articles
  FROM (SELECT hypothesis_id, article_key, ('0x'||left(md5(claim_id::VARCHAR),12))::BIGINT AS h FROM links JOIN cw USING (claim_id) JOIN art USING (source_id)) GROUP BY 1""", CW + ", " + ART))
def evidence_fingerprint(ev: Evidence) -> DataFrame:
    """A fingerprint of the set of a hypothesis' claims that no order and no list of them enters, and its articles.

    It is the number of claims with the xor and the sum of 48 bits of each one's hash: two sets of one size agree by chance in
    about one of 2 ** 90 cases (the low bits of xor and sum say the same)."""
    cw = W.claim_weight(ev).select("claim_id", "source_id").join(ev.sources.select("source_id", article_key().alias("article_key")), "source_id")
    h = F.conv(F.left(F.md5(F.col("claim_id").cast("string")), F.lit(12)), 16, 10).cast("long")
    g = ev.links.join(cw, "claim_id").groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h).alias("s"), F.countDistinct("article_key").alias("articles"))
    return g.select("hypothesis_id", F.md5(F.concat_ws(":", "n", "x", "s")).alias("fingerprint"), "articles")


@query("literature_mark", with_(BASE, "SELECT coalesce(max(claim_id),0) AS mark, count(*) FILTER (claim_id>1000) AS newer FROM cw", CW))
def literature_mark(ev: Evidence) -> DataFrame:
    return W.claim_weight(ev).agg(F.coalesce(F.max("claim_id"), F.lit(0)).alias("mark"), count_if(F.col("claim_id") > 1000).alias("newer"))


@query("registry_counts", with_("sources", "SELECT registry, count(*) AS n, count(*) FILTER (approved) AS approved, count(design) AS designed FROM sources GROUP BY 1 ORDER BY 1"))
def registry_counts(ev: Evidence) -> DataFrame:
    return ev.sources.groupBy("registry").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("approved")).alias("approved"), F.count("design").alias("designed"))


@query("strongest_design", with_("sources scale_levels", "SELECT lang, arg_min(design, rank) AS strongest, count(*) AS n FROM sources JOIN scale_levels ON axis='grade' AND scale_id=1 AND value=design GROUP BY 1"))
def strongest_design(ev: Evidence) -> DataFrame:
    lv = ev.levels.filter("axis = 'grade' and scale_id = 1").select(F.col("value").alias("design"), "rank")
    return ev.sources.join(lv, "design").groupBy("lang").agg(F.min_by("design", "rank").alias("strongest"), F.count(F.lit(1)).alias("n"))


#: What the cases of a gold set presuppose: sources of a design, with a word in the title, with a word in the text of a chunk, and how many.
CASES = [("a", "rct", "the", None, 1, 100000), ("b", None, "zzzz", None, 1, 10), ("c", None, " de ", None, 0, 100000), ("d", "cohort", "en", None, 100000, 200000), ("e", None, None, "nicht", 1, 100000), ("f", "rct", None, " the ", 1, 3), ("g", None, "le", " que ", 0, 100000), ("h", None, None, "nowhere at all", 0, 0)]
CASE_ROWS = ",".join("(" + ",".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in c) + ")" for c in CASES)


@query("goldset_preconditions", with_("sources chunks", """SELECT g.case_id, count(s.source_id) AS found, count(s.source_id) BETWEEN min_n AND max_n AS holds FROM g LEFT JOIN sources s ON (g.design IS NULL OR s.design=g.design) AND (g.word IS NULL OR contains(lower(s.title), g.word))
  AND (g.inside IS NULL OR EXISTS (SELECT 1 FROM chunks c WHERE c.source_id=s.source_id AND contains(lower(c.text), g.inside))) GROUP BY g.case_id, min_n, max_n""", f"g(case_id, design, word, inside, min_n, max_n) AS (VALUES {CASE_ROWS})"))
def goldset_preconditions(ev: Evidence) -> DataFrame:
    """How many sources each case finds, and whether that is as many as it presupposes; texts are looked for in the chunks, and a source counts once."""
    g = ev.spark.createDataFrame(CASES, "case_id string, want string, word string, inside string, min_n long, max_n long")
    few = F.broadcast(g)  # the cases of a gold set, a file that people write
    holds = ev.chunks.select("source_id", F.lower("text").alias("low")).join(few.filter("inside is not null").select("case_id", "inside"), F.contains("low", F.col("inside"))).select("source_id", "case_id").distinct()
    s = ev.sources.select("source_id", "design", F.lower("title").alias("title"))
    met = few.join(s, (F.col("want").isNull() | (F.col("want") == F.col("design"))) & (F.col("word").isNull() | F.contains("title", F.col("word"))))
    met = met.filter("inside is null").select("case_id", "source_id").unionByName(met.filter("inside is not null").select("case_id", "source_id").join(holds, ["case_id", "source_id"], "left_semi"))
    out = g.join(met.groupBy("case_id").agg(F.count("source_id").alias("found")), "case_id", "left").fillna(0, ["found"])
    return out.select("case_id", "found", F.col("found").between(F.col("min_n"), F.col("max_n")).alias("holds"))
