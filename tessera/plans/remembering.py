"""Queries on memories, proposals and discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import count_if, text_key
from tessera.operators import memory as M
from tessera.plans.registry import query
from tessera.plans.texts import KEY
from tessera.sources.evidence import Evidence, with_

PROPOSED_KEY = KEY.format("p.text")


@query("memory_views", with_("memories active_focus", """SELECT 'user' AS view, memory_id FROM memories WHERE confirmed AND active AND source IN ('chat','answer','manual') UNION ALL SELECT 'research', memory_id FROM memories WHERE confirmed AND active AND source='research'
  UNION ALL SELECT 'recon', memory_id FROM memories WHERE confirmed AND active AND source='recon' AND focus_id=(SELECT focus_id FROM active_focus) UNION ALL SELECT 'declined', memory_id FROM memories WHERE NOT confirmed AND NOT active"""))
def memory_views(ev: Evidence) -> DataFrame:
    return M.views(ev.memories, ev.active_focus)


@query("memory_views_no_focus", with_("memories active_focus", "SELECT count(*) AS n FROM memories WHERE source='recon' AND focus_id=(SELECT focus_id FROM active_focus)", active="none"))
def memory_views_no_focus(ev: Evidence) -> DataFrame:
    """Without an active focus nothing from the web is shown."""
    from dataclasses import replace

    off = replace(ev, active="none")
    return M.views(off.memories, off.active_focus).filter("view = 'recon'").agg(F.count(F.lit(1)).alias("n"))


@query("declined_suppression", with_("memories proposals", f"SELECT proposal_id FROM proposals p WHERE {PROPOSED_KEY} NOT IN (SELECT {KEY.format('text')} FROM memories WHERE NOT confirmed AND NOT active)"))
def declined_suppression(ev: Evidence) -> DataFrame:
    return M.not_declined(ev.proposals, ev.memories).select("proposal_id")


@query("valid_kinds", with_("proposals", "SELECT kind, count(*) AS n FROM proposals WHERE kind IN ('pattern','dead_end','search_lesson','source_lesson') GROUP BY 1"))
def valid_kinds(ev: Evidence) -> DataFrame:
    """A proposal of an unknown kind, or of none, is dropped and not given another."""
    return ev.proposals.filter(F.col("kind").isin(*M.LESSON_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_lessons", with_("memories", "SELECT memory_id FROM memories m WHERE source='research' AND active AND text_key IS NOT NULL AND memory_id > (SELECT min(memory_id) FROM memories o WHERE o.text_key=m.text_key AND o.source='research' AND o.active)"))
def repeated_lessons(ev: Evidence) -> DataFrame:
    return M.repeated_lessons(ev.memories)


@query("lesson_merge", with_("memories proposals", f"""SELECT memory_id, array_to_string(list_sort(list(DISTINCT claim_id)), ',') AS claims FROM (SELECT m.memory_id, unnest(list_concat(from_json(m.claim_ids, '["BIGINT"]'), from_json(p.claim_ids, '["BIGINT"]'))) AS claim_id
  FROM proposals p JOIN (SELECT text_key, min(memory_id) AS memory_id, arg_min(claim_ids, memory_id) AS claim_ids FROM memories WHERE source='research' AND active AND text_key IS NOT NULL GROUP BY 1) m ON m.text_key={PROPOSED_KEY}) GROUP BY 1"""))
def lesson_merge(ev: Evidence) -> DataFrame:
    """A lesson that is proposed again isn't written again: what it rests on grows."""
    return M.merged(ev.proposals, ev.memories).select("memory_id", F.array_join(F.transform("claim_ids", lambda x: x.cast("string")), ",").alias("claims"))


@query("reflect_tick", with_("memories proposals", f"""SELECT focus_id, count(*) AS proposed, count(*) FILTER (a.text_key IS NULL) AS written, count(DISTINCT r.text_key) AS reinserted FROM proposals p
  LEFT JOIN (SELECT DISTINCT text_key FROM memories WHERE source='research' AND active AND text_key IS NOT NULL) a ON a.text_key={PROPOSED_KEY} LEFT JOIN (SELECT DISTINCT text_key FROM memories WHERE retired) r ON r.text_key={PROPOSED_KEY} GROUP BY 1"""))
def reflect_tick(ev: Evidence) -> DataFrame:
    """Of each focus' proposals: those without a lesson of that text, and texts that were retired and come back."""
    p = ev.proposals.select("focus_id", text_key(F.col("text")).alias("text_key"))
    active = M.lessons(ev.memories).select("text_key", F.lit(True).alias("there")).distinct()
    gone = ev.memories.filter("retired and text_key is not null").select("text_key", F.col("text_key").alias("back")).distinct()
    met = p.join(active, "text_key", "left").join(gone, "text_key", "left")
    return met.groupBy("focus_id").agg(F.count(F.lit(1)).alias("proposed"), count_if(F.col("there").isNull()).alias("written"), F.countDistinct("back").alias("reinserted"))


VERBS = "CASE event_type WHEN 'purchase' THEN 'remember' WHEN 'click' THEN 'allow' WHEN 'error' THEN 'decline' ELSE 'forget' END"


@query("memory_log", f"""SELECT user_id AS memory_id, coalesce(arg_max(verb IN ('remember','allow'), (ts, event_id)) FILTER (verb<>'forget'), FALSE) AS confirmed, arg_max(verb, (ts, event_id)) IN ('remember') AS active, count(*) AS entries
  FROM (SELECT *, {VERBS} AS verb FROM events) GROUP BY 1""")
def memory_log(ev: Evidence) -> DataFrame:
    """State of each memory from its log: forgetting leaves what was confirmed, declining takes it back, allowing confirms without bringing back."""
    e = ev.read("events").withColumn("verb", F.expr(VERBS)).withColumn("at", F.struct("ts", "event_id"))
    spoken = F.max(F.when(F.col("verb") != "forget", F.struct("at", F.col("verb").isin("remember", "allow").alias("yes"))))
    last = F.max(F.struct("at", "verb"))
    g = e.groupBy(F.col("user_id").alias("memory_id")).agg(spoken.alias("s"), last.alias("l"), F.count(F.lit(1)).alias("entries"))
    return g.select("memory_id", F.coalesce("s.yes", F.lit(False)).alias("confirmed"), (F.col("l.verb") == "remember").alias("active"), "entries")


@query("lesson_quota", with_("memories", """SELECT focus, memory_id, place FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY memory_id) AS place FROM (SELECT memory_id%3 AS focus, memory_id, kind,
  sum((kind IN ('pattern','dead_end'))::INT) OVER (PARTITION BY memory_id%3 ORDER BY memory_id) AS c FROM memories WHERE confirmed AND active) WHERE kind NOT IN ('pattern','dead_end') OR c<=3) WHERE place<=8"""))
def lesson_quota(ev: Evidence) -> DataFrame:
    """Eight lessons for each of three readers, three at most of the kinds that research writes about its subject itself."""
    # no reader is shown more than what a prompt holds, so the newest hundred thousand are not sorted in one task: blocks of ids are cut first
    live = ev.memories.filter("confirmed and active").select((F.col("memory_id") % 3).alias("focus"), "memory_id", "kind")
    block = live.withColumn("block", F.floor(F.col("memory_id") / 1000))
    first = M.quota(block.withColumn("part", F.struct("focus", "block")), "part", "memory_id", 8).drop("place", "part", "block")
    return M.quota(first, "focus", "memory_id", 8).select("focus", "memory_id", F.col("place").cast("long").alias("place"))


PRINTABLE, DIGITS, DOI_ID = "^[!-~]{1,100}$", "^[0-9]{1,9}$", "^10\\.[0-9]{4}[^/]*/[0-9A-Za-z./_():;+-]+$"


@query("discovery_checks", with_("discoveries memories", f"""SELECT 'lead_has_fields' AS rule, count(*) FILTER (NOT (kind<>'lead' OR (lead_kind IS NOT NULL AND lead_external_id IS NOT NULL))) AS broken FROM discoveries
  UNION ALL SELECT 'only_lead_has_fields', count(*) FILTER (NOT (kind='lead' OR (lead_kind IS NULL AND lead_external_id IS NULL))) FROM discoveries
  UNION ALL SELECT 'printable', count(*) FILTER (lead_external_id IS NOT NULL AND NOT regexp_matches(lead_external_id, '{PRINTABLE}')) FROM discoveries UNION ALL SELECT 'pubmed', count(*) FILTER (lead_kind='pubmed' AND NOT regexp_matches(lead_external_id, '{DIGITS}')) FROM discoveries
  UNION ALL SELECT 'doi', count(*) FILTER (lead_kind='doi' AND NOT regexp_matches(lead_external_id, '{DOI_ID}')) FROM discoveries
  UNION ALL SELECT 'recon_has_focus', count(*) FILTER (source='recon' AND focus_id IS NULL) FROM memories UNION ALL SELECT 'recon_is_fact', count(*) FILTER (source='recon' AND kind<>'fact') FROM memories"""))
def discovery_checks(ev: Evidence) -> DataFrame:
    """Rows that break a rule of the form: if this, then that."""
    implies = lambda a, b: count_if(~(~a | b))
    lead, has, none = F.col("kind") == "lead", F.col("lead_kind").isNotNull() & F.col("lead_external_id").isNotNull(), F.col("lead_kind").isNull() & F.col("lead_external_id").isNull()
    shape = lambda which, pattern: implies(F.coalesce(F.col("lead_kind") == which, F.lit(False)), F.col("lead_external_id").rlike(pattern))
    rules = {"lead_has_fields": implies(lead, has), "only_lead_has_fields": implies(~lead, none), "printable": implies(F.col("lead_external_id").isNotNull(), F.col("lead_external_id").rlike(PRINTABLE)), "pubmed": shape("pubmed", DIGITS), "doi": shape("doi", DOI_ID)}
    more = {"recon_has_focus": implies(F.col("source") == "recon", F.col("focus_id").isNotNull()), "recon_is_fact": implies(F.col("source") == "recon", F.col("kind") == "fact")}
    one = lambda df, all_: df.agg(*[c.alias(n) for n, c in all_.items()]).unpivot([], list(all_), "rule", "broken")
    return one(ev.discoveries, rules).unionByName(one(ev.memories, more))


@query("discovery_routes", with_("discoveries", """SELECT discovery_id, CASE WHEN status<>'pending' THEN 'already '||status WHEN days>30 THEN 'expire' WHEN kind='source' THEN 'propose_source' WHEN kind='lead' AND lead_kind='pubmed' THEN 'queue_article'
  WHEN kind='lead' AND lead_kind='doi' THEN 'resolve_doi' WHEN kind='lead' THEN 'refuse' ELSE 'remember' END AS route, CASE WHEN status='pending' AND days<=30 AND kind='observation' THEN focus_id END AS memory_focus FROM discoveries"""))
def discovery_routes(ev: Evidence) -> DataFrame:
    """What approving each discovery leads to; a memory belongs to the discovery's focus, whichever is active."""
    d, lead = ev.discoveries, F.col("kind") == "lead"
    pending = (F.col("status") == "pending") & (F.col("days") <= 30)
    route = (
        F.when(F.col("status") != "pending", F.concat(F.lit("already "), "status")).when(F.col("days") > 30, "expire").when(F.col("kind") == "source", "propose_source")
        .when(lead & (F.col("lead_kind") == "pubmed"), "queue_article").when(lead & (F.col("lead_kind") == "doi"), "resolve_doi").when(lead, "refuse").otherwise("remember")
    )
    return d.select("discovery_id", route.alias("route"), F.when(pending & (F.col("kind") == "observation"), F.col("focus_id")).alias("memory_focus"))


@query("doi_resolution", with_("sources", """SELECT asked.doi, CASE count(s.source_id) WHEN 1 THEN 'resolved' WHEN 0 THEN 'unknown' ELSE 'deferred' END AS outcome, CASE WHEN count(s.source_id)=1 THEN min(s.source_id) END AS source_id FROM (SELECT '10.1/a'||(item_id*3) AS doi FROM benchmark) asked
  LEFT JOIN sources s ON trim(lower(s.doi))=asked.doi GROUP BY 1"""))
def doi_resolution(ev: Evidence) -> DataFrame:
    """An id counts only if exactly one record has it."""
    asked = ev.read("benchmark").select(F.concat(F.lit("10.1/a"), (F.col("item_id") * 3).cast("string")).alias("doi")).distinct()
    held = ev.sources.select(F.trim(F.lower("doi")).alias("doi"), "source_id").groupBy("doi").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(held, "doi", "left").select("doi", F.when(n == 1, "resolved").when(n == 0, "unknown").otherwise("deferred").alias("outcome"), F.when(n == 1, F.col("first")).alias("source_id"))


@query("recon_queries", with_("questions active_focus", "SELECT question_id FROM (SELECT question_id, status, priority FROM questions JOIN active_focus USING (focus_id) WHERE question_id%3<>0 AND status IN ('escalated','open') AND kind NOT IN ('context','preference')) ORDER BY CASE status WHEN 'escalated' THEN 0 ELSE 1 END, priority DESC, question_id LIMIT 5"))
def recon_queries(ev: Evidence) -> DataFrame:
    return _recon_queries(ev, "question_id % 3 <> 0").select("question_id")


@query("recon_queries_fallback", with_("focuses", "SELECT 0 AS question_id, slug||' new findings' AS text FROM focuses WHERE focus_id=1"))
def recon_queries_fallback(ev: Evidence) -> DataFrame:
    """Without a question that may be asked outside, the focus itself is."""
    return _recon_queries(ev, "false")


def _recon_queries(ev: Evidence, auto: str, limit: int = 5) -> DataFrame:
    """Questions for a web search: asked by the engine itself, escalated ones first; if there is none, one from the focus."""
    may = ev.questions.join(ev.active_focus, "focus_id").filter(auto).filter("status in ('escalated', 'open') and kind not in ('context', 'preference')")
    first = may.orderBy(F.when(F.col("status") == "escalated", 0).otherwise(1), F.desc("priority"), "question_id").limit(limit).select("question_id", F.concat(F.lit("question "), F.col("question_id").cast("string")).alias("text"))
    focus = ev.focuses.join(ev.active_focus.select("focus_id"), "focus_id").select(F.lit(0).cast("long").alias("question_id"), F.concat("slug", F.lit(" new findings")).alias("text"))
    any_ = first.agg(F.count(F.lit(1)).alias("n"))
    return first.unionByName(focus.crossJoin(F.broadcast(any_)).filter("n = 0").drop("n"))  # one row each


@query("text_key_backfill", with_("memories", f"""SELECT memory_id, key, first_id IS NOT NULL AS blocked FROM (SELECT memory_id, {KEY.format('text')} AS key FROM memories WHERE text_key IS NULL AND source='research' AND active) n
  LEFT JOIN (SELECT text_key, min(memory_id) AS first_id FROM memories WHERE source='research' AND active AND text_key IS NOT NULL GROUP BY 1) h ON h.text_key=n.key"""))
def text_key_backfill(ev: Evidence) -> DataFrame:
    """Keys for rows without one; a row whose key a live lesson has is reported and left."""
    new = ev.memories.filter("text_key is null and source = 'research' and active").select("memory_id", text_key(F.col("text")).alias("key"))
    held = M.lessons(ev.memories).groupBy(F.col("text_key").alias("key")).agg(F.min("memory_id").alias("first_id"))
    return new.join(held, "key", "left").select("memory_id", "key", F.col("first_id").isNotNull().alias("blocked"))
