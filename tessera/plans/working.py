"""Queries on usage, reports, the work queue, sinks and change marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.functions.semantics import count_if, ratio
from tessera.operators import work as K
from tessera.plans.registry import query
from tessera.sources.evidence import Evidence, with_
from tessera.streaming import deltas

NOW, SINCE = "2024-01-30 00:00:00", "2024-01-20 00:00:00"


@query("usage_summary", with_("calls", """SELECT label, count(*) AS n, count(*) FILTER (NOT ok) AS failures, CAST(sum(repairs) AS BIGINT) AS repairs, round(avg(prompt_tokens),6) AS avg_prompt, max(prompt_tokens) AS max_prompt,
  round(avg(completion_tokens),6) AS avg_completion, round(avg(elapsed),6) AS avg_elapsed, round(max(elapsed),6) AS max_elapsed, round(sum(elapsed),4) AS total_elapsed, CAST(sum(coalesce(prompt_tokens,0)+coalesce(completion_tokens,0)) AS BIGINT) AS tokens FROM calls GROUP BY 1"""))
def usage_summary(ev: Evidence) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ev.calls.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), count_if(~F.col("ok")).alias("failures"), F.sum("repairs").alias("repairs"), F.round(F.avg("prompt_tokens"), 6).alias("avg_prompt"), F.max("prompt_tokens").alias("max_prompt"),
        F.round(F.avg("completion_tokens"), 6).alias("avg_completion"), F.round(F.avg("elapsed"), 6).alias("avg_elapsed"), F.round(F.max("elapsed"), 6).alias("max_elapsed"), F.round(F.sum("elapsed"), 4).alias("total_elapsed"), F.sum(zero("prompt_tokens") + zero("completion_tokens")).alias("tokens"),
    )


@query("usage_percentiles", with_("calls", "SELECT label, " + ", ".join(f"round(list_sort(list(elapsed) FILTER (elapsed IS NOT NULL))[least(count(elapsed), floor(count(elapsed)*{q})::BIGINT+1)],6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99)) + " FROM calls GROUP BY 1"))
def usage_percentiles(ev: Evidence) -> DataFrame:
    """All labels in one pass, by rank offset."""
    p = K.percentiles_by_offset(ev.calls, "label", "elapsed", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return p.select("label", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("direction_histogram", with_("claims", "SELECT direction, count(*) AS n FROM claims WHERE verified AND extracted_at>='1995-01-01' AND extracted_at<'1997-01-01' GROUP BY 1"))
def direction_histogram(ev: Evidence) -> DataFrame:
    return ev.claims.filter("verified and extracted_at >= '1995-01-01' and extracted_at < '1997-01-01'").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("delta_report", with_("calls tasks", f"""SELECT 'calls' AS what, count(*) AS n FROM calls WHERE created_at>'{SINCE}' AND created_at<='{NOW}' UNION ALL SELECT 'finished', count(*) FROM tasks WHERE finished_at>'{SINCE}' AND finished_at<='{NOW}'
  UNION ALL SELECT 'failures', count(*) FROM calls WHERE NOT ok AND created_at>'{SINCE}' AND created_at<='{NOW}'"""))
def delta_report(ev: Evidence) -> DataFrame:
    """What happened after the last report, up to now; reading doesn't move the window."""
    def inside(c: str):
        return (F.col(c) > F.lit(SINCE).cast("timestamp")) & (F.col(c) <= F.lit(NOW).cast("timestamp"))

    def one(df: DataFrame, what: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    calls = ev.calls.filter(inside("created_at"))
    return one(calls, "calls").unionByName(one(ev.tasks.filter(inside("finished_at")), "finished")).unionByName(one(calls.filter("not ok"), "failures"))


@query("budget_month", with_("calls", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS used, CAST(sum(count(*)) OVER (PARTITION BY strftime(created_at, '%Y-%m')) AS BIGINT) AS month_used FROM calls GROUP BY 1, strftime(created_at, '%Y-%m')"))
def budget_month(ev: Evidence) -> DataFrame:
    d = ev.calls.groupBy(F.to_date("created_at").alias("d")).agg(F.count(F.lit(1)).alias("used"))
    m = F.sum("used").over(Window.partitionBy(F.trunc("d", "month")))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "used", m.alias("month_used"))


@query("task_snapshot", with_("tasks", "SELECT kind, status, count(*) AS n, round(max(priority),6) AS top FROM tasks GROUP BY 1,2"))
def task_snapshot(ev: Evidence) -> DataFrame:
    return ev.tasks.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("priority"), 6).alias("top"))


@query("next_task", with_("tasks", f"SELECT origin, arg_min(task_id, (-priority, task_id)) AS task_id FROM tasks WHERE status='pending' AND scheduled_at<='{NOW}' GROUP BY 1"))
def next_task(ev: Evidence) -> DataFrame:
    due = ev.tasks.filter(f"status = 'pending' and scheduled_at <= timestamp'{NOW}'")
    return due.groupBy("origin").agg(F.min_by("task_id", F.struct(-F.col("priority"), F.col("task_id"))).alias("task_id"))


@query("mode_gate", with_("tasks", "SELECT kind, count(*) AS claimable FROM tasks WHERE status='pending' AND origin='on_demand' GROUP BY 1"))
def mode_gate(ev: Evidence) -> DataFrame:
    """While research is off only tasks asked for may be claimed."""
    return ev.tasks.filter("status = 'pending' and origin = 'on_demand'").groupBy("kind").agg(F.count(F.lit(1)).alias("claimable"))


@query("retry_backoff", with_("tasks", "SELECT task_id, attempts>=3 AS dead, CASE WHEN attempts<3 THEN 30.0::DOUBLE*pow(2.0::DOUBLE,attempts-1) END AS delay FROM tasks WHERE status='failed'"))
def retry_backoff(ev: Evidence) -> DataFrame:
    a = F.col("attempts")
    return ev.tasks.filter("status = 'failed'").select("task_id", (a >= 3).alias("dead"), F.when(a < 3, K.retry_delay(a)).alias("delay"))


@query("dead_letters", with_("tasks", "SELECT task_id, kind FROM tasks WHERE status='dead' ORDER BY finished_at DESC, task_id LIMIT 20"))
def dead_letters(ev: Evidence) -> DataFrame:
    return ev.tasks.filter("status = 'dead'").orderBy(F.desc("finished_at"), "task_id").limit(20).select("task_id", "kind")


@query("dedup_hourly", with_("tasks", "SELECT kind||':'||strftime(scheduled_at, '%Y-%m-%dT%H') AS dedup_key, min(task_id) AS task_id, count(*) AS n FROM tasks GROUP BY 1"))
def dedup_hourly(ev: Evidence) -> DataFrame:
    key = F.concat_ws(":", "kind", F.date_format("scheduled_at", "yyyy-MM-dd'T'HH"))
    return ev.tasks.groupBy(key.alias("dedup_key")).agg(F.min("task_id").alias("task_id"), F.count(F.lit(1)).alias("n"))


@query("daily_cap", with_("tasks", "SELECT task_id FROM tasks QUALIFY row_number() OVER (PARTITION BY CAST(scheduled_at AS DATE) ORDER BY scheduled_at, task_id)<=6"))
def daily_cap(ev: Evidence) -> DataFrame:
    t = ev.tasks.withColumn("day", F.to_date("scheduled_at"))
    return K.first_n(t, ["day"], [F.col("scheduled_at"), F.col("task_id")], 6).select("task_id")


@query("promote_slots", with_("questions", f"""SELECT question_id, focus_id FROM (SELECT *, row_number() OVER (PARTITION BY focus_id ORDER BY priority DESC, question_id) AS r FROM questions WHERE status='open') q
  WHERE r <= {L.HUMAN_QUEUE * 20} - (SELECT count(*) FROM questions e WHERE e.status='escalated' AND e.focus_id=q.focus_id)"""))
def promote_slots(ev: Evidence) -> DataFrame:
    """Open questions that take the free places of the human queue (20 queues of the usual size)."""
    held = ev.questions.filter("status = 'escalated'").groupBy("focus_id").agg(F.count(F.lit(1)).alias("held"))
    first = K.first_n(ev.questions.filter("status = 'open'"), ["focus_id"], [F.desc("priority"), "question_id"], L.HUMAN_QUEUE * 20)
    return first.join(held, "focus_id", "left").filter(F.col("position") <= L.HUMAN_QUEUE * 20 - F.coalesce("held", F.lit(0))).select("question_id", "focus_id")


@query("park_overflow", with_("questions", f"SELECT question_id FROM questions WHERE status='open' QUALIFY row_number() OVER (PARTITION BY focus_id ORDER BY priority DESC, question_id)>{L.AUTO_QUEUE}"))
def park_overflow(ev: Evidence) -> DataFrame:
    open_ = ev.questions.filter("status = 'open'")
    first = K.first_n(open_, ["focus_id"], [F.desc("priority"), "question_id"], L.AUTO_QUEUE).select("question_id")
    return open_.select("question_id").join(first, "question_id", "left_anti")


@query("dispatchable_questions", with_("questions tasks", f"""SELECT question_id FROM questions q WHERE status='open' AND kind IN ('factual','synthesis') AND NOT stuck AND rounds<{L.MAX_ROUNDS}
  AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.status IN ('pending','running') AND t.user_id=q.question_id) ORDER BY priority DESC, question_id LIMIT {L.IN_FLIGHT}"""))
def dispatchable_questions(ev: Evidence) -> DataFrame:
    live = ev.tasks.filter("status in ('pending', 'running')").select(F.col("user_id").alias("question_id"))
    q = ev.questions.filter(f"status = 'open' and kind in ('factual', 'synthesis') and not stuck and rounds < {L.MAX_ROUNDS}").join(live, "question_id", "left_anti")
    return q.orderBy(F.desc("priority"), "question_id").limit(L.IN_FLIGHT).select("question_id")


@query("stranded", with_("questions tasks", "SELECT question_id FROM questions q WHERE status='answered' AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.status='done' AND t.user_id=q.question_id)"))
def stranded(ev: Evidence) -> DataFrame:
    done = ev.tasks.filter("status = 'done' and user_id is not null").select(F.col("user_id").alias("question_id"))
    return ev.questions.filter("status = 'answered'").join(done, "question_id", "left_anti").select("question_id")


@query("fresh_ids", with_("sources", "SELECT DISTINCT item_id::VARCHAR AS external_id FROM benchmark WHERE item_id::VARCHAR NOT IN (SELECT external_id FROM sources WHERE kind='doc' AND approved)"))
def fresh_ids(ev: Evidence) -> DataFrame:
    ids = ev.read("benchmark").select(F.col("item_id").cast("string").alias("external_id")).distinct()
    return ids.join(ev.sources.filter("kind = 'doc' and approved").select("external_id"), "external_id", "left_anti")


@query("approved_sources", with_("sources registries", "SELECT source_id, s.registry FROM sources s WHERE s.approved AND EXISTS (SELECT 1 FROM registries r WHERE r.registry=s.registry AND r.approved AND r.yields_evidence)"))
def approved_sources(ev: Evidence) -> DataFrame:
    """Sources whose texts may become claims: approved, of an approved registry that yields evidence; an unknown registry doesn't."""
    gate = ev.registries.filter("approved and yields_evidence").select("registry")
    return ev.sources.filter("approved").join(gate, "registry", "left_semi").select("source_id", "registry")


@query("history_budget", with_("messages", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER w AS r, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS used FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, role, text)) WHERE r=1 OR used<=600"))
def history_budget(ev: Evidence) -> DataFrame:
    m = ev.messages.withColumn("key", F.struct((-F.col("turn")).alias("t"), "role", "text"))
    return K.within_budget(m, "conv_id", F.col("key"), F.length("text"), 600).select("conv_id", "turn")


@query("history_oldest", with_("messages", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM messages) WHERE r=1 OR used<=600"))
def history_oldest(ev: Evidence) -> DataFrame:
    """The same from the beginning: the first messages while they fit."""
    m = ev.messages.withColumn("key", F.struct("turn", "role", "text"))
    return K.within_budget(m, "conv_id", F.col("key"), F.length("text"), 600).select("conv_id", "turn")


SEEN = "event_id%3=0"


@query("notify_delta_ids", f"SELECT event_id FROM events WHERE event_type='purchase' AND NOT ({SEEN})")
def notify_delta_ids(ev: Evidence) -> DataFrame:
    e = ev.read("events")
    return e.filter("event_type = 'purchase'").join(e.filter("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


@query("notify_delta_counts", f"SELECT event_type AS kind, count(*)-count(*) FILTER ({SEEN}) AS fresh FROM events GROUP BY 1 HAVING fresh>0")
def notify_delta_counts(ev: Evidence) -> DataFrame:
    e = ev.read("events")
    now, seen = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), e.filter("event_id % 3 = 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("s"))
    j = now.join(seen, "event_type", "left").withColumn("fresh", F.col("n") - F.coalesce("s", F.lit(0)))
    return j.filter("fresh > 0").select(F.col("event_type").alias("kind"), "fresh")


@query("mark_reconcile", "SELECT user_id, CASE WHEN user_id%2=0 THEN count(DISTINCT event_type) ELSE count(DISTINCT CASE WHEN event_id%3=0 THEN event_type END) END AS kept FROM events GROUP BY 1")
def mark_reconcile(ev: Evidence) -> DataFrame:
    """Next mark: all of now where the notice was delivered, else what both had."""
    seen = F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    g = ev.read("events").groupBy("user_id").agg(F.collect_set("event_type").alias("now"), seen.alias("seen"))
    kept = F.when(F.col("user_id") % 2 == 0, F.size("now")).otherwise(F.size(F.array_intersect("now", "seen")))
    return g.select("user_id", kept.cast("long").alias("kept"))


@query("mark_minimum", f"SELECT user_id, event_type AS kind, least(count(*), count(*) FILTER ({SEEN})) AS n FROM events GROUP BY 1,2")
def mark_minimum(ev: Evidence) -> DataFrame:
    """After a notice that wasn't delivered a mark holds, of each kind, the lesser of what it had and what there is."""
    g = ev.read("events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("now"), count_if(F.col("event_id") % 3 == 0).alias("seen"))
    return g.select("user_id", "kind", F.least("now", "seen").alias("n"))


@query("upsert_sources", with_("sources", "SELECT source_id, coalesce(n.title, s.title) AS title, coalesce(n.year, s.year) AS year FROM sources s FULL JOIN (SELECT item_id*2 AS source_id, CASE WHEN item_id%2=0 THEN left(text,20) END AS title, 2024 AS year FROM benchmark) n USING (source_id)"))
def upsert_sources(ev: Evidence) -> DataFrame:
    i = F.col("item_id")
    new = ev.read("benchmark").select((i * 2).alias("source_id"), F.when(i % 2 == 0, F.left("text", F.lit(20))).alias("title"), F.lit(2024).alias("year"))
    return K.upsert(ev.sources.select("source_id", "title", "year"), new, ["source_id"])


@query("insert_ignore", with_("hypotheses", "SELECT DISTINCT focus_id, statement FROM (SELECT 1+(p_partkey%3=0)::INT AS focus_id, CASE WHEN p_partkey%5=0 THEN p_name||' again' ELSE p_name END AS statement FROM part) n WHERE NOT EXISTS (SELECT 1 FROM hypotheses h WHERE h.focus_id=n.focus_id AND h.statement=n.statement)"))
def insert_ignore(ev: Evidence) -> DataFrame:
    new = ev.read("part").select((F.lit(1) + (F.col("p_partkey") % 3 == 0).cast("int")).alias("focus_id"), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" again"))).otherwise(F.col("p_name")).alias("statement"))
    return K.insert_ignore(ev.hypotheses, new, ["focus_id", "statement"])


@query("retention_purge", with_("tasks", f"SELECT status, count(*) AS kept FROM tasks WHERE NOT (status='done' AND finished_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) GROUP BY 1"))
def retention_purge(ev: Evidence) -> DataFrame:
    old = (F.col("status") == "done") & (F.col("finished_at") < F.expr(f"timestamp'{NOW}' - interval 7 day"))
    return ev.tasks.filter(~old | F.col("finished_at").isNull()).groupBy("status").agg(F.count(F.lit(1)).alias("kept"))


@query("cascade_delete", with_("claims directness sources links chunks claim_chunks", """, left_ AS (SELECT claim_id, source_id FROM claims WHERE source_id IN (SELECT source_id FROM sources WHERE approved)) SELECT 'claims' AS what, count(*) AS n FROM left_ UNION ALL SELECT 'judgments', count(*) FROM directness WHERE claim_id IN (SELECT claim_id FROM left_)
  UNION ALL SELECT 'links', count(*) FROM links WHERE claim_id IN (SELECT claim_id FROM left_) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE source_id IN (SELECT source_id FROM sources WHERE approved) UNION ALL SELECT 'named chunks', count(*) FROM claim_chunks WHERE claim_id IN (SELECT claim_id FROM left_)"""))
def cascade_delete(ev: Evidence) -> DataFrame:
    """What is left when unapproved sources go: with their claims go judgments, links and the chunks that claims name, and with the sources their chunks (of the index: ``bm25_after_removal``)."""
    gone = ev.sources.filter("not approved").select("source_id")
    claims = ev.claims.select("claim_id", "source_id").join(gone, "source_id", "left_anti").join(ev.sources.select("source_id"), "source_id", "left_semi")
    with_claims = {"judgments": ev.directness, "links": ev.links, "named chunks": ev.claim_chunks}
    left = {"claims": claims, "chunks": ev.chunks.select("source_id").join(gone, "source_id", "left_anti"), **{name: t.join(claims, "claim_id", "left_semi") for name, t in with_claims.items()}}
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, t in left.items()))


#: Rows that a task sorts when constraints are checked, about.
SORTED_ROWS = 250_000


@query("validate_constraints", with_("claims scale_levels directness sources links hypotheses", """SELECT 'confidence' AS rule, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS broken FROM claims UNION ALL SELECT 'direction', count(*) FILTER (direction NOT IN ('positive','negative','null','mixed')) FROM claims
  UNION ALL SELECT 'grade', count(*) FROM claims WHERE grade NOT IN (SELECT value FROM scale_levels WHERE axis='grade') UNION ALL SELECT 'directness', count(*) FROM directness WHERE directness NOT IN (SELECT value FROM scale_levels WHERE axis='directness') UNION ALL
  SELECT 'source', count(*) FROM claims WHERE source_id NOT IN (SELECT source_id FROM sources) UNION ALL SELECT 'judged_claim', count(*) FROM directness WHERE claim_id NOT IN (SELECT claim_id FROM claims) UNION ALL SELECT 'linked_claim', count(*) FROM links WHERE claim_id NOT IN (SELECT claim_id FROM claims) UNION ALL
  SELECT 'one_link', count(*) FROM (SELECT 1 FROM links GROUP BY claim_id, hypothesis_id HAVING count(*)>1) UNION ALL SELECT 'one_identity', count(*) FROM (SELECT 1 FROM sources GROUP BY kind, external_id HAVING count(*)>1) UNION ALL SELECT 'one_doi', count(*) FROM (SELECT 1 FROM sources WHERE doi IS NOT NULL GROUP BY trim(lower(doi)) HAVING count(*)>1) UNION ALL
  SELECT 'modulator', count(*) FILTER (NOT modulator BETWEEN 0 AND 1) FROM links UNION ALL SELECT 'novelty', count(*) FILTER (NOT novelty BETWEEN 0 AND 1) FROM hypotheses UNION ALL SELECT 'tier', count(*) FILTER (tier NOT IN ('speculative','supported','rejected')) FROM hypotheses UNION ALL SELECT 'one_judgment', count(*) FROM (SELECT 1 FROM directness GROUP BY claim_id, focus_id HAVING count(*)>1)
  UNION ALL SELECT 'intervention', count(*) FILTER (trim(coalesce(intervention,''))='') FROM claims"""))
def validate_constraints(ev: Evidence) -> DataFrame:
    """Broken rows by rule: ranges, vocabularies, references and uniqueness.

    What is sorted by claim is dealt to parts of bounded size, so that no task's sort grows with the tables."""
    li = ev.read("lineitem")
    parts = max(1, -(-li.count() // SORTED_ROWS))
    c = ev.claims
    in_row = c.agg(
        count_if(~F.col("confidence").between(0, 1)).alias("confidence"), count_if(~F.col("direction").isin("positive", "negative", "null", "mixed")).alias("direction"), count_if(F.trim(F.coalesce("intervention", F.lit(""))) == "").alias("intervention")
    )
    words = lambda axis: ev.levels.filter(F.col("axis") == axis).select(F.col("value").alias(axis)).distinct()
    missing = lambda df, other, key: df.join(other.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("broken"))
    dealt = lambda df, key: df.repartition(parts, key)
    claim_ids = dealt(c.select("claim_id"), "claim_id")
    repeated = lambda df, *key: df.groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("broken"))
    s, d, k, h = ev.sources, dealt(ev.directness, "claim_id"), ev.links_of(dealt(li, "l_orderkey")), ev.hypotheses
    across = {
        "grade": missing(c, words("grade"), "grade"), "directness": missing(d, words("directness"), "directness"), "source": missing(c, s, "source_id"), "judged_claim": missing(d, claim_ids, "claim_id"), "linked_claim": missing(k, claim_ids, "claim_id"),
        "one_judgment": repeated(d, "claim_id", "focus_id"), "one_link": repeated(k, "claim_id", "hypothesis_id"), "one_identity": repeated(s, "kind", "external_id"), "one_doi": repeated(s.filter("doi is not null"), F.trim(F.lower("doi"))),
        "modulator": k.agg(F.coalesce(count_if(~F.col("modulator").between(0, 1)), F.lit(0)).alias("broken")), "novelty": h.agg(F.coalesce(count_if(~F.col("novelty").between(0, 1)), F.lit(0)).alias("broken")),
        "tier": h.agg(F.coalesce(count_if(~F.col("tier").isin("speculative", "supported", "rejected")), F.lit(0)).alias("broken")),
    }
    out = in_row.unpivot([], ["confidence", "direction", "intervention"], "rule", "broken")
    for rule, n in across.items():
        out = out.unionByName(n.select(F.lit(rule).alias("rule"), "broken"))
    return out


@query("gate_funnel", with_("runs", """SELECT origin, count(*) AS n, CAST(sum(proposed) AS BIGINT) AS proposed, CAST(sum(anchored) AS BIGINT) AS anchored, CAST(sum(verified) AS BIGINT) AS verified, CAST(sum(annihilated) AS BIGINT) AS annihilated, CAST(sum(sterile) AS BIGINT) AS sterile, count(*)-count(annihilated) AS unknown,
  round(coalesce(sum(anchored)/sum(proposed),0),9) AS anchor_rate FROM runs GROUP BY 1"""))
def gate_funnel(ev: Evidence) -> DataFrame:
    g = ev.runs.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in ("proposed", "anchored", "verified", "annihilated", "sterile")], count_if(F.col("annihilated").isNull()).alias("unknown"))
    return g.withColumn("anchor_rate", F.round(ratio(F.col("anchored"), F.col("proposed")), 9))


@query("gate_report", with_("runs", """SELECT count(*) AS n, CAST(coalesce(sum(proposed), 0) AS BIGINT) AS proposed, CAST(coalesce(sum(anchored), 0) AS BIGINT) AS anchored, CAST(coalesce(sum(verified), 0) AS BIGINT) AS verified, CAST(sum(annihilated) AS BIGINT) AS annihilated, CAST(sum(sterile) AS BIGINT) AS sterile,
  count(*) FILTER (annihilated IS NULL) AS unknown, count(*) FILTER (origin='log') AS second_hand, round(sum(anchored)/sum(proposed)*100, 1) AS anchored_pct, round(sum(verified)/sum(anchored)*100, 1) AS verified_pct FROM runs"""))
def gate_report(ev: Evidence) -> DataFrame:
    """Both gates over all runs: what is unknown stays unknown in the sums of chunks, and runs read from a log are second-hand."""
    g = ev.runs.agg(
        F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("proposed", "anchored", "verified")), *(F.sum(c).cast("long").alias(c) for c in ("annihilated", "sterile")),
        count_if(F.col("annihilated").isNull()).alias("unknown"), count_if(F.col("origin") == "log").alias("second_hand"),
    )
    pct = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)) * 100, 1)
    return g.withColumn("anchored_pct", pct("anchored", "proposed")).withColumn("verified_pct", pct("verified", "anchored"))


@query("chunk_outcomes", with_("claims chunks claim_chunks", """SELECT source_id, count(*) AS seen, count(*) FILTER (good) AS yielding, count(*) FILTER (lost AND NOT good) AS annihilated, count(*) FILTER (NOT good AND NOT coalesce(refused, FALSE)) AS sterile FROM
  (SELECT k.source_id, k.chunk_id, coalesce(bool_or(verified), FALSE) AS good, bool_or(NOT verified) AS refused, coalesce(bool_or(NOT verified AND direction<>'null'), FALSE) AS lost FROM chunks k LEFT JOIN claim_chunks cc USING (chunk_id) LEFT JOIN claims c ON c.claim_id=cc.claim_id GROUP BY 1, 2) GROUP BY 1"""))
def chunk_outcomes(ev: Evidence) -> DataFrame:
    """Per source: chunks seen; yielding with a claim that holds; annihilated: proposed and lost all (errors, here claims without a direction, aside); sterile: nothing was proposed."""
    good, lost = F.col("verified"), ~F.col("verified")
    told = ev.claim_chunks.select("claim_id", "chunk_id").join(ev.claims.select("claim_id", "verified", "direction"), "claim_id")
    told = told.groupBy("chunk_id").agg(F.max(good).alias("good"), F.max(lost).alias("refused"), F.max(lost & (F.col("direction") != "null")).alias("lost"))
    c = ev.chunks.select("source_id", "chunk_id").join(told, "chunk_id", "left").fillna(False, ["good", "refused", "lost"])
    g, r = F.col("good"), F.col("refused")
    return c.groupBy("source_id").agg(F.count(F.lit(1)).alias("seen"), count_if(g).alias("yielding"), count_if(F.col("lost") & ~g).alias("annihilated"), count_if(~g & ~r).alias("sterile"))


@query("answer_decision", with_("questions", f"""SELECT question_id, CASE WHEN question_id%7=0 THEN 'search_again' WHEN question_id%5=4 THEN 'search_again' WHEN question_id%2=0 AND question_id%4>=2 THEN 'answer'
  WHEN stuck OR rounds>={L.MAX_ROUNDS} THEN CASE WHEN question_id%9>={L.HUMAN_QUEUE} THEN 'open' ELSE 'escalate' END ELSE 'search_again' END AS action FROM questions"""))
def answer_decision(ev: Evidence) -> DataFrame:
    k = F.col("question_id")
    sufficient = F.when(k % 5 != 4, k % 2 == 0)
    action = K.answer_action(k % 7 == 0, sufficient, k % 4, F.col("stuck"), F.col("rounds"), L.HUMAN_QUEUE, L.MAX_ROUNDS, k % 9)
    return ev.questions.select("question_id", action.alias("action"))


@query("backlog", with_("questions tasks", "SELECT 'escalated' AS queue, count(*) FILTER (status='escalated') AS n FROM questions UNION ALL SELECT 'held', count(*) FILTER (status='open' AND rounds>=3) FROM questions UNION ALL SELECT 'running', count(*) FILTER (status='running') FROM tasks"))
def backlog(ev: Evidence) -> DataFrame:
    s = F.col("status")
    q = ev.questions.agg(count_if(s == "escalated").alias("escalated"), count_if((s == "open") & (F.col("rounds") >= 3)).alias("held"))
    return q.crossJoin(ev.tasks.agg(count_if(s == "running").alias("running"))).unpivot([], ["escalated", "held", "running"], "queue", "n")


@query("backpressure", with_("calls", "SELECT user_id, list_reduce(list_prepend(8, list(CASE WHEN ok THEN 0 ELSE 1 END ORDER BY created_at, call_id)), lambda a, x: CASE WHEN x=1 THEN greatest(1, a//2) ELSE least(8, a+1) END) AS allowance FROM calls JOIN (SELECT event_id AS call_id, user_id FROM events) USING (call_id) GROUP BY 1"))
def backpressure(ev: Evidence) -> DataFrame:
    """The allowance of each user's calls after a replay of their outcomes in time order.

    An hour's outcomes are folded into what they make of each allowance from 1 to 8, and hours are then chained."""
    pressed = ev.calls.join(ev.read("events").select(F.col("event_id").alias("call_id"), "user_id"), "call_id").withColumn("hour", F.date_trunc("hour", "created_at"))
    hours = pressed.groupBy("user_id", "hour").agg(F.array_sort(F.collect_list(F.struct("created_at", "call_id", (~F.col("ok")).alias("pressed")))).alias("o"))
    hours = hours.select("user_id", "hour", K.allowances(F.transform("o", lambda x: x["pressed"]), 8).alias("becomes"))
    g = hours.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("hour", "becomes"))).alias("h"))
    return g.select("user_id", F.aggregate("h", F.lit(8), lambda a, x: F.element_at(x["becomes"], a)).alias("allowance"))


@query("compare_and_set", with_("tasks", "SELECT user_id, arg_min(status, (scheduled_at, task_id)) AS decision FROM tasks WHERE status IN ('done','failed','dead') GROUP BY 1"))
def compare_and_set(ev: Evidence) -> DataFrame:
    """The first decision stands."""
    t = ev.tasks.filter("status in ('done', 'failed', 'dead')")
    return t.groupBy("user_id").agg(F.min_by("status", F.struct("scheduled_at", "task_id")).alias("decision"))


@query("latest_per_key", with_("tasks", "SELECT user_id, kind, arg_max(task_id, (scheduled_at, task_id)) AS task_id FROM tasks GROUP BY 1,2"))
def latest_per_key(ev: Evidence) -> DataFrame:
    return ev.tasks.groupBy("user_id", "kind").agg(F.max_by("task_id", F.struct("scheduled_at", "task_id")).alias("task_id"))


@query("stream_delta_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1,2")
def stream_delta_counts(ev: Evidence) -> DataFrame:
    return deltas.daily_counts(ev.spark, ev.sf_dir)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedup(ev: Evidence) -> DataFrame:
    return deltas.first_seen(ev.spark, ev.sf_dir)
