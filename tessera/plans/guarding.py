"""Queries on guards, validation, hashes, sinks, schedules and migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.functions.semantics import count_if
from tessera.operators import guard as G
from tessera.operators import weight as W
from tessera.operators import work as K
from tessera.plans.registry import query
from tessera.plans.weighing import BASE, CW
from tessera.sources.evidence import Evidence, with_
from tessera.streaming import deltas, marks
from tessera.streaming import queue as Q

NOW = "2024-01-30 00:00:00"


@query("pattern_entailed", with_("hypotheses entailments", "SELECT hypothesis_id, follows IS TRUE AND exceeds IS FALSE AND contradicts IS FALSE AND restates IS FALSE AS entailed FROM hypotheses LEFT JOIN entailments USING (hypothesis_id)"))
def pattern_entailed(ev: Evidence) -> DataFrame:
    """Whether a pattern follows from what it cites; a judge that leaves out an answer, or says nothing, says no."""
    v = ev.hypotheses.select("hypothesis_id").join(ev.entailments, "hypothesis_id", "left")
    return v.select("hypothesis_id", G.entailed(*map(F.col, ("follows", "exceeds", "contradicts", "restates"))).alias("entailed"))


OK = "enough IS TRUE AND on_target IS TRUE AND sources>=2 AND blocked IS NULL"


@query("sufficiency", with_("questions verdicts", f"""SELECT question_id, coalesce({OK}, FALSE) AS sufficient, coalesce({OK} AND articles>={L.MIN_ARTICLES}, FALSE) AS answerable, CASE WHEN {OK} AND articles>={L.MIN_ARTICLES} THEN CASE WHEN agree THEN 0.8 ELSE 0.5 END::DOUBLE END AS confidence
  FROM questions LEFT JOIN verdicts USING (question_id)"""))
def sufficiency(ev: Evidence) -> DataFrame:
    """The judge's four answers, the floor of two distinct articles, and how sure an answer is."""
    v = ev.questions.select("question_id").join(ev.verdicts, "question_id", "left")
    yes = G.sufficient(*map(F.col, ("enough", "on_target", "sources", "blocked")))
    can = yes & F.coalesce(F.col("articles") >= L.MIN_ARTICLES, F.lit(False))
    return v.select("question_id", yes.alias("sufficient"), can.alias("answerable"), F.when(can, G.confidence(F.col("agree"))).alias("confidence"))


@query("round_outcome", with_("questions verdicts", f"""SELECT question_id, action, CASE WHEN coalesce(unchanged, FALSE) THEN rounds ELSE rounds+1 END AS rounds, CASE WHEN action='escalate' THEN coalesce(blocked, 'insufficient_evidence') END AS reason FROM
  (SELECT *, CASE WHEN coalesce(unchanged, TRUE) THEN 'search_again' WHEN {OK} AND articles>={L.MIN_ARTICLES} THEN 'answer' WHEN blocked IS NOT NULL OR rounds+1>={L.MAX_ROUNDS} THEN 'escalate' ELSE 'search_again' END AS action
  FROM questions LEFT JOIN verdicts USING (question_id) WHERE status='open')"""))
def round_outcome(ev: Evidence) -> DataFrame:
    """What a round of answering leads to: unchanged evidence costs no round; no verdict searches again; else answer, escalate or search again."""
    q = ev.questions.filter("status = 'open'").join(ev.verdicts, "question_id", "left")
    ok = G.sufficient(*map(F.col, ("enough", "on_target", "sources", "blocked"))) & F.coalesce(F.col("articles") >= L.MIN_ARTICLES, F.lit(False))
    silent, same = F.col("unchanged").isNull(), F.coalesce("unchanged", F.lit(False))
    over = F.col("blocked").isNotNull() | (F.col("rounds") + 1 >= L.MAX_ROUNDS)
    action = F.when(same | silent, "search_again").when(ok, "answer").when(over, "escalate").otherwise("search_again")
    rounds = F.when(same, F.col("rounds")).otherwise(F.col("rounds") + 1)
    return q.select("question_id", action.alias("action"), rounds.alias("rounds"), F.when(action == "escalate", F.coalesce("blocked", F.lit("insufficient_evidence"))).alias("reason"))


@query("answer_rounds", with_("questions claims", "SELECT question_id, rounds+1 AS round, count(claim_id) AS claims, md5(count(claim_id)||':'||coalesce(bit_xor(('0x'||left(md5(claim_id::VARCHAR),12))::BIGINT),0)||':'||coalesce(sum(('0x'||left(md5(claim_id::VARCHAR),12))::BIGINT),0)) AS fingerprint FROM questions LEFT JOIN claims ON claims.source_id=question_id AND verified WHERE status='open' GROUP BY 1,2"))
def answer_rounds(ev: Evidence) -> DataFrame:
    """A row of the log for each round, with a fingerprint of the set of claims that it saw."""
    c = ev.claims.filter("verified").select(F.col("source_id").alias("question_id"), "claim_id")
    h = F.conv(F.left(F.md5(F.col("claim_id").cast("string")), F.lit(12)), 16, 10).cast("long")
    g = ev.questions.filter("status = 'open'").join(c, "question_id", "left").groupBy("question_id", (F.col("rounds") + 1).alias("round"))
    g = g.agg(F.count("claim_id").alias("claims"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h), F.lit(0)).alias("s"))
    return g.select("question_id", "round", "claims", F.md5(F.concat_ws(":", "claims", "x", "s")).alias("fingerprint"))


@query("call_pressure", with_("calls", "SELECT label, count(*) FILTER (call_id%17=0 OR call_id%400+200=429 OR call_id%400+200>=500) AS pressed, count(*) AS n FROM calls WHERE NOT ok GROUP BY 1"))
def call_pressure(ev: Evidence) -> DataFrame:
    k = F.col("call_id")
    pressed = G.is_pressure(F.when(k % 400 != 1, k % 400 + 200), k % 17 == 0)
    return ev.calls.filter("not ok").groupBy("label").agg(count_if(pressed).alias("pressed"), F.count(F.lit(1)).alias("n"))


@query("budget_guard", "SELECT doc_id, length(text)//4 AS tokens FROM documents WHERE length(text)//4+512>4096-256")
def budget_guard(ev: Evidence) -> DataFrame:
    """Texts that don't fit into a window of 4096 tokens beside an answer of 512."""
    d = ev.read("documents").filter(G.over_budget(F.col("text"), F.lit(512), F.lit(4096)))
    return d.select("doc_id", F.floor(F.length("text") / G.CHARS_PER_TOKEN).alias("tokens"))


@query("focus_drift", with_("tasks active_focus", "SELECT kind, count(*) AS refused FROM tasks CROSS JOIN active_focus WHERE status='pending' AND CASE WHEN task_id%4<>0 THEN 1+task_id%3 END<>focus_id GROUP BY 1"))
def focus_drift(ev: Evidence) -> DataFrame:
    """Tasks asked for under another focus are refused."""
    k = F.col("task_id")
    t = ev.tasks.filter("status = 'pending'").join(ev.active_focus.select("focus_id"), F.lit(True), "left")
    return t.filter(G.drifted(F.when(k % 4 != 0, 1 + k % 3), F.col("focus_id"))).groupBy("kind").agg(F.count(F.lit(1)).alias("refused"))


@query("unread_chunks", with_("chunks claims claim_chunks", "SELECT source_id, count(*) AS n FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM claim_chunks) GROUP BY 1"))
def unread_chunks(ev: Evidence) -> DataFrame:
    """Chunks that no claim names, which an extraction still has to read."""
    return ev.chunks.join(ev.claim_chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_upsert", with_("chunks", f"SELECT source_id, ord, coalesce(n.text, o.text) AS text FROM (SELECT source_id, ord, left(text,20) AS text FROM chunks) o FULL JOIN (SELECT item_id AS source_id, item_id%3 AS ord, left(text,15) AS text FROM benchmark) n USING (source_id, ord)"))
def chunk_upsert(ev: Evidence) -> DataFrame:
    """Chunks by source and place; the last text written stays."""
    new = ev.read("benchmark").select(F.col("item_id").alias("source_id"), (F.col("item_id") % 3).cast("int").alias("ord"), F.left("text", F.lit(15)).alias("text"))
    return K.upsert(ev.chunks.select("source_id", "ord", F.left("text", F.lit(20)).alias("text")), new, ["source_id", "ord"])


@query("embedding_dims", "SELECT len(embedding)=64 AS fits, count(*) AS n FROM (SELECT CASE WHEN vec_id%10=3 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings) GROUP BY 1")
def embedding_dims(ev: Evidence) -> DataFrame:
    """Vectors whose length is the model's may be stored."""
    v = F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return ev.read("embeddings").select((F.size(v) == 64).alias("fits")).groupBy("fits").agg(F.count(F.lit(1)).alias("n"))


@query("claims_and_edges", with_("claims", "SELECT 'claim' AS kind, claim_id, nullif(trim(intervention),'') AS value FROM claims WHERE claim_id%4=0 UNION ALL SELECT 'edge', claim_id, ['direct','partial','indirect','extrapolated'][1+claim_id%4] FROM claims WHERE claim_id%4=0 AND claim_id%3<>0 AND verified"))
def claims_and_edges(ev: Evidence) -> DataFrame:
    """Two tables from one batch: its claims, blanks as null, and judgments of those that can be judged."""
    batch = ev.claims.filter("claim_id % 4 = 0")
    claims = batch.select(F.lit("claim").alias("kind"), "claim_id", F.nullif(F.trim("intervention"), F.lit("")).alias("value"))
    value = F.element_at(F.array(*[F.lit(v) for v, _ in L.DIRECTNESS]), (F.col("claim_id") % 4 + 1).cast("int"))
    return claims.unionByName(batch.filter("claim_id % 3 <> 0 and verified").select(F.lit("edge").alias("kind"), "claim_id", value.alias("value")))


@query("runs_and_rejections", with_("runs", "SELECT 'run' AS kind, run_id, proposed AS n FROM runs UNION ALL SELECT 'not_anchored', run_id, proposed-anchored FROM runs WHERE proposed>anchored UNION ALL SELECT 'not_verified', run_id, anchored-verified FROM runs WHERE anchored>verified"))
def runs_and_rejections(ev: Evidence) -> DataFrame:
    """A row for each run and one for each gate at which it lost proposals."""
    lost = [F.struct(F.lit("run").alias("kind"), F.col("proposed").alias("n")), F.when(F.col("proposed") > F.col("anchored"), F.struct(F.lit("not_anchored").alias("kind"), (F.col("proposed") - F.col("anchored")).alias("n"))), F.when(F.col("anchored") > F.col("verified"), F.struct(F.lit("not_verified").alias("kind"), (F.col("anchored") - F.col("verified")).alias("n")))]
    return ev.runs.select("run_id", F.explode(F.array_compact(F.array(*lost))).alias("x")).select("x.kind", "run_id", "x.n")


@query("report_windows", "SELECT report, count(*) AS n FROM (SELECT e.ts, min(r.at) AS report FROM events e JOIN (SELECT ts AS at FROM events WHERE event_id%200=0) r ON r.at>=e.ts GROUP BY e.event_id, e.ts) GROUP BY 1")
def report_windows(ev: Evidence) -> DataFrame:
    """Events by the report that covers them: each saved report moves the window on to its own time."""
    from pyspark.sql.window import Window

    e = ev.read("events").select("ts", F.when(F.col("event_id") % 200 == 0, F.col("ts")).alias("at"))
    days = e.withColumn("day", F.to_date("ts"))
    # the next report: of the same day, else the first of the next day that has one
    w = Window.partitionBy("day").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    first = days.groupBy("day").agg(F.min("at").alias("first")).withColumn("next_day", F.min("first").over(later))  # a row for each day
    r = days.withColumn("own", F.min("at").over(w)).join(F.broadcast(first.select("day", "next_day")), "day")
    return r.select(F.coalesce("own", "next_day").alias("report")).filter("report is not null").groupBy("report").agg(F.count(F.lit(1)).alias("n"))


@query("due_jobs", f"""SELECT name, CASE WHEN last_run IS NULL THEN run_on_start ELSE epoch(TIMESTAMP '{NOW}')-epoch(last_run)>=interval_s END AS due, CASE WHEN last_run IS NULL OR epoch(TIMESTAMP '{NOW}')-epoch(last_run)>=interval_s THEN TIMESTAMP '{NOW}' ELSE last_run END AS stored
  FROM (SELECT event_type||(user_id%5) AS name, 3600*(1+min(user_id)%12) AS interval_s, min(event_id)%2=0 AS run_on_start, CASE WHEN min(user_id)%3<>0 THEN date_trunc('second', max(ts)) END AS last_run FROM events GROUP BY 1)""")
def due_jobs(ev: Evidence) -> DataFrame:
    e = ev.read("events").groupBy(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("name"))
    jobs = e.agg((3600 * (1 + F.min("user_id") % 12)).alias("interval_s"), (F.min("event_id") % 2 == 0).alias("run_on_start"), F.when(F.min("user_id") % 3 != 0, F.date_trunc("second", F.max("ts"))).alias("last_run"))
    return G.due(jobs, F.lit(NOW).cast(jobs.schema["last_run"].dataType)).select("name", "due", "stored")


LOG = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'claimed' END"


@query("queue_replay", f"""SELECT task_id, CASE WHEN verb='queued' THEN 'pending' WHEN orphan OR verb='failed' THEN CASE WHEN attempts>=3 THEN 'dead' ELSE 'pending' END WHEN verb='claimed' THEN 'running' ELSE verb END AS state, attempts, orphan FROM
  (SELECT task_id, arg_max(verb, (ts, event_id)) AS verb, count(*) FILTER (verb='claimed') AS attempts, arg_max(verb, (ts, event_id))='claimed' AND epoch(TIMESTAMP '{NOW}')::BIGINT-floor(epoch(max(ts)))::BIGINT>86400 AS orphan
  FROM (SELECT *, user_id*10+event_id%7 AS task_id, {LOG} AS verb FROM events) GROUP BY 1)""")
def queue_replay(ev: Evidence) -> DataFrame:
    """The queue as its log leaves it: orphans and failures wait again or are dead."""
    e = ev.read("events")
    log = e.select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("task_id"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id"), F.expr(LOG).alias("verb"))
    return G.queue_state(log, F.lit(NOW).cast(log.schema["at"].dataType), 86_400, 3)


QUEUE = Q.Rules(lease_s=86_400, backoff_s=3_600, most=2)
STEP = f"""RECURSIVE log AS (SELECT user_id AS task_id, epoch(date_trunc('second', ts))::BIGINT AS s, {LOG} AS verb, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS i FROM events),
  st AS (SELECT DISTINCT task_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0 AS attempts, NULL::BIGINT AS due, NULL::BIGINT AS lease, 0 AS orphaned, 0 AS ignored FROM log UNION ALL
    SELECT task_id, i, CASE act WHEN 'queue' THEN 'pending' WHEN 'claim' THEN 'running' WHEN 'end' THEN 'done' WHEN 'die' THEN 'dead' WHEN 'again' THEN 'pending' ELSE state END, (attempts+(act='claim')::INT)::INT,
      CASE act WHEN 'queue' THEN s WHEN 'again' THEN s+{QUEUE.backoff_s}*(2**(attempts-1))::BIGINT ELSE due END, CASE WHEN act='claim' THEN s+{QUEUE.lease_s} WHEN act IN ('end','die','again') THEN NULL ELSE lease END, orphaned, (ignored+(act='none')::INT)::INT FROM
    (SELECT *, CASE WHEN verb='queued' AND state IS NULL THEN 'queue' WHEN verb='claimed' AND state='pending' AND due<=s THEN 'claim' WHEN verb='done' AND state='running' THEN 'end' WHEN verb='failed' AND state='running' THEN CASE WHEN attempts>={QUEUE.most} THEN 'die' ELSE 'again' END ELSE 'none' END AS act FROM
    (SELECT task_id, i, s, verb, attempts, CASE WHEN lost THEN 'pending' ELSE state END AS state, CASE WHEN lost THEN lease ELSE due END AS due, CASE WHEN lost THEN NULL ELSE lease END AS lease, (orphaned+lost::INT)::INT AS orphaned, ignored FROM
    (SELECT st.task_id, l.i, l.s, l.verb, state, attempts, due, lease, orphaned, ignored, coalesce(state='running' AND l.s>lease, FALSE) AS lost FROM st JOIN log l ON l.task_id=st.task_id AND l.i=st.i+1))))"""


@query("queue_stream", f"""WITH {STEP} SELECT task_id, CASE WHEN gone THEN 'pending' ELSE state END AS state, attempts, (orphaned+gone::INT)::INT AS orphaned, ignored, i AS entries FROM
  (SELECT *, coalesce(state='running' AND lease<epoch(TIMESTAMP '{NOW}')::BIGINT, FALSE) AS gone FROM st QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY i DESC)=1)""")
def queue_stream(ev: Evidence) -> DataFrame:
    """Every task as a stream of its log leaves it, with leases, retries and what was ignored, at a time of reading."""
    e = deltas.event_stream(ev.spark, ev.sf_dir)
    log = e.select(F.col("user_id").alias("task_id"), F.date_trunc("second", "ts").alias("at"), F.col("event_id").alias("entry_id"), F.expr(LOG).alias("verb"))
    states = Q.at_time(Q.queue_states(log, QUEUE), F.lit(NOW).cast("timestamp"))
    return states.select("task_id", "state", "attempts", "orphaned", "ignored", F.col("entries").cast("long").alias("entries"))


@query("report_marks", "SELECT event_type AS what, count(*) AS events, (SELECT max(ts) FROM events) AS until FROM events GROUP BY 1")
def report_marks(ev: Evidence) -> DataFrame:
    """What all reports of a stream say together, and the mark that the last one has left."""
    e = deltas.event_stream(ev.spark, ev.sf_dir).select("ts", F.col("event_type").alias("what"))
    rows = marks.reported(e)
    last = rows.agg(F.max("until").alias("until"))
    return rows.groupBy("what").agg(F.sum(F.col("n") + F.col("late")).alias("events")).crossJoin(F.broadcast(last))  # one row


@query("scale_guard", with_("focuses claims active_focus", "SELECT f.focus_id, EXISTS (SELECT 1 FROM claims c WHERE c.scale_id=f.scale_id) AS scale_in_use, f.focus_id IS NOT DISTINCT FROM (SELECT focus_id FROM active_focus) AS active, f.retired FROM focuses f"))
def scale_guard(ev: Evidence) -> DataFrame:
    """Of each focus: whether claims are graded on its scale (then it stays as it is), and whether it is the active one (then it can't retire)."""
    used = ev.claims.select("scale_id").distinct().withColumn("used", F.lit(True))
    a = ev.active_focus.select("focus_id", F.lit(True).alias("a"))
    f = ev.focuses.join(used, "scale_id", "left").join(a, "focus_id", "left")
    return f.select("focus_id", F.coalesce("used", F.lit(False)).alias("scale_in_use"), F.coalesce("a", F.lit(False)).alias("active"), "retired")


@query("shown_references", with_("claims proposals", "SELECT proposal_id, count(*) AS n, min(c.claim_id) AS first_claim FROM (SELECT proposal_id, unnest([proposal_id%13, proposal_id%7]) AS ref FROM proposals) r JOIN (SELECT DISTINCT claim_id FROM claims WHERE verified) c ON c.claim_id=r.ref WHERE proposal_id NOT IN (SELECT proposal_id FROM (SELECT proposal_id, unnest([proposal_id%13, proposal_id%7]) AS ref FROM proposals) WHERE ref NOT IN (SELECT claim_id FROM claims WHERE verified)) GROUP BY 1"))
def shown_references(ev: Evidence) -> DataFrame:
    """A proposal counts only if everything that it refers to was shown."""
    k = F.col("proposal_id")
    refs = ev.proposals.select("proposal_id", F.explode(F.array(k % 13, k % 7)).alias("ref"))
    shown = ev.claims.filter("verified").select(F.col("claim_id").alias("ref")).distinct()
    return G.all_or_nothing(refs, shown, "proposal_id", "ref").groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("first_claim"))


@query("dead_marks", "SELECT kind, max(n) AS n FROM (SELECT user_id%20 AS focus, event_type AS kind, count(*) AS n FROM events GROUP BY 1,2) GROUP BY 1")
def dead_marks(ev: Evidence) -> DataFrame:
    """One mark for all from the marks of each focus: of every kind the highest count."""
    marks = ev.read("events").groupBy((F.col("user_id") % 20).alias("focus"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = marks.groupBy("focus").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a few kinds
    return maps.select(F.explode("m").alias("kind", "n")).groupBy("kind").agg(F.max("n").alias("n"))


@query("relens_cost", with_("claims directness active_focus", f"SELECT count(*) AS claims, round(count(*)*{G.SECONDS_PER_CLAIM}/3600, 6) AS hours FROM claims c CROSS JOIN active_focus f WHERE verified AND c.scale_id=f.focus_scale AND NOT EXISTS (SELECT 1 FROM directness d WHERE d.claim_id=c.claim_id AND d.focus_id=f.focus_id)"))
def relens_cost(ev: Evidence) -> DataFrame:
    """Claims that a change of focus would have judged, and the hours that takes."""
    c = ev.claims.filter("verified").join(ev.active_focus, F.col("scale_id") == F.col("focus_scale")).join(ev.directness.select("claim_id", "focus_id"), ["claim_id", "focus_id"], "left_anti")
    return c.agg(F.count(F.lit(1)).alias("claims")).withColumn("hours", F.round(F.col("claims") * G.SECONDS_PER_CLAIM / 3600, 6))


@query("planned_metrics", with_(BASE + " runs hypotheses", """SELECT 'anchor_share' AS metric, round(sum(anchored)/sum(proposed), 9) AS value FROM runs UNION ALL SELECT 'verified_share', round(sum(verified)/sum(anchored), 9) FROM runs
  UNION ALL SELECT 'grade_mass_'||grade, round(sum(weight), 6) FROM cw WHERE verified GROUP BY grade UNION ALL SELECT 'supported_share', round(count(*) FILTER (tier='supported')/count(*), 9) FROM hypotheses""", CW))
def planned_metrics(ev: Evidence) -> DataFrame:
    """Metrics that are specified but not reported elsewhere: anchoring, mass of evidence by grade, promotion."""
    r = ev.runs.agg(F.sum("proposed").alias("p"), F.sum("anchored").alias("a"), F.sum("verified").alias("v"))
    shares = r.select(F.round(F.col("a") / F.col("p"), 9).alias("anchor_share"), F.round(F.col("v") / F.col("a"), 9).alias("verified_share")).unpivot([], ["anchor_share", "verified_share"], "metric", "value")
    mass = W.claim_weight(ev).filter("verified").groupBy("grade").agg(F.round(F.sum("weight"), 6).alias("value")).select(F.concat(F.lit("grade_mass_"), "grade").alias("metric"), "value")
    promoted = ev.hypotheses.agg(F.round(count_if(F.col("tier") == "supported") / F.count(F.lit(1)), 9).alias("value")).select(F.lit("supported_share").alias("metric"), "value")
    return shares.unionByName(mass).unionByName(promoted)


LESSONS = """lg AS (SELECT user_id AS lesson, ts, event_id, event_type='purchase' AS alive FROM events WHERE event_type IN ('purchase', 'error')),
  turns AS (SELECT * FROM lg QUALIFY alive IS DISTINCT FROM lag(alive, 1, FALSE) OVER (PARTITION BY lesson ORDER BY ts, event_id)),
  lives AS (SELECT lesson, alive, ts, lead(ts) OVER w AS gone, row_number() OVER w AS n FROM turns WINDOW w AS (PARTITION BY lesson ORDER BY ts, event_id))"""
DESIGNED = """des AS (SELECT cw.weight, g.rank>d.rank AS promoted, d.rank=(SELECT min(rank) FROM scale_levels x WHERE x.axis='grade' AND x.scale_id=cw.scale_id) AS lowest FROM cw JOIN sources s USING (source_id) JOIN scale_levels d ON d.scale_id=cw.scale_id AND d.axis='grade' AND d.value=s.design
  JOIN scale_levels g ON g.scale_id=cw.scale_id AND g.axis='grade' AND g.value=cw.grade WHERE verified)"""
FLOOR = "fl AS (SELECT r.source_id, max(l.quality)=1 AS judged, count(DISTINCT c.intervention) FILTER (c.verified)>=2 AS enough FROM runs r JOIN labels l ON l.doc_id=r.source_id LEFT JOIN claims c ON c.source_id=r.source_id GROUP BY 1)"


@query("growth_metrics", with_(BASE + " sources runs", """SELECT 'statement_length_median' AS metric, round(median(length(statement)), 6) AS value FROM claims WHERE verified UNION ALL SELECT 'promoted_mass', round(coalesce(sum(weight) FILTER (promoted), 0), 6) FROM des
  UNION ALL SELECT 'promoted_share', round(count(*) FILTER (promoted)/count(*), 9) FROM des UNION ALL SELECT 'lowered_share', round(count(*) FILTER (NOT promoted AND NOT lowest)/count(*) FILTER (NOT lowest), 9) FROM des
  UNION ALL SELECT 'addressable_share', round(count(*) FILTER (regexp_matches(lower(trim(intervention)), '(^|[^\\w-])agent (1|2|3)($|[^\\w-])'))/count(*), 9) FROM claims WHERE trim(intervention)<>'' UNION ALL SELECT 'approved_below_floor', round(count(*) FILTER (judged)/count(*), 9) FROM fl WHERE NOT enough
  UNION ALL SELECT 'lesson_survival', round(count(*) FILTER (gone IS NULL)/count(*), 9) FROM lives WHERE alive UNION ALL SELECT 'lesson_days_median', round(median((epoch(gone)-epoch(ts))/86400), 6) FROM lives WHERE alive AND gone IS NOT NULL
  UNION ALL SELECT 'lessons_reinserted', count(*) FROM lives WHERE alive AND n>1""", ", ".join((CW, DESIGNED, FLOOR, LESSONS))))
def growth_metrics(ev: Evidence) -> DataFrame:
    """What tells growth from delusion: grades above and below what an index says of the design (below is impossible for the lowest), interventions
    that a taxonomy knows, approvals where too few articles are there, and how long lessons live until a person retires them, open lives included."""
    def one(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    share = lambda c, among: F.round(count_if(c & among) / count_if(among), 9)
    yes, rank = F.lit(True), ev.levels.filter("axis = 'grade'").select("scale_id", "value", "rank")
    lowest = rank.groupBy("scale_id").agg(F.min("rank").alias("floor"))
    d = W.claim_weight(ev).filter("verified").select("source_id", "grade", "weight", "scale_id").join(ev.sources.select("source_id", "design"), "source_id")
    d = d.join(rank.toDF("scale_id", "design", "dr"), ["scale_id", "design"]).join(rank.toDF("scale_id", "grade", "gr"), ["scale_id", "grade"]).join(lowest, "scale_id")
    up, low = F.col("gr") > F.col("dr"), F.col("dr") == F.col("floor")
    said = ev.claims.filter("trim(intervention) <> ''")
    known = F.lower(F.trim("intervention")).rlike(r"(?<![\w-])agent (1|2|3)(?![\w-])")
    floor = ev.claims.filter("verified").groupBy("source_id").agg(F.count_distinct("intervention").alias("articles"))
    judged = ev.read("labels").groupBy(F.col("doc_id").alias("source_id")).agg(F.max("quality").alias("quality"))
    rounds = ev.runs.select("source_id").join(judged, "source_id").join(floor, "source_id", "left").filter("coalesce(articles, 0) < 2")
    w = Window.partitionBy("lesson").orderBy("ts", "event_id")
    log = ev.read("events").filter("event_type in ('purchase', 'error')").select(F.col("user_id").alias("lesson"), "ts", "event_id", (F.col("event_type") == "purchase").alias("alive"))
    turns = log.withColumn("before", F.lag("alive", 1, False).over(w)).filter("alive <> before")
    lives = turns.withColumn("gone", F.lead("ts").over(w)).withColumn("n", F.row_number().over(w)).filter("alive")
    days = (F.col("gone").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    rows = [
        one("statement_length_median", ev.claims.filter("verified"), F.round(F.percentile(F.length("statement"), F.lit(0.5)), 6)),
        one("promoted_mass", d, F.round(F.coalesce(F.sum(F.when(up, F.col("weight"))), F.lit(0.0)), 6)), one("promoted_share", d, share(up, yes)), one("lowered_share", d, share(~up, ~low)),
        one("addressable_share", said, share(known, yes)), one("approved_below_floor", rounds, share(F.col("quality") == 1, yes)),
        one("lesson_survival", lives, share(F.col("gone").isNull(), yes)), one("lesson_days_median", lives.filter("gone is not null"), F.round(F.percentile(days, F.lit(0.5)), 6)), one("lessons_reinserted", lives, count_if(F.col("n") > 1)),
    ]
    return reduce(DataFrame.unionByName, rows)


@query("absence_statement", with_(BASE, """SELECT (SELECT count(*) FROM cw WHERE verified) AS weighted, (SELECT count(*) FROM claims c CROSS JOIN active_focus f WHERE verified AND NOT EXISTS (SELECT 1 FROM cw WHERE cw.claim_id=c.claim_id)) AS unweighted,
  (SELECT count(*) FROM cw WHERE direction IN ('negative','null')) AS contra""", CW))
def absence_statement(ev: Evidence) -> DataFrame:
    """What is said when nothing is found: how much there is, how much can't be seen, how much speaks against."""
    cw = W.claim_weight(ev).select("claim_id", "verified", "direction")
    seen = cw.agg(F.coalesce(count_if(F.col("verified")), F.lit(0)).alias("weighted"), F.coalesce(count_if(F.col("direction").isin("negative", "null")), F.lit(0)).alias("contra"))
    rest = ev.claims.filter("verified").join(cw.select("claim_id"), "claim_id", "left_anti").agg(F.count(F.lit(1)).alias("unweighted"))
    return seen.crossJoin(F.broadcast(rest)).select("weighted", "unweighted", "contra")  # one row each


@query("sources_waiting", with_("sources", "SELECT source_id, position FROM (SELECT source_id, row_number() OVER (ORDER BY approved, doi IS NULL, source_id) AS position FROM sources) WHERE position<=50"))
def sources_waiting(ev: Evidence) -> DataFrame:
    """The first fifty sources in the order of the list: waiting ones first, then those with an identity."""
    first = ev.sources.orderBy("approved", F.col("doi").isNull(), "source_id").limit(50).select("source_id", "approved", "doi")
    from pyspark.sql.window import Window

    return first.select("source_id", F.row_number().over(Window.orderBy("approved", F.col("doi").isNull(), "source_id")).cast("long").alias("position"))  # fifty rows


@query("source_decisions", with_("sources decisions", """SELECT source_id, CASE WHEN approve>coalesce(revoke, 0) AND evidence>coalesce(revoke, 0) THEN 'active' WHEN approve>coalesce(revoke, 0) THEN 'approved, no evidence' WHEN revoke IS NOT NULL THEN 'revoked' ELSE 'proposed' END AS state
  FROM (SELECT s.source_id, max(n) FILTER (decision='approve') AS approve, max(n) FILTER (decision='evidence') AS evidence, max(n) FILTER (decision='revoke') AS revoke FROM sources s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at_time, entry_id) AS n FROM decisions) d USING (source_id) GROUP BY 1)"""))
def source_decisions(ev: Evidence) -> DataFrame:
    """State of a source by its log: that it is approved and that it counts as evidence are two decisions, and revoking ends both."""
    when = F.struct("at", "entry_id")
    last = ev.decisions.groupBy("source_id").agg(*(F.max(F.when(F.col("decision") == d, when)).alias(d) for d in ("approve", "evidence", "revoke")))
    holds = lambda d: F.col(d).isNotNull() & (F.col("revoke").isNull() | (F.col(d) > F.col("revoke")))
    state = F.when(holds("approve") & holds("evidence"), "active").when(holds("approve"), "approved, no evidence").when(F.col("revoke").isNotNull(), "revoked").otherwise("proposed")
    return ev.sources.select("source_id").join(last, "source_id", "left").select("source_id", state.alias("state"))


#: A model's window, and what is kept of a page's body.
WINDOW_TOKENS, BODY_BYTES = 8192, 2_000_000


@query("page_budget", f"SELECT page_id, least(strlen(coalesce(html,'')), {BODY_BYTES})::BIGINT AS body_bytes, strlen(coalesce(html,''))>{BODY_BYTES} AS capped, greatest(2000, ({WINDOW_TOKENS}-256-256)*4-1500)::BIGINT AS budget, md5(left(coalesce(html,''), {(WINDOW_TOKENS - 512) * 4 - 1500})) AS digest FROM pages")
def page_budget(ev: Evidence) -> DataFrame:
    """What is read of each page's body: so many bytes at most, and of these the characters that a model's window has room for."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    room = G.read_chars(F.lit(WINDOW_TOKENS))
    return ev.read("pages").select("page_id", F.least(F.length(body), F.lit(BODY_BYTES)).cast("long").alias("body_bytes"), (F.length(body) > BODY_BYTES).alias("capped"), room.alias("budget"), F.md5(F.left(G.capped_text(body, BODY_BYTES), room.cast("int"))).alias("digest"))


@query("task_keys", with_("tasks", "SELECT kind, left(sha256(kind||':'||user_id),6) AS key, count(*) AS n FROM tasks GROUP BY 1, kind||':'||user_id, 2"))
def task_keys(ev: Evidence) -> DataFrame:
    return ev.tasks.groupBy("kind", F.concat_ws(":", "kind", F.col("user_id").cast("string")).alias("what")).agg(F.count(F.lit(1)).alias("n")).select("kind", G.short_key(F.col("what")).alias("key"), "n")


def _hash_sql(confidence: str) -> str:
    return f"""left(sha256('{{"claim_id":"'||claim_id||'","confidence":"'||({confidence})::INT||'","grade":'||coalesce('"'||grade||'"','null')||'}}'),16)"""


@query("judgment_drift", with_("claims", f"SELECT grade, count(*) AS judged, count(*) FILTER (old<>new) AS drifted FROM (SELECT grade, {_hash_sql('confidence*10')} AS old, {_hash_sql('CASE WHEN claim_id%37=0 THEN 1 ELSE confidence*10 END')} AS new FROM claims WHERE verified) GROUP BY 1"))
def judgment_drift(ev: Evidence) -> DataFrame:
    """Judgments whose hash isn't that of what is stored now."""
    def of(confidence: F.Column) -> F.Column:
        return G.judgment_hash({"claim_id": F.col("claim_id"), "grade": F.col("grade"), "confidence": F.round(confidence).cast("int")})

    c = ev.claims.filter("verified").withColumn("c", F.col("confidence") * 10)
    hashes = c.select("grade", of(F.col("c")).alias("old"), of(F.when(F.col("claim_id") % 37 == 0, 1.0).otherwise(F.col("c"))).alias("new"))
    return hashes.groupBy("grade").agg(F.count(F.lit(1)).alias("judged"), count_if(F.col("old") != F.col("new")).alias("drifted"))


@query("edge_backfill", with_("claims directness scale_levels", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN legacy NOT IN (SELECT value FROM scale_levels WHERE axis='directness') THEN 'out_of_vocabulary' WHEN EXISTS (SELECT 1 FROM directness d WHERE d.claim_id=o.claim_id AND d.focus_id=1) THEN 'there' ELSE 'inserted' END AS outcome
  FROM (SELECT claim_id, CASE WHEN claim_id%41=0 THEN 'unheard of' ELSE ['direct','partial','indirect','extrapolated'][1+claim_id%4] END AS legacy FROM claims) o) GROUP BY 1"""))
def edge_backfill(ev: Evidence) -> DataFrame:
    """Judgments from an old column: what the vocabulary has and isn't there yet is inserted, the rest is reported."""
    k = F.col("claim_id")
    old = ev.claims.select("claim_id", F.when(k % 41 == 0, "unheard of").otherwise(F.element_at(F.array(*[F.lit(v) for v, _ in L.DIRECTNESS]), (k % 4 + 1).cast("int"))).alias("legacy"))
    known = ev.levels.filter("axis = 'directness'").select(F.col("value").alias("legacy"), F.lit(True).alias("known")).distinct()
    there = ev.directness.filter("focus_id = 1").select("claim_id", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("known").isNull(), "out_of_vocabulary").when(F.col("there"), "there").otherwise("inserted")
    return old.join(known, "legacy", "left").join(there, "claim_id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("table_rebuild", "SELECT c_custkey, c_name, NULL::VARCHAR AS note, (SELECT count(*) FROM customer)=count(*) OVER () AS whole FROM customer")
def table_rebuild(ev: Evidence) -> DataFrame:
    """A table in its new form, and whether it has as many rows as before."""
    old = ev.read("customer")
    new = G.rebuilt(old, {"c_custkey": "bigint", "c_name": "string", "note": "string"})
    n = old.agg(F.count(F.lit(1)).alias("before")).crossJoin(new.agg(F.count(F.lit(1)).alias("after")))
    return new.crossJoin(F.broadcast(n)).select("c_custkey", "c_name", "note", (F.col("before") == F.col("after")).alias("whole"))  # one row


@query("level_seeding", with_("scale_levels", "SELECT value, coalesce(o.weight, s.weight) AS weight, s.rank FROM scale_levels s LEFT JOIN (SELECT value, weight/2 AS weight FROM scale_levels WHERE axis='grade' AND scale_id=1 AND rank<=4) o USING (value) WHERE axis='grade' AND scale_id=1"))
def level_seeding(ev: Evidence) -> DataFrame:
    """Seeding again leaves the weights that are there and renews the ranks."""
    seed = ev.levels.filter("axis = 'grade' and scale_id = 1").select("value", "weight", "rank")
    there = seed.filter("rank <= 4").select("value", (F.col("weight") / 2).alias("held"))
    return seed.join(there, "value", "left").select("value", F.coalesce("held", "weight").alias("weight"), "rank")


@query("reground_mark", with_("hypotheses active_focus", "SELECT hypothesis_id, CASE WHEN focus_id=(SELECT focus_id FROM active_focus) AND tier<>'rejected' AND coalesce(regrounded,-1)<1000 THEN 1000 ELSE regrounded END AS regrounded FROM hypotheses"))
def reground_mark(ev: Evidence) -> DataFrame:
    """Hypotheses of the active focus that were gone over again carry the mark of the literature that was read."""
    h = ev.hypotheses.join(ev.active_focus.select(F.col("focus_id").alias("now")), F.lit(True), "left")
    again = (F.col("focus_id") == F.col("now")) & (F.col("tier") != "rejected") & (F.coalesce("regrounded", F.lit(-1)) < 1000)
    return h.select("hypothesis_id", F.when(again, 1000).otherwise(F.col("regrounded")).alias("regrounded"))


# Sections of abstracts that hold no evidence.
SKIPPED_SECTIONS = (
    "funding", "declaration of interest", "declarations of interest", "conflict of interest", "conflicts of interest", "competing interests",
    "acknowledgement", "acknowledgements", "acknowledgments", "copyright", "disclosure", "disclosures",
)
SECTIONS = ["Funding", "results", "Competing interests", "limitations"]


@query("chunk_sections", with_("chunks", f"SELECT section, count(*) AS n FROM (SELECT *, ['Funding','results','Competing interests','limitations'][1+chunk_id%4] AS section FROM chunks) WHERE length(trim(text))>={L.MIN_CHARS} AND lower(section) NOT IN ({', '.join(repr(s) for s in SKIPPED_SECTIONS)}) GROUP BY 1"))
def chunk_sections(ev: Evidence) -> DataFrame:
    """Chunks that are stored: sections without evidence and very short pieces aren't."""
    c = ev.chunks.withColumn("section", F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("chunk_id") % 4 + 1).cast("int")))
    kept = c.filter((F.length(F.trim("text")) >= L.MIN_CHARS) & ~F.lower("section").isin(*SKIPPED_SECTIONS))
    return kept.groupBy("section").agg(F.count(F.lit(1)).alias("n"))

