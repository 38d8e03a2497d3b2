"""Queries on prompts, answers, batches, pacing, registries and rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import levels as L
from tessera.functions.semantics import count_if
from tessera.operators import deliver as D
from tessera.plans.registry import query
from tessera.plans.weighing import BASE, TOP, _capped
from tessera.sources.evidence import Evidence, with_


@query("rendered_prompts", with_("questions", "SELECT question_id, md5('Question '||question_id||' ('||kind||', about '||coalesce(target,'')||')'||chr(10)||'Answer in one line.') AS digest FROM questions"))
def rendered_prompts(ev: Evidence) -> DataFrame:
    text = D.render("Question $number ($kind, about $target)\nAnswer in one line.", {"number": F.col("question_id"), "kind": F.col("kind"), "target": F.col("target")})
    return ev.questions.select("question_id", F.md5(text).alias("digest"))


@query("model_answers", """SELECT coalesce(refused, 'taken') AS outcome, count(*) AS n, CAST(sum(CASE WHEN refused IS NULL THEN k END) AS BIGINT) AS total FROM (SELECT *, CASE WHEN event_id%10=0 THEN 'truncated' WHEN event_id%10=1 THEN 'malformed'
  WHEN event_type NOT IN ('view','click','purchase') THEN 'kind' WHEN k>80 THEN 'range' END AS refused FROM (SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events)) GROUP BY 1""")
def model_answers(ev: Evidence) -> DataFrame:
    """Answers in a fixed form: cut-off and broken ones and those that break a rule are put aside with the reason."""
    k = F.col("event_id") % 10
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("n")))
    said = F.when(k == 0, F.left(body, F.lit(12))).when(k == 1, F.concat(F.lit("{oops "), body)).otherwise(body)
    a = D.parsed_answers(ev.read("events").select("event_id", said.alias("said")), "said", "kind string, n bigint", {"kind": F.col("answer.kind").isin("view", "click", "purchase"), "range": F.col("answer.n") <= 80})
    return a.groupBy(F.coalesce("refused", F.lit("taken")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("answer.n").alias("total"))


@query("repaired_answers", """WITH t AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id)-1 AS n, event_type='error' AS cut, event_type='signup' AS none, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
  g AS (SELECT user_id, day, min(n) FILTER (NOT cut AND NOT none AND k<=50) AS good, min(n) FILTER (none) AS none, max(n) AS last, max_by(CASE WHEN none OR cut THEN 'truncated' ELSE 'range' END, n) AS why FROM t WHERE n<=2 GROUP BY 1, 2),
  o AS (SELECT *, CASE WHEN none<coalesce(good, 3) THEN 'truncated' WHEN good IS NOT NULL THEN 'valid' WHEN last>=2 THEN 'invalid' ELSE 'open' END AS outcome FROM g)
  SELECT outcome, 1+CASE WHEN outcome='truncated' THEN none ELSE coalesce(good, last) END AS attempts, CASE outcome WHEN 'valid' THEN NULL WHEN 'truncated' THEN 'truncated' ELSE why END AS refused, count(*) AS requests FROM o GROUP BY 1, 2, 3""")
def repaired_answers(ev: Evidence) -> DataFrame:
    """Requests by outcome and by the tries that they took: a user's answers of a day are tries at one request, some cut off, some blank."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")) - 1
    said = F.when(F.col("event_type") == "signup", " ").when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    tries = ev.read("events").select(F.struct("user_id", F.to_date("ts").alias("day")).alias("request"), nth.alias("attempt"), said.alias("body"))
    out = D.repaired_answers(tries, "request", "attempt", "body", "k bigint", {"range": F.col("answer.k") <= 50})
    return out.groupBy("outcome", F.col("attempts").cast("long").alias("attempts"), "refused").agg(F.count(F.lit(1)).alias("requests"))


@query("paced_requests", """SELECT user_id, count(*) AS n, round(max(starts-t), 3) AS longest_wait FROM (SELECT *, max(t-place*600.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)+place*600.0::DOUBLE AS starts
  FROM (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place FROM (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS t FROM events))) GROUP BY 1""")
def paced_requests(ev: Evidence) -> DataFrame:
    """How long requests to each host wait at one in ten minutes."""
    e = ev.read("events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("at"))
    p = D.paced(e, "user_id", "at", "event_id", 1 / 600)
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("starts") - F.col("at")), 3).alias("longest_wait"))


@query("embedding_batches", "SELECT item_id, (row_number() OVER (PARTITION BY item_id//1000 ORDER BY item_id)-1)//16 AS batch, array_to_string(list_transform(range(0,16), lambda i: len(list_filter(list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w<>''), lambda w: ('0x'||left(md5(w),7))::BIGINT%16), lambda p: p=i))), ',') AS vector FROM benchmark")
def embedding_batches(ev: Evidence) -> DataFrame:
    """Texts in batches of sixteen, each thousand numbers a caller, with a vector of hashed words in place of a model's."""
    k = F.col("item_id")
    w = Window.partitionBy(F.floor(k / 1000)).orderBy("item_id")
    v = F.array_join(F.transform(D.word_vector(F.col("text"), 16), lambda x: x.cast("string")), ",")
    return ev.read("benchmark").select("item_id", F.floor((F.row_number().over(w) - 1) / 16).alias("batch"), v.alias("vector"))


@query("usage_flushes", with_("calls", "SELECT label, flush, count(*) AS n, min(call_id) AS first_call FROM (SELECT label, call_id, call_id//1000 AS part, (row_number() OVER (PARTITION BY label, call_id//1000 ORDER BY call_id)-1)//20 AS flush FROM calls) GROUP BY label, part, flush"))
def usage_flushes(ev: Evidence) -> DataFrame:
    """Calls as a writer that flushes every twenty of them would store them, each thousand call numbers a writer."""
    part = F.floor(F.col("call_id") / 1000)
    w = Window.partitionBy("label", "part").orderBy("call_id")
    c = ev.calls.select("label", "call_id", part.alias("part")).withColumn("flush", F.floor((F.row_number().over(w) - 1) / 20))
    return c.groupBy("label", "part", "flush").agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("first_call")).drop("part")


@query("live_sources", with_("sources", "SELECT name, kind FROM (VALUES ('articles','xml',NULL),('trials','json',NULL),('web','hits','web_key'),('old','gopher',NULL),('paid','json','paid_key')) s(name, kind, credential) WHERE kind IN ('xml','json','hits') AND (credential IS NULL OR credential IN ('web_key')) AND (SELECT count(*) FROM sources WHERE approved)>0"))
def live_sources(ev: Evidence) -> DataFrame:
    """Sources that can be asked: of a kind that has a reader, and with their credential at hand; the others are left out."""
    declared = ev.spark.createDataFrame([("articles", "xml", None), ("trials", "json", None), ("web", "hits", "web_key"), ("old", "gopher", None), ("paid", "json", "paid_key")], "name string, kind string, credential string")
    readers = ev.spark.createDataFrame([("xml",), ("json",), ("hits",)], "kind string")
    held = ev.spark.createDataFrame([("web_key",)], "credential string").withColumn("there", F.lit(True))
    live = declared.join(readers, "kind", "left_semi").join(held, "credential", "left").filter("credential is null or there")
    any_ = ev.sources.filter("approved").select(F.lit(1).alias("one")).limit(1)
    return live.join(any_, F.lit(True), "left_semi").select("name", "kind")


@query("next_question", with_("questions active_focus", "SELECT question_id FROM questions JOIN active_focus USING (focus_id) WHERE status='open' AND kind IN ('factual','synthesis') AND NOT stuck ORDER BY priority DESC, question_id LIMIT 1"))
def next_question(ev: Evidence) -> DataFrame:
    q = ev.questions.join(ev.active_focus, "focus_id").filter("status = 'open' and kind in ('factual', 'synthesis') and not stuck")
    return q.orderBy(F.desc("priority"), "question_id").limit(1).select("question_id")


@query("knowledge_text", with_(BASE, f"SELECT row_number() OVER (ORDER BY round(total,6) DESC, key) AS line, rpad(key,16,' ')||lpad(n::VARCHAR,6,' ')||lpad(CAST(round(total,2) AS DECIMAL(18,2))::VARCHAR,12,' ') AS text FROM top UNION ALL SELECT {L.COVERAGE_CAP + 1}, '('||(max(all_n)-{L.COVERAGE_CAP})||' more not shown)' FROM top HAVING max(all_n)>{L.COVERAGE_CAP}", TOP))
def knowledge_text(ev: Evidence) -> DataFrame:
    """The capped coverage as lines of fixed width, with a note of what isn't shown."""
    c = _capped(ev)  # forty rows
    total = F.round("total", 2).cast("decimal(18,2)").cast("string")
    text = F.concat(F.rpad("key", 16, " "), F.lpad(F.col("n").cast("string"), 6, " "), F.lpad(total, 12, " "))
    lines = c.select(F.row_number().over(Window.orderBy(F.desc(F.round("total", 6)), "key")).cast("long").alias("line"), text.alias("text"))
    more = c.agg(F.max("all_n").alias("n")).filter(F.col("n") > L.COVERAGE_CAP)
    return lines.unionByName(more.select(F.lit(L.COVERAGE_CAP + 1).cast("long").alias("line"), F.concat(F.lit("("), (F.col("n") - L.COVERAGE_CAP).cast("string"), F.lit(" more not shown)")).alias("text")))


@query("notices", with_("tasks", "SELECT kind, kind||': '||fresh||' new, '||dead||' dead' AS text FROM (SELECT kind, count(*) FILTER (status='done' AND finished_at>'2024-01-20') AS fresh, count(*) FILTER (status='dead' AND finished_at>'2024-01-20') AS dead FROM tasks GROUP BY 1) WHERE fresh+dead>0"))
def notices(ev: Evidence) -> DataFrame:
    """One message for each kind of work with something new; a caller sends them."""
    new = F.col("finished_at") > F.lit("2024-01-20").cast("timestamp")
    g = ev.tasks.groupBy("kind").agg(count_if(new & (F.col("status") == "done")).alias("fresh"), count_if(new & (F.col("status") == "dead")).alias("dead")).filter("fresh + dead > 0")
    return g.select("kind", D.render("$kind: $fresh new, $dead dead", {"kind": F.col("kind"), "fresh": F.col("fresh"), "dead": F.col("dead")}).alias("text"))
