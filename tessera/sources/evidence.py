"""The evidence tables, derived from the star schema and the document tables.

The SQL form below is written separately from the DataFrame form, so that
comparing queries over both also checks this adapter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import levels

ACTIVE_FOCUS = 1
QUESTION_KINDS = ["factual", "synthesis", "context", "preference", "methodological", "factual"]
MEMORY_KINDS = ["constraint", "preference", "fact", "pattern", "dead_end", "search_lesson", "source_lesson"]
#: Characters of a chunk, and the room for the numbers of a source's chunks.
CHUNK, CHUNKS = 1200, 1_000_000


def choose(values: list[str | None], index) -> F.Column:
    """values[index] as an expression."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


@dataclass
class Evidence:
    spark: SparkSession
    sf_dir: str
    active: str = str(ACTIVE_FOCUS)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def levels(self) -> DataFrame:
        return F.broadcast(levels.scale_levels(self.spark))

    @cached_property
    def focuses(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "primary", 1, False), (2, "secondary", 2, False), (3, "retired", 1, True)], "focus_id int, slug string, scale_id int, retired boolean")

    @cached_property
    def active_focus(self) -> DataFrame:
        """The focus that the settings name, or none: a bad number or a retired focus gives no row."""
        return F.broadcast(self.focuses.filter((F.col("focus_id") == F.lit(self.active).try_cast("int")) & ~F.col("retired")).select("focus_id", F.col("scale_id").alias("focus_scale")))

    @cached_property
    def sources(self) -> DataFrame:
        d = self.read("documents")
        k = F.col("doc_id")
        designs = [g for g, _ in levels.GRADES] + [None, None]
        return d.select(
            k.alias("source_id"), F.lit("doc").alias("kind"), k.cast("string").alias("external_id"), F.substring("text", 1, 60).alias("title"),
            F.when(k % 3 != 0, F.concat(F.lit(" 10.1/A"), (k % 700).cast("string"))).alias("doi"), choose(designs, k % 11).alias("design"),
            (F.lit(1990) + k % 30).cast("int").alias("year"), (k % 10 != 9).alias("approved"), F.col("source").alias("registry"), F.col("lang"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        o, k = self.read("orders"), F.col("o_orderkey")
        n = self.read("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        agent = F.concat(F.lit("Agent "), (F.col("o_custkey") % 40).cast("string"))
        intervention = F.when(k % 23 == 0, None).when(k % 29 == 0, F.lit("  ")).when(k % 2 == 0, F.upper(agent)).otherwise(F.concat(agent, F.lit(" ")))
        status = F.col("o_orderstatus")
        direction = F.when(k % 10 == 3, "null").when(status == "F", "positive").when(status == "O", "negative").otherwise("mixed")
        return o.crossJoin(F.broadcast(n)).select(
            k.alias("claim_id"), (k % F.col("n_docs")).alias("source_id"), intervention.alias("intervention"), direction.alias("direction"),
            choose([g for g, _ in levels.GRADES], k % 9).alias("grade"), ((k % 10 + 1) / F.lit(10.0)).alias("confidence"), ((k % 7 != 0) & (k % F.col("n_docs") % 50 != 7)).alias("verified"),
            (F.lit(1) + (k % 13 == 0).cast("int")).alias("scale_id"), F.col("o_orderdate").alias("extracted_at"),
            F.concat(F.lit("Claim "), k.cast("string")).alias("statement"),
            F.when(k % 19 == 0, "[]").otherwise(F.concat(F.lit("["), ((k % F.col("n_docs")) * CHUNKS + k % 3).cast("string"), F.lit(", "), ((k % F.col("n_docs")) * CHUNKS + k % 7).cast("string"), F.lit("]"))).alias("chunk_ids"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Pieces of the documents: chunk_id, source_id, ord (from 0), text."""
        d = self.read("documents").filter("text <> ''")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")), lambda i: F.substring("text", i * CHUNK + 1, F.lit(CHUNK)))
        return d.select(F.col("doc_id").alias("source_id"), F.posexplode(pieces).alias("ord", "text")).select((F.col("source_id") * CHUNKS + F.col("ord")).alias("chunk_id"), "source_id", "ord", "text")

    @cached_property
    def claim_chunks(self) -> DataFrame:
        """One row for a claim and each chunk that it names, once."""
        ids = F.array_distinct(F.from_json("chunk_ids", "array<bigint>"))
        return self.claims.select("claim_id", "source_id", F.explode(ids).alias("chunk_id"))

    @cached_property
    def directness(self) -> DataFrame:
        """One judgment for a claim and a focus."""
        o, k = self.read("orders"), F.col("o_orderkey")
        value = choose([v for v, _ in levels.DIRECTNESS], k % 4)
        one = o.filter(k % 5 != 0).select(k.alias("claim_id"), F.lit(1).alias("focus_id"), value.alias("directness"), (k % 17 == 0).alias("out_of_scope"))
        two = o.filter(k % 3 == 0).select(k.alias("claim_id"), F.lit(2).alias("focus_id"), value.alias("directness"), F.lit(False).alias("out_of_scope"))
        return one.unionByName(two)

    @cached_property
    def hypotheses(self) -> DataFrame:
        p, k = self.read("part"), F.col("p_partkey")
        return p.select(
            k.alias("hypothesis_id"), (F.lit(1) + (k % 4 == 0).cast("int")).alias("focus_id"), F.col("p_name").alias("statement"), choose(["speculative", "supported", "rejected"], k % 3).alias("tier"),
            F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 2 == 0).alias("survives"), ((F.col("p_size") % 10) / F.lit(10.0)).alias("novelty"), F.when(k % 6 != 0, (k * 7 % 50)).alias("regrounded"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        """Steps of the hypotheses' chains of reasoning: hypothesis_id, step (from 1), supported, evidence."""
        k, i = F.col("hypothesis_id"), F.col("step")
        n = self.read("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        steps = self.hypotheses.filter(k % 5 != 0).select("hypothesis_id", F.explode(F.sequence(F.lit(1), (F.lit(1) + k % 4).cast("int"))).alias("step"))
        ref = (k * 31 + i * 7) % (2 * F.col("n_docs"))
        kind = (k + i) % 5
        evidence = F.when(kind == 0, None).when(kind == 1, F.concat(F.lit("PMID: "), ref.cast("string"))).when(kind == 2, F.lit("")).otherwise(ref.cast("string"))
        return steps.crossJoin(F.broadcast(n)).select("hypothesis_id", "step", ((k + i) % 3 != 0).alias("supported"), evidence.alias("evidence"))

    @cached_property
    def pursuits(self) -> DataFrame:
        """When searches for a hypothesis were made, and when its chain was last grounded anew; none for those never pursued."""
        li = self.read("lineitem").filter("l_linenumber = 7 and l_returnflag = 'A'")
        return li.groupBy(F.col("l_partkey").alias("hypothesis_id")).agg(F.min("l_shipdate").alias("pursued_at"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("regrounded_at"))

    @cached_property
    def chain_texts(self) -> DataFrame:
        """Chains of reasoning as JSON."""
        step = F.struct("step", F.concat(F.lit("step "), F.col("step").cast("string")).alias("claim"), "supported", "evidence")
        # a chain has a few steps
        c = self.chain.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
        return c.select("hypothesis_id", F.to_json(F.transform("s", lambda x: F.struct(x["claim"].alias("claim"), x["supported"].alias("supported"), x["evidence"].alias("evidence"))), {"ignoreNullFields": "false"}).alias("chain_json"))

    @cached_property
    def answers(self) -> DataFrame:
        """What a model says about the steps of a chain, as JSON; answers of some hypotheses are cut off."""
        li = self.read("lineitem").filter("l_linenumber < 7").join(self.claims.select(F.col("claim_id").alias("l_orderkey"), "source_id"), "l_orderkey")
        name = F.concat(F.when(F.col("l_linestatus") == "O", "PMID:").otherwise(" PMID: "), F.col("source_id").cast("string"))
        link = F.struct("l_orderkey", "l_linenumber", F.struct((F.col("l_linenumber") - 1).alias("index"), (F.col("l_returnflag") != "N").alias("now_supported"), name.alias("evidence")).alias("link"))
        # an answer has some tens of links
        a = li.groupBy(F.col("l_partkey").alias("hypothesis_id")).agg(F.array_sort(F.collect_list(link)).alias("a")).select("hypothesis_id", F.to_json(F.transform("a", lambda x: x["link"])).alias("whole"))
        cut = self.read("part").select(F.col("p_partkey").alias("hypothesis_id"), (F.col("p_size") % 7 == 0).alias("cut"))
        return a.join(cut, "hypothesis_id").select("hypothesis_id", F.when(F.col("cut"), F.expr("left(whole, length(whole) - 2)")).otherwise(F.col("whole")).alias("answer_json"))

    @cached_property
    def registries(self) -> DataFrame:
        """Registries of sources: approved (few of their texts are toxic), and whether they yield evidence (readers call most of their texts good); without labels neither."""
        told = self.read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        per = self.read("documents").select("doc_id", F.col("source").alias("registry")).join(told, "doc_id", "left").groupBy("registry").agg(F.avg("quality").alias("good"), F.avg("toxic").alias("toxic"))
        return per.select("registry", F.coalesce(F.col("toxic") <= 0.12, F.lit(False)).alias("approved"), F.coalesce(F.col("good") >= 0.75, F.lit(False)).alias("yields_evidence"))

    @cached_property
    def verdicts(self) -> DataFrame:
        """What a judge says of the evidence for a question: enough, on its target, in agreement, sources, articles, what blocks it, and whether nothing is new; none for many questions."""
        li = self.read("lineitem").filter("l_linenumber = 1")
        return li.groupBy(F.col("l_partkey").alias("question_id")).agg(
            F.max(F.col("l_returnflag") == "A").alias("enough"), F.max(F.col("l_linestatus") == "F").alias("on_target"), (F.min("l_quantity") >= 5).alias("agree"), F.count_distinct(F.col("l_suppkey") % 3).alias("sources"),
            F.count_distinct("l_suppkey").alias("articles"), F.when(F.max("l_tax") >= 0.08, "needs a person").alias("blocked"), (F.max("l_discount") <= 0.06).alias("unchanged"),
        )

    @cached_property
    def entailments(self) -> DataFrame:
        """What a judge says of a pattern and what it cites: it follows, claims more, is contradicted, or only says the same; null answers are missing."""
        li = self.read("lineitem").filter("l_linenumber = 2")
        return li.groupBy(F.col("l_partkey").alias("hypothesis_id")).agg(
            F.max(F.col("l_returnflag") == "A").alias("follows"), (F.max("l_quantity") >= 49).alias("exceeds"), F.when(F.max("l_tax") >= 0.03, F.min(F.col("l_returnflag") == "R")).alias("contradicts"), (F.min("l_discount") == 0).alias("restates"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Decisions on sources in order: source_id, decision (propose, approve, evidence, revoke), at, entry_id."""
        verb = F.create_map(*[F.lit(x) for x in ("signup", "propose", "click", "approve", "purchase", "evidence", "error", "revoke")])[F.col("event_type")]
        return self.read("events").select(F.col("user_id").alias("source_id"), verb.alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id")).filter("decision is not null")

    @cached_property
    def links(self) -> DataFrame:
        """One link for a claim and a hypothesis, from the first line that has it."""
        return self.links_of(self.read("lineitem"))

    @staticmethod
    def links_of(li: DataFrame) -> DataFrame:
        first = F.min(F.struct("l_linenumber", "l_returnflag", "l_discount"))
        one = li.groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("hypothesis_id")).agg(first.alias("x"))
        polarity = F.when(F.col("x.l_returnflag") == "R", "contradicts").otherwise("supports")
        return one.select("claim_id", "hypothesis_id", polarity.alias("polarity"), (1 - F.col("x.l_discount")).alias("modulator"))

    @cached_property
    def calls(self) -> DataFrame:
        e = self.read("events")
        k = F.get_json_object("props", "$.k").cast("long")
        ok = F.col("event_type") != "error"
        return e.select(
            F.col("event_id").alias("call_id"), F.col("event_type").alias("label"), F.col("ts").alias("created_at"), ok.alias("ok"), (k % 3).alias("repairs"),
            F.when(k % 11 != 0, k * 10 + 5).alias("prompt_tokens"), F.when(ok, k % 40).alias("completion_tokens"), F.when(k % 13 != 0, F.col("value")).alias("elapsed"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        """Snapshot of the work queue."""
        e = self.read("events")
        k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
        status = choose(["pending", "pending", "running", "done", "done", "failed", "dead"], i % 7)
        return e.select(
            i.alias("task_id"), F.col("event_type").alias("kind"), status.alias("status"), (k / F.lit(100.0)).alias("priority"), (i % 4).cast("int").alias("attempts"),
            F.when(F.col("user_id") % 2 == 0, "auto").otherwise("on_demand").alias("origin"), F.col("user_id"), F.col("ts").alias("scheduled_at"),
            F.when(status.isin("done", "dead"), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        v, k = self.read("embeddings"), F.col("vec_id")
        return v.select(
            k.alias("question_id"), (F.lit(1) + (k % 6 == 0).cast("int")).alias("focus_id"), choose(QUESTION_KINDS, k % 6).alias("kind"),
            choose(["open", "open", "answered", "escalated", "parked"], k % 5).alias("status"), ((k * 37 % 100) / F.lit(100.0)).alias("priority"), (k % 5).cast("int").alias("rounds"),
            F.when(k % 9 != 0, F.concat(F.lit(" Target "), F.col("label").cast("string"))).alias("target"), F.col("embedding"), (k % 8 == 7).alias("stuck"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.read("conversations").select("conv_id", "turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def runs(self) -> DataFrame:
        """Extraction runs, one for a labelled document; null counters are unknown."""
        x, k = self.read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), F.col("doc_id")
        proposed = 3 + k % 5
        anchored = F.greatest(F.lit(0), proposed - 1 - F.col("toxic"))
        return x.select(
            k.alias("run_id"), k.alias("source_id"), proposed.alias("proposed"), anchored.alias("anchored"), (anchored * F.col("quality")).alias("verified"),
            F.when(k % 4 != 0, k % 3).alias("annihilated"), F.when(k % 4 != 0, k % 2).alias("sterile"), F.when(k % 10 == 0, "log").otherwise("run").alias("origin"),
        )

    @cached_property
    def memories(self) -> DataFrame:
        """What is remembered: from people (chat, answer, manual), from research, and from the web (recon)."""
        k = F.col("c_custkey")
        kind = F.when((k % 5 == 4) & (k % 97 != 0), "fact").otherwise(choose(MEMORY_KINDS, k % 7))
        text = F.when(k % 3 == 0, F.concat(F.lit("Lesson "), (k % 60).cast("string"))).when(k % 3 == 1, F.concat(F.lit(" LESSON  "), (k % 60).cast("string"))).otherwise(F.concat(F.lit("lesson "), (k % 60).cast("string"), F.lit(" ")))
        return self.read("customer").select(
            k.alias("memory_id"), text.alias("text"), kind.alias("kind"), choose(["chat", "answer", "manual", "research", "recon"], k % 5).alias("source"), (k % 4 != 0).alias("confirmed"), (k % 3 != 0).alias("active"),
            (k % 6 == 3).alias("retired"), F.when(k % 5 == 4, (1 + k % 2).cast("int")).alias("focus_id"), F.concat(F.lit("["), (k % 100).cast("string"), F.lit(","), (k * 7 % 100).cast("string"), F.lit("]")).alias("claim_ids"),
            F.when(k % 11 != 0, F.concat(F.lit("lesson "), (k % 60).cast("string"))).alias("text_key"),
        )

    @cached_property
    def proposals(self) -> DataFrame:
        """What a round of research proposes to remember."""
        k = F.col("item_id")
        return self.read("benchmark").select(
            k.alias("proposal_id"), F.concat(F.lit("LESSON "), (k % 90).cast("string")).alias("text"), choose(["pattern", "dead_end", "bogus", None], k % 4).alias("kind"),
            F.concat(F.lit("["), (k % 50).cast("string"), F.lit(","), (k * 3 % 50).cast("string"), F.lit("]")).alias("claim_ids"), (1 + k % 2).cast("int").alias("focus_id"),
        )

    @cached_property
    def discoveries(self) -> DataFrame:
        """What was found on the web and waits for a decision."""
        k = F.col("page_id")
        kind = choose(["source", "lead", "observation"], k % 3)
        lead_kind = F.when((k % 3 == 1) & (k % 29 != 0), choose(["pubmed", "doi"], k % 2))
        lead_id = F.when(k % 31 == 0, F.concat(F.lit("bad id "), k.cast("string"))).when(k % 2 == 0, (k * 7919).cast("string")).otherwise(F.concat(F.lit("10.1234/x."), k.cast("string")))
        return self.read("pages").select(
            k.alias("discovery_id"), kind.alias("kind"), choose(["pending", "approved", "rejected", "pending"], k % 4).alias("status"), (1 + k % 2).cast("int").alias("focus_id"),
            lead_kind.alias("lead_kind"), F.when(lead_kind.isNotNull(), lead_id).alias("lead_external_id"), "url", (k % 40).cast("int").alias("days"),
        )


def _choose_sql(values: list[str | None], index: str) -> str:
    return "[" + ",".join("NULL" if v is None else f"'{v}'" for v in values) + f"][1 + ({index})]"


def ctes(active: str = str(ACTIVE_FOCUS)) -> dict[str, str]:
    """The same tables for the SQL engine, one CTE each; a CTE may use those before it."""
    g, d = [v for v, _ in levels.GRADES], [v for v, _ in levels.DIRECTNESS]
    return {
        "scale_levels": levels.levels_sql(),
        "focuses": "focuses(focus_id, slug, scale_id, retired) AS (VALUES (1,'primary',1,FALSE),(2,'secondary',2,FALSE),(3,'retired',1,TRUE))",
        "active_focus": f"active_focus AS (SELECT focus_id, scale_id AS focus_scale FROM focuses WHERE focus_id = TRY_CAST('{active}' AS INT) AND NOT retired)",
        "n": "n AS (SELECT count(*) AS n_docs FROM documents)",
        "sources": f"""sources AS (SELECT doc_id AS source_id, 'doc' AS kind, doc_id::VARCHAR AS external_id, substr(text,1,60) AS title,
            CASE WHEN doc_id%3<>0 THEN ' 10.1/A'||(doc_id%700) END AS doi, {_choose_sql([*g, None, None], 'doc_id%11')} AS design, (1990+doc_id%30)::INT AS year,
            doc_id%10<>9 AS approved, source AS registry, lang FROM documents)""",
        "claims": f"""claims AS (SELECT o_orderkey AS claim_id, o_orderkey % n_docs AS source_id,
            CASE WHEN o_orderkey%23=0 THEN NULL WHEN o_orderkey%29=0 THEN '  ' WHEN o_orderkey%2=0 THEN 'AGENT '||(o_custkey%40) ELSE 'Agent '||(o_custkey%40)||' ' END AS intervention,
            CASE WHEN o_orderkey%10=3 THEN 'null' WHEN o_orderstatus='F' THEN 'positive' WHEN o_orderstatus='O' THEN 'negative' ELSE 'mixed' END AS direction,
            {_choose_sql(g, 'o_orderkey%9')} AS grade, (o_orderkey%10+1)/10.0::DOUBLE AS confidence, o_orderkey%7<>0 AND o_orderkey%n_docs%50<>7 AS verified, 1+(o_orderkey%13=0)::INT AS scale_id,
            o_orderdate AS extracted_at, 'Claim '||o_orderkey AS statement,
            CASE WHEN o_orderkey%19=0 THEN '[]' ELSE '['||(o_orderkey%n_docs*{CHUNKS}+o_orderkey%3)||', '||(o_orderkey%n_docs*{CHUNKS}+o_orderkey%7)||']' END AS chunk_ids FROM orders, n)""",
        "chunks": f"""chunks AS (SELECT doc_id*{CHUNKS}+i AS chunk_id, doc_id AS source_id, i AS ord, substr(text, i*{CHUNK}+1, {CHUNK}) AS text
            FROM (SELECT doc_id, text, unnest(range(0, (length(text)-1)//{CHUNK}+1)) AS i FROM documents WHERE text<>''))""",
        "claim_chunks": "claim_chunks AS (SELECT DISTINCT claim_id, source_id, unnest(from_json(chunk_ids, '[\"BIGINT\"]')) AS chunk_id FROM claims)",
        "directness": f"""directness AS (SELECT o_orderkey AS claim_id, 1 AS focus_id, {_choose_sql(d, 'o_orderkey%4')} AS directness, o_orderkey%17=0 AS out_of_scope FROM orders WHERE o_orderkey%5<>0
            UNION ALL SELECT o_orderkey, 2, {_choose_sql(d, 'o_orderkey%4')}, FALSE FROM orders WHERE o_orderkey%3=0)""",
        "hypotheses": f"""hypotheses AS (SELECT p_partkey AS hypothesis_id, 1+(p_partkey%4=0)::INT AS focus_id, p_name AS statement, {_choose_sql(['speculative', 'supported', 'rejected'], 'p_partkey%3')} AS tier,
            CASE WHEN p_size%5<>0 THEN p_size%2=0 END AS survives, (p_size%10)/10.0::DOUBLE AS novelty, CASE WHEN p_partkey%6<>0 THEN p_partkey*7%50 END AS regrounded FROM part)""",
        "chain": """chain AS (SELECT hypothesis_id, step, (hypothesis_id+step)%3<>0 AS supported,
            CASE (hypothesis_id+step)%5 WHEN 0 THEN NULL WHEN 1 THEN 'PMID: '||((hypothesis_id*31+step*7)%(2*n_docs)) WHEN 2 THEN '' ELSE ((hypothesis_id*31+step*7)%(2*n_docs))::VARCHAR END AS evidence
            FROM (SELECT hypothesis_id, unnest(range(1, 2+hypothesis_id%4)) AS step FROM hypotheses WHERE hypothesis_id%5<>0), n)""",
        "verdicts": """verdicts AS (SELECT l_partkey AS question_id, bool_or(l_returnflag='A') AS enough, bool_or(l_linestatus='F') AS on_target, min(l_quantity)>=5 AS agree, count(DISTINCT l_suppkey%3) AS sources, count(DISTINCT l_suppkey) AS articles,
            CASE WHEN max(l_tax)>=0.08 THEN 'needs a person' END AS blocked, max(l_discount)<=0.06 AS unchanged FROM lineitem WHERE l_linenumber=1 GROUP BY 1)""",
        "entailments": """entailments AS (SELECT l_partkey AS hypothesis_id, bool_or(l_returnflag='A') AS follows, max(l_quantity)>=49 AS exceeds, CASE WHEN max(l_tax)>=0.03 THEN bool_and(l_returnflag='R') END AS contradicts, min(l_discount)=0 AS restates
            FROM lineitem WHERE l_linenumber=2 GROUP BY 1)""",
        "decisions": """decisions AS (SELECT user_id AS source_id, CASE event_type WHEN 'signup' THEN 'propose' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'evidence' WHEN 'error' THEN 'revoke' END AS decision, ts AS at_time, event_id AS entry_id
            FROM events WHERE event_type IN ('signup','click','purchase','error'))""",
        "pursuits": "pursuits AS (SELECT l_partkey AS hypothesis_id, min(l_shipdate) AS pursued_at, max(l_shipdate) FILTER (l_linestatus='F') AS regrounded_at FROM lineitem WHERE l_linenumber=7 AND l_returnflag='A' GROUP BY 1)",
        "registries": """registries AS (SELECT d.source AS registry, coalesce(avg(toxic)<=0.12, FALSE) AS approved, coalesce(avg(quality)>=0.75, FALSE) AS yields_evidence
            FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1)""",
        "links": """links AS (SELECT l_orderkey AS claim_id, l_partkey AS hypothesis_id, CASE WHEN l_returnflag='R' THEN 'contradicts' ELSE 'supports' END AS polarity, 1-l_discount AS modulator
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_returnflag, l_discount) AS rn FROM lineitem) WHERE rn=1)""",
        "calls": """calls AS (SELECT event_id AS call_id, event_type AS label, ts AS created_at, event_type<>'error' AS ok, k%3 AS repairs, CASE WHEN k%11<>0 THEN k*10+5 END AS prompt_tokens,
            CASE WHEN event_type<>'error' THEN k%40 END AS completion_tokens, CASE WHEN k%13<>0 THEN value END AS elapsed FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))""",
        "tasks": f"""tasks AS (SELECT *, CASE WHEN status IN ('done','dead') THEN scheduled_at + INTERVAL 1 HOUR END AS finished_at FROM (SELECT event_id AS task_id, event_type AS kind,
            {_choose_sql(['pending', 'pending', 'running', 'done', 'done', 'failed', 'dead'], 'event_id%7')} AS status, CAST(props->>'$.k' AS BIGINT)/100.0::DOUBLE AS priority, (event_id%4)::INT AS attempts,
            CASE WHEN user_id%2=0 THEN 'auto' ELSE 'on_demand' END AS origin, user_id, ts AS scheduled_at FROM events))""",
        "questions": f"""questions AS (SELECT vec_id AS question_id, 1+(vec_id%6=0)::INT AS focus_id, {_choose_sql(QUESTION_KINDS, 'vec_id%6')} AS kind,
            {_choose_sql(['open', 'open', 'answered', 'escalated', 'parked'], 'vec_id%5')} AS status, (vec_id*37%100)/100.0::DOUBLE AS priority, (vec_id%5)::INT AS rounds,
            CASE WHEN vec_id%9<>0 THEN ' Target '||label END AS target, embedding, vec_id%8=7 AS stuck FROM embeddings)""",
        "messages": "messages AS (SELECT conv_id, turn, role, coalesce(text,'') AS text FROM conversations)",
        "runs": """runs AS (SELECT doc_id AS run_id, doc_id AS source_id, 3+doc_id%5 AS proposed, greatest(0, 2+doc_id%5-toxic) AS anchored, greatest(0, 2+doc_id%5-toxic)*quality AS verified,
            CASE WHEN doc_id%4<>0 THEN doc_id%3 END AS annihilated, CASE WHEN doc_id%4<>0 THEN doc_id%2 END AS sterile, CASE WHEN doc_id%10=0 THEN 'log' ELSE 'run' END AS origin
            FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id))""",
        "memories": f"""memories AS (SELECT c_custkey AS memory_id, CASE c_custkey%3 WHEN 0 THEN 'Lesson '||(c_custkey%60) WHEN 1 THEN ' LESSON  '||(c_custkey%60) ELSE 'lesson '||(c_custkey%60)||' ' END AS text,
            CASE WHEN c_custkey%5=4 AND c_custkey%97<>0 THEN 'fact' ELSE {_choose_sql(MEMORY_KINDS, 'c_custkey%7')} END AS kind, {_choose_sql(['chat', 'answer', 'manual', 'research', 'recon'], 'c_custkey%5')} AS source,
            c_custkey%4<>0 AS confirmed, c_custkey%3<>0 AS active, c_custkey%6=3 AS retired, CASE WHEN c_custkey%5=4 THEN 1+c_custkey%2 END AS focus_id, '['||(c_custkey%100)||','||(c_custkey*7%100)||']' AS claim_ids,
            CASE WHEN c_custkey%11<>0 THEN 'lesson '||(c_custkey%60) END AS text_key FROM customer)""",
        "proposals": f"""proposals AS (SELECT item_id AS proposal_id, 'LESSON '||(item_id%90) AS text, {_choose_sql(['pattern', 'dead_end', 'bogus', None], 'item_id%4')} AS kind,
            '['||(item_id%50)||','||(item_id*3%50)||']' AS claim_ids, 1+item_id%2 AS focus_id FROM benchmark)""",
        "discoveries": f"""discoveries AS (SELECT page_id AS discovery_id, {_choose_sql(['source', 'lead', 'observation'], 'page_id%3')} AS kind, {_choose_sql(['pending', 'approved', 'rejected', 'pending'], 'page_id%4')} AS status, 1+page_id%2 AS focus_id,
            lead_kind, CASE WHEN lead_kind IS NOT NULL THEN CASE WHEN page_id%31=0 THEN 'bad id '||page_id WHEN page_id%2=0 THEN (page_id*7919)::VARCHAR ELSE '10.1234/x.'||page_id END END AS lead_external_id, url, page_id%40 AS days
            FROM (SELECT *, CASE WHEN page_id%3=1 AND page_id%29<>0 THEN {_choose_sql(['pubmed', 'doi'], 'page_id%2')} END AS lead_kind FROM pages))""",
    }


#: CTEs that a CTE is built on.
NEEDS = {"active_focus": ["focuses"], "claims": ["n"], "chain": ["n", "hypotheses"], "claim_chunks": ["claims"]}


def with_(names: str, select: str, more: str = "", active: str = str(ACTIVE_FOCUS)) -> str:
    """SQL with the named CTEs (and those they need), further CTEs, and a select."""
    all_, wanted = ctes(active), set(names.split())
    for _ in range(3):
        wanted |= {n for w in wanted for n in NEEDS.get(w, [])}
    parts = [sql for name, sql in all_.items() if name in wanted] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
