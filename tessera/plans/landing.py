"""Queries over landed responses: lists of ids, declared fields, articles, web hits and rules of hosts.

The responses are texts as a harvester stores them, made here from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import records as S
from tessera.sources import shared
from tessera.sources.evidence import Evidence
from tessera.sources.landed import landed


@query("landed_ids", "SELECT DISTINCT (item_id%70)::VARCHAR AS external_id FROM benchmark WHERE item_id%9<>0")
def landed_ids(ev: Evidence) -> DataFrame:
    """Ids that search responses list; some responses are cut off."""
    k = F.col("item_id")
    body = F.to_json(F.struct(F.struct(F.array((k % 70).cast("string")).alias("idlist")).alias("esearchresult")))
    return S.ids_in(ev.read("benchmark").select(F.when(k % 9 == 0, F.left(body, F.lit(20))).otherwise(body).alias("value")))


@query("landed_fields", "SELECT event_id, CAST(props->>'$.k' AS BIGINT)::VARCHAR AS number, event_type AS second_name, NULL::VARCHAR AS nothing FROM events")
def landed_fields(ev: Evidence) -> DataFrame:
    """Fields that a declaration names by path, into objects and lists."""
    e = ev.read("events")
    body = F.to_json(F.struct(F.from_json("props", "k bigint").alias("given"), F.array(F.struct(F.lit("x").alias("name")), F.struct(F.col("event_type").alias("name"))).alias("authors")))
    out = S.fields_of(e.select("event_id", body.alias("value")), {"number": "given.k", "second_name": "authors.1.name", "nothing": "authors.7.name"}, "event_id")
    return out.select("event_id", "number", "second_name", F.col("nothing").cast("string").alias("nothing"))


@query("landed_source", "SELECT user_id::VARCHAR AS asker, event_type AS second_name, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2")
def landed_source(ev: Evidence) -> DataFrame:
    """Responses that have landed as files, by kind, read through the data source: of two kinds only the files are read."""
    e = ev.read("events")
    body = F.to_json(F.struct(F.struct("user_id").alias("by"), F.from_json("props", "k bigint").alias("given"), F.array(F.lit("x"), F.col("event_type")).alias("names")))
    at = shared.folder(ev.spark, "landed")
    e.select(body.alias("value"), F.col("event_type").alias("kind")).write.partitionBy("kind").text(at)
    fields = {"asker": "by.user_id", "k": "given.k", "second_name": "names.1"}
    rows = reduce(DataFrame.unionByName, (landed(ev.spark, at, fields).filter(F.col("file").startswith(f"kind={kind}/")) for kind in ("click", "error")))
    return rows.groupBy("asker", "second_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("long")).alias("total"))


TYPES = list(S.TYPE_GRADES)
GRADE_SQL = "[" + ",".join(f"'{g}'" for g in S.TYPE_GRADES.values()) + "]"


@query("landed_articles", f"""SELECT page_id::VARCHAR AS external_id, 'On page '||page_id AS title, CASE WHEN page_id%3=0 THEN 1990+page_id%30 WHEN page_id%3=1 THEN 1980+page_id%10 END AS year, CASE WHEN page_id%2=0 THEN '10.1/x'||page_id END AS doi,
  (SELECT arg_min(g, list_position(['meta_analysis','systematic_review','rct','cohort','case_control','case_series','case_report','preclinical','opinion'], g)) FROM (SELECT unnest([{GRADE_SQL}[1+page_id%15], {GRADE_SQL}[1+(page_id*4)%15]]) AS g)) AS design,
  CASE WHEN page_id%4=0 THEN 1 ELSE 2 END AS passages FROM pages WHERE page_id%11<>0""")
def landed_articles(ev: Evidence) -> DataFrame:
    """Articles of stored XML; the strongest of their publication types is the design; those without an abstract are left out."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    kind = lambda i: F.element_at(F.array(*map(F.lit, TYPES)), (i + 1).cast("int"))
    tag = lambda name, body, more="": F.concat(F.lit(f"<{name}{more}>"), body, F.lit(f"</{name}>"))
    date = F.when(k % 3 == 0, tag("Year", (1990 + k % 30).cast("string"))).when(k % 3 == 1, tag("MedlineDate", F.concat((1980 + k % 10).cast("string"), F.lit(" Spring")))).otherwise("<Season>Spring</Season>")
    second = F.when(k % 4 == 0, F.lit('<AbstractText Label="FUNDING"> </AbstractText>')).otherwise(F.lit('<AbstractText Label="RESULTS">It did.</AbstractText>'))
    abstract = F.when(k % 11 == 0, F.lit("")).otherwise(tag("Abstract", F.concat(tag("AbstractText", F.concat(F.lit("Aim "), n), ' Label="AIM"'), second)))
    article = F.concat(tag("ArticleTitle", F.concat(F.lit(" On page "), n)), tag("Journal", F.concat(F.lit("<Title>J</Title>"), tag("JournalIssue", tag("PubDate", date)))), abstract, tag("PublicationTypeList", F.concat(tag("PublicationType", kind(k % 15)), tag("PublicationType", kind(k * 4 % 15)))))
    ids = F.concat(tag("ArticleId", n, ' IdType="pubmed"'), F.when(k % 2 == 0, tag("ArticleId", F.concat(F.lit("10.1/x"), n), ' IdType="doi"')).otherwise(F.lit("")))
    xml = tag("PubmedArticle", F.concat(tag("MedlineCitation", F.concat(tag("PMID", n), tag("Article", article))), tag("PubmedData", tag("ArticleIdList", ids))))
    parsed = ev.read("pages").select(F.from_xml(xml, S.ARTICLE).alias("x")).select("x.*")
    return S.articles_in(parsed).select("external_id", "title", "year", "doi", "design", F.size("passages").alias("passages"))


@query("landed_hits", "SELECT response, row_number() OVER (PARTITION BY response ORDER BY page_id) AS position, url, 'about '||page_id||' more' AS text FROM (SELECT page_id, page_id//20 AS response, url FROM pages WHERE page_id%7<>0) QUALIFY position<=10")
def landed_hits(ev: Evidence) -> DataFrame:
    """Hits of stored web searches in their order, ten at most; hits without an address don't count."""
    k = F.col("page_id")
    hit = F.struct(F.lit("t").alias("title"), F.when(k % 7 == 0, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("about "), k.cast("string")).alias("description"), F.array(F.lit("more")).alias("extra_snippets"))
    # a response holds twenty hits
    g = ev.read("pages").groupBy(F.floor(k / 20).alias("response")).agg(F.array_sort(F.collect_list(F.struct("page_id", hit.alias("hit")))).alias("h"))
    body = F.to_json(F.struct(F.struct(F.transform("h", lambda x: x["hit"]).alias("results")).alias("web")))
    parsed = g.select("response", F.from_json(body, S.HITS)["web"].alias("web"))
    return S.hits_in(parsed).select("response", F.col("position").cast("long").alias("position"), "url", "text")


@query("host_rules", """SELECT page_id, CASE WHEN page_id%5=0 THEN TRUE WHEN page_id%5=1 THEN FALSE WHEN page_id%5=2 THEN FALSE WHEN page_id%5=3 THEN page_id%2=0 ELSE TRUE END AS allow, CASE WHEN page_id%5 IN (2,3) THEN 1.0/(1+page_id%9)::DOUBLE END AS rate_per_s FROM pages""")
def host_rules(ev: Evidence) -> DataFrame:
    """What rules files allow: none there, a failing host, all forbidden, a part forbidden, nothing said."""
    k = F.col("page_id")
    delay = F.concat(F.lit("Crawl-delay: "), (1 + k % 9).cast("string"), F.lit("\n"))
    said = F.when(k % 5 == 2, F.concat(F.lit("User-agent: *\n"), delay, F.lit("Disallow: /"))).when(k % 5 == 3, F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\n"), delay, F.lit("Disallow: /closed"))).otherwise(F.lit("# nothing"))
    status = F.when(k % 5 == 0, 404).when(k % 5 == 1, 503).otherwise(200)
    at = F.when(k % 2 == 0, F.lit("https://a.org/open/x")).otherwise(F.lit("https://a.org/closed/x"))
    p = ev.read("pages").select("page_id", S.robots_policy(status, F.when(k % 5 > 1, said), at).alias("p"))
    return p.select("page_id", "p.allow", "p.rate_per_s")
