"""Queries on texts, pages and screening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import folded_key, text_key
from tessera.operators import screen as S
from tessera.operators import spotting as P
from tessera.operators import text as X
from tessera.plans.registry import query
from tessera.sources import shared
from tessera.sources.evidence import Evidence, with_
from tessera.sources.records import robots_policy

KEY = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


FORM = "replace(" + KEY.format("nfc_normalize(text)") + ", 'ß', 'ss')"


@query("text_key_dedup", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {FORM}) AS first_id FROM documents QUALIFY first_id<>doc_id")
def text_key_dedup(ev: Evidence) -> DataFrame:
    """Rows whose text is that of an earlier row; keys are summed up before they meet."""
    d = ev.read("documents").select("doc_id", F.sha2(folded_key(F.col("text")), 256).alias("key"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return d.join(first, "key").filter("doc_id <> first_id").select("doc_id", "first_id")


@query("chunk_sentences", "SELECT doc_id, len(s) AS n, md5(array_to_string(s,'|')) AS digest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z(])', '\\1␞\\2', 'g'), '␞') AS s FROM documents)")
def chunk_sentences(ev: Evidence) -> DataFrame:
    s = X.sentences(F.col("text"))
    return ev.read("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("chunk_pack")
def chunk_pack(ev: Evidence) -> DataFrame:
    d = ev.read("documents").select("doc_id", F.posexplode(X.packed_chunks(F.col("text"))).alias("ord", "chunk"))
    return d.select("doc_id", "ord", F.length("chunk").alias("chars"), F.floor(F.length("chunk") / 4).alias("tokens"), F.md5("chunk").alias("digest"))


@query("quote_anchor", "SELECT item_id, doc_id FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000+item_id, split_part(trim(text), ' ', 2) FROM benchmark WHERE item_id%50=0) b JOIN documents d ON trim(b.text)<>'' AND (contains(d.text, b.text) OR contains(" + KEY.format("d.text") + ", " + KEY.format("b.text") + "))")
def quote_anchor(ev: Evidence) -> DataFrame:
    """Documents that hold a benchmark text, or the second word of some of them, but for case and white space."""
    b = ev.read("benchmark").select("item_id", "text")
    word = b.filter("item_id % 50 = 0").select((F.col("item_id") + 1_000_000).alias("item_id"), F.split_part(F.trim("text"), F.lit(" "), F.lit(2)).alias("text"))
    q = b.unionByName(word).select("item_id", text_key(F.col("text")).alias("q")).filter("q <> ''")
    return P.holding(ev.read("documents").select("doc_id", text_key(F.col("text")).alias("t")), q)


@query("pmid_extract", "SELECT doc_id, pmid FROM (SELECT doc_id, nullif(regexp_extract(text, '(?i)(?:^|[^0-9A-Za-z_.])(?:pmid[:\\s]*)?([0-9]{1,8})(?:[^0-9A-Za-z_.]|$)', 1), '') AS pmid FROM documents) WHERE pmid IS NOT NULL")
def pmid_extract(ev: Evidence) -> DataFrame:
    return ev.read("documents").select("doc_id", X.pmid(F.col("text")).alias("pmid")).filter("pmid is not null")


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#:]+)', 1)), '^www\\.', '')"


@query("host_slug", f"SELECT page_id, {HOST} AS host, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def host_slug(ev: Evidence) -> DataFrame:
    return ev.read("pages").select("page_id", X.host(F.col("url")).alias("host"), X.slug(F.col("url")).alias("slug"))


@query("host_domains", f"SELECT host, count(*) AS pages, host='example.com' OR host LIKE '%.example.com' AS evidence_domain FROM (SELECT {HOST} AS host FROM pages) GROUP BY 1")
def host_domains(ev: Evidence) -> DataFrame:
    g = ev.read("pages").groupBy(X.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    return g.withColumn("evidence_domain", X.in_domain(F.col("host"), "example.com"))


LEAD_URL = "CASE WHEN page_id%4=0 THEN 'https://pubmed.ncbi.nlm.nih.gov/'||(page_id*7919)||'/' WHEN page_id%4=1 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC'||(page_id+10000) ELSE url END"
LEAD_TEXT = "CASE WHEN page_id%3=0 THEN 'as found (10.1234/abc.'||page_id||').' WHEN page_id%3=1 THEN coalesce(html,'') ELSE 'see 10.1000/).' END"


def _doi(c: str) -> str:
    return f"regexp_replace(regexp_extract({c}, '{X.DOI}', 1), '{X.DOI_TAIL}', '')"



@query("lead_from_url", f"""SELECT page_id, kind, CASE kind WHEN 'pubmed' THEN number WHEN 'doi' THEN coalesce(d1, d2) END AS id, indexed FROM (SELECT *, CASE WHEN number<>'' THEN 'pubmed' WHEN coalesce(d1, d2) IS NOT NULL THEN 'doi' END AS kind FROM
  (SELECT page_id, regexp_extract(u, '{X.PUBMED_URL}', 1) AS number, CASE WHEN regexp_matches({_doi('u')}, '{X.WHOLE_DOI}') THEN {_doi('u')} END AS d1, CASE WHEN regexp_matches({_doi('m')}, '{X.WHOLE_DOI}') THEN {_doi('m')} END AS d2,
  regexp_matches(u, '{X.PUBMED_URL}') OR regexp_matches(u, '{X.PMC_URL}') AS indexed FROM (SELECT page_id, {LEAD_URL} AS u, {LEAD_TEXT} AS m FROM pages)))""")
def lead_from_url(ev: Evidence) -> DataFrame:
    """Leads of hits (pages, some with addresses and texts of articles), and which addresses are of indexed articles."""
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (k * 7919).cast("string"), F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), (k + 10000).cast("string"))).otherwise(F.col("url"))
    said = F.when(k % 3 == 0, F.concat(F.lit("as found (10.1234/abc."), k.cast("string"), F.lit(")."))).when(k % 3 == 1, F.coalesce("html", F.lit(""))).otherwise(F.lit("see 10.1000/)."))
    p = ev.read("pages").select("page_id", X.lead(url, said).alias("l"), X.is_indexed_article(url).alias("indexed"))
    return p.select("page_id", "l.kind", "l.id", "indexed")


@query("secret_redaction", "SELECT doc_id, md5(r) AS digest FROM (SELECT doc_id, text, regexp_replace(text, '" + X.SECRET.replace("'", "''") + "', '\\1" + X.HIDDEN + "', 'g') AS r FROM documents) WHERE r<>text")
def secret_redaction(ev: Evidence) -> DataFrame:
    d = ev.read("documents").select("doc_id", "text", X.redacted(F.col("text")).alias("r"))
    return d.filter("r <> text").select("doc_id", F.md5("r").alias("digest"))


def _page_sql() -> str:
    """Title and text of pages by patterns, for pages whose dropped tags are closed and not within each other: scripts go without a trace, other dropped tags end a line, line tags too."""
    out = "coalesce(html,'')"
    for t in sorted(X.DROPPED_TAGS):
        out = f"regexp_replace({out}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', {'chr(10)' if t not in ('script', 'style') else repr('')}, 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?({'|'.join(sorted(X.LINE_TAGS))})\\b[^>]*>', chr(10), 'g')"
    plain = lambda x: reduce(lambda y, e: f"regexp_replace({y}, '&{e[0]};?', '{e[1]}', 'g')", (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")), f"regexp_replace({x}, '<[/a-zA-Z!][^>]*>', '', 'g')")
    lines = f"list_filter(list_transform(string_split({plain('h')}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x)>={X.LEAST_LINE})"
    title = f"trim(regexp_replace({plain(chr(39) + chr(39) + ' || regexp_extract(h, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title' + chr(39) + ', 1)')}, '\\s+', ' ', 'g'))"
    return f"page AS (SELECT page_id, url, {title} AS title, array_to_string({lines}, chr(10)) AS text FROM (SELECT page_id, url, {out} AS h FROM pages))"


@query("html_text", f"WITH {_page_sql()} SELECT page_id, title, length(text) AS chars, md5(text) AS digest FROM page")
def html_text(ev: Evidence) -> DataFrame:
    shared.small_batches(ev.spark)
    p = ev.read("pages").select("page_id", X.page_text(F.col("html")).alias("p"))
    return p.select("page_id", "p.title", F.length("p.text").alias("chars"), F.md5("p.text").alias("digest"))


def _stripped_sql() -> str:
    out = "coalesce(html,'')"
    for t in sorted(X.DROPPED_TAGS):
        out = f"regexp_replace({out}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{'|'.join(sorted(X.LINE_TAGS))})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


@query("html_stripped", f"SELECT page_id, md5({_stripped_sql()}) AS digest FROM pages")
def html_stripped(ev: Evidence) -> DataFrame:
    return ev.read("pages").select("page_id", F.md5(X.stripped_html(F.coalesce("html", F.lit("")))).alias("digest"))


#: Characters of a page that are handed on, and the rules of a host's last letter in place of its rules file.
PAGE_CHARS = 24_000


REFUSED = " OR ".join(f"contains(probe, '{m}')" for m in X.INTERSTITIAL)


@query("page_refusal", f"""WITH {_page_sql()}, v AS (SELECT page_id, text, host, CASE WHEN host IN ({','.join(f"'{d}'" for d in X.EVIDENCE_DOMAINS)}) THEN 'evidence' WHEN host LIKE '%.org' THEN 'robots' WHEN {REFUSED} THEN 'interstitial' WHEN length(text)<{X.LEAST_PAGE} THEN 'short' ELSE 'read' END AS verdict
  FROM (SELECT *, lower(title||' '||left(text, {X.PROBED_CHARS})) AS probe, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM page))
  SELECT page_id, verdict, CASE WHEN verdict='read' AND host LIKE 'm.%' THEN 0.25::DOUBLE END AS rate_per_s, CASE WHEN verdict='read' THEN md5(left(text, {PAGE_CHARS})) END AS digest, verdict='read' AND length(text)>{PAGE_CHARS} AS truncated FROM v""")
def page_refusal(ev: Evidence) -> DataFrame:
    """What becomes of each page: refused (and why), or read, with a note if only its beginning is handed on.

    Hosts have landed rules files: those that end in org forbid all, other subdomains m. ask for a delay."""
    shared.small_batches(ev.spark)
    p = ev.read("pages").select("page_id", "url", X.page_text(F.col("html")).alias("p"))
    host = X.full_host(F.col("url"))
    rules = F.when(host.endswith(".org"), F.lit("User-agent: *\nDisallow: /")).when(host.startswith("m."), F.lit("User-agent: *\nCrawl-delay: 4\nDisallow: /private"))
    policy = robots_policy(F.when(rules.isNull(), 404).otherwise(200), rules, F.col("url"))
    p = p.withColumn("policy", policy).withColumn("verdict", X.page_verdict(F.col("url"), F.col("policy.allow"), F.col("p.title"), F.col("p.text")))
    read = F.col("verdict") == "read"
    return p.select("page_id", "verdict", F.when(read, F.col("policy.rate_per_s")).alias("rate_per_s"), F.when(read, F.md5(F.left("p.text", F.lit(PAGE_CHARS)))).alias("digest"), (read & (F.length("p.text") > PAGE_CHARS)).alias("truncated"))


CONCEPTS = {"licence": ("mit license", "apache license", "all rights reserved"), "contact": ("email", "phone", "call"), "frequent": ("the", "and", "der", "die"), "absent": ("unheard of term",)}
SQL_CONCEPTS = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS concept FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_\\-À-ɏ])(" + "|".join("\\s+".join(f.split()) for f in forms) + ")($|[^a-zA-Z0-9_\\-À-ɏ])')" for c, forms in CONCEPTS.items()
)


@query("concept_hits", SQL_CONCEPTS)
def concept_hits(ev: Evidence) -> DataFrame:
    return X.concept_hits(ev.read("documents"), "doc_id", "text", CONCEPTS)


@query("safety_alerts", f"WITH h AS ({SQL_CONCEPTS}) SELECT concept AS rule, count(*) AS texts, min(doc_id) AS first_id FROM h JOIN documents USING (doc_id) WHERE concept IN ('licence','contact') AND EXISTS (SELECT 1 FROM h c WHERE c.doc_id=h.doc_id AND c.concept='frequent') GROUP BY 1")
def safety_alerts(ev: Evidence) -> DataFrame:
    """Rules fire where their term and their co-term are in the same text."""
    h = X.concept_hits(ev.read("documents"), "doc_id", "text", CONCEPTS)
    fired = h.groupBy("doc_id").agg(F.collect_set("concept").alias("c")).filter(F.array_contains("c", "frequent"))
    rules = fired.select("doc_id", F.explode(F.array_intersect("c", F.array(F.lit("licence"), F.lit("contact")))).alias("rule"))
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first_id"))


@query("memory_collisions", f"WITH h AS ({SQL_CONCEPTS}) SELECT c.conv_id, count(DISTINCT h.doc_id) AS documents FROM (SELECT DISTINCT conv_id, k.concept FROM conversations, (VALUES ('licence',' the '),('contact',' le ')) k(concept, word) WHERE contains(lower(text), k.word)) c JOIN h USING (concept) GROUP BY 1")
def memory_collisions(ev: Evidence) -> DataFrame:
    """Conversations and documents that share a concept; both sides come down to concepts before they meet."""
    docs = X.concept_hits(ev.read("documents"), "doc_id", "text", CONCEPTS)
    low = F.lower("text")
    said = ev.read("conversations").select("conv_id", F.explode(F.array_compact(F.array(F.when(F.contains(low, F.lit(" the ")), F.lit("licence")), F.when(F.contains(low, F.lit(" le ")), F.lit("contact"))))).alias("concept")).distinct()
    # few concepts: the documents of each set of concepts are counted once
    sets = docs.filter(F.col("concept").isin("licence", "contact")).groupBy("doc_id").agg(F.sort_array(F.collect_set("concept")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    conv = said.groupBy("conv_id").agg(F.sort_array(F.collect_set("concept")).alias("c"))
    # at most one row for each set of the two concepts
    return conv.join(F.broadcast(sets), F.arrays_overlap("c", "s")).groupBy("conv_id").agg(F.sum("n").alias("documents"))


@query("negation_scope")
def negation_scope(ev: Evidence) -> DataFrame:
    return S.implicated(ev.read("documents").select("doc_id", "text"), "doc_id", {"and": ("and",), "der": ("der",)}, {}, {}, ("not", "no", "of", r"nicht\w{0,10}"))


@query("query_normalised", "SELECT item_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS q, length(text)//4 AS tokens FROM benchmark")
def query_normalised(ev: Evidence) -> DataFrame:
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    return ev.read("benchmark").select("item_id", F.left(one, F.lit(240)).alias("q"), F.floor(F.length("text") / 4).alias("tokens"))


SAID = "CASE WHEN item_id%3=0 THEN 'step 3 of sigma-1 [12] ' ELSE '' END || text"
PLAIN = f"left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SAID}, '[\\[\\]]', '', 'g'), '(^|[^\\w-])\\d+([^\\w-]|$)', '\\1\\2', 'g'), '(^|[^\\w-])\\d+([^\\w-]|$)', '\\1\\2', 'g'), '\\s+', ' ', 'g')), 90)"


@query("plain_labels", f"SELECT item_id, {PLAIN} AS label, coalesce(nullif(rtrim(regexp_replace('spec:'||item_id||CASE WHEN item_id%2=0 THEN ' round' ELSE '' END, '[0-9]+', '', 'g'), ':-_'), ''), '?') AS search FROM benchmark")
def plain_labels(ev: Evidence) -> DataFrame:
    """Texts and names of searches without anything that could be read as the number of a reference."""
    k = F.col("item_id")
    said = F.concat(F.when(k % 3 == 0, "step 3 of sigma-1 [12] ").otherwise(""), "text")
    search = F.concat(F.lit("spec:"), k.cast("string"), F.when(k % 2 == 0, " round").otherwise(""))
    return ev.read("benchmark").select("item_id", X.plain_label(said).alias("label"), X.search_label(search).alias("search"))


@query("resolved_references", with_("memories", """SELECT item_id, list_reduce(list_transform(range(1, len(p)+1), lambda i: p[i] || CASE WHEN i<=len(k) THEN coalesce(m[TRY_CAST(k[i] AS INT)], '['||k[i]||']') ELSE '' END), lambda a, b: a||b) AS said FROM
  (SELECT item_id, string_split_regex(t, '\\[\\d{1,4}\\]') AS p, regexp_extract_all(t, '\\[(\\d{1,4})\\]', 1) AS k FROM (SELECT item_id, 'seen ['||(item_id%12)||'][0'||(item_id%5)||'] and [99999] of '||left(text, 60) AS t FROM benchmark)),
  (SELECT map_from_entries(list((memory_id::INT, text))) AS m FROM memories WHERE memory_id BETWEEN 1 AND 8 AND trim(text)<>'')"""))
def resolved_references(ev: Evidence) -> DataFrame:
    """Texts in which the numbers of what was shown are the labels of that; other numbers stay as they are."""
    k = F.col("item_id")
    said = F.concat(F.lit("seen ["), (k % 12).cast("string"), F.lit("][0"), (k % 5).cast("string"), F.lit("] and [99999] of "), F.left("text", F.lit(60)))
    shown = ev.memories.filter("memory_id between 1 and 8").select(F.col("memory_id").cast("int").alias("k"), F.col("text").alias("label"))
    refs = shown.agg(F.map_from_entries(F.collect_list(F.struct("k", "label"))).alias("refs"))  # what one prompt has shown
    return ev.read("benchmark").crossJoin(F.broadcast(refs)).select("item_id", X.resolved(said, F.col("refs")).alias("said"))


@query("evidence_sections", with_("sources claims chunks claim_chunks directness active_focus", """SELECT claim_id, title, design, md5(left(string_agg(text, chr(10) ORDER BY ord), 2400)) AS digest FROM (SELECT c.claim_id, s.title, s.design, k.text, k.ord FROM claims c CROSS JOIN active_focus f JOIN sources s USING (source_id)
  JOIN claim_chunks cc USING (claim_id) JOIN chunks k USING (chunk_id) WHERE c.verified AND c.scale_id=f.focus_scale AND NOT EXISTS (SELECT 1 FROM directness d WHERE d.claim_id=c.claim_id AND d.focus_id=f.focus_id)) GROUP BY 1,2,3"""))
def evidence_sections(ev: Evidence) -> DataFrame:
    """What a judge is shown of each claim that still needs a judgment: its source, and the text of its chunks in order, cut at 2400 characters."""
    c = ev.claims.filter("verified").join(ev.active_focus, F.col("scale_id") == F.col("focus_scale"))
    c = c.join(ev.directness.select("claim_id", "focus_id"), ["claim_id", "focus_id"], "left_anti").select("claim_id", "source_id")
    texts = c.join(ev.claim_chunks.select("claim_id", "chunk_id"), "claim_id").join(ev.chunks.select("chunk_id", "ord", "text"), "chunk_id")
    # a claim names a few chunks
    g = texts.groupBy("claim_id", "source_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    body = F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit(EVIDENCE_CHARS))
    return g.join(ev.sources.select("source_id", "title", "design"), "source_id").select("claim_id", "title", "design", F.md5(body).alias("digest"))


#: Fixed value: characters of the text of a claim's chunks that are shown.
EVIDENCE_CHARS = 2400
