"""Queries that screen turns and texts by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import screen as S
from tessera.operators.spotting import REACH
from tessera.plans.registry import query
from tessera.sources.evidence import Evidence

#: Rules on words that the texts have.
RULES = (S.Rule("denied", "high", ("and",), ("the", "die")), S.Rule("both", "medium", ("le", "the"), ("que", "and"), True), S.Rule("alone", "high", ("der",), (), True), S.Rule("never", "high", ("unheard of",), (), True), S.Rule("odd", "low", ("los", "el"), ("de",), True))
#: Forms that don't count in what a person says.
AMBIGUOUS = frozenset({"los"})
#: What negates in texts of invented words.
NEGATORS = ("with", "from", r"th\w{0,20}")
#: Rules on words that no text has beside those that are checked: what a profile of a thousand rules costs.
MORE = tuple(S.Rule(f"rule {i}", "low", (f"term{i} of the profile", f"xq{i}"), (f"co{i}",), i % 2 == 0) for i in range(1000))
SEGMENTS = "seg AS (SELECT conv_id, CASE WHEN role='assistant' THEN 'reply' WHEN turn%3=0 THEN 'evidence' ELSE 'user' END AS kind, conv_id||':'||turn AS ref, coalesce(text,'') AS text FROM conversations)"


W = "\\p{L}\\p{N}_"
DENIED = f"(?i)(^|[^{W}])(" + "|".join(n.replace("\\w", f"[{W}]") for n in NEGATORS) + f")[^{W}.;!?][^.;!?]{{0,{REACH - 1}}}$"


def _free(terms: tuple[str, ...]) -> str:
    """A term of one word outside of negations: for each of its places what stands beside and before it."""
    beside = lambda place, n: f"NOT regexp_matches(substr(text, {place}, {n}), '[{W}-]')"
    return "(" + " OR ".join(f"len(list_filter(range(1, length(text)+1), lambda p: lower(substr(text, p, {len(t)}))='{t}' AND {beside('p-1', '(p>1)::INT')} AND {beside(f'p+{len(t)}', 1)} AND NOT regexp_matches(substr(text, 1, p-1), '{DENIED}')))>0" for t in terms) + ")"


def _has(terms: tuple[str, ...]) -> str:
    return "regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_-])(" + "|".join("\\s+".join(t.split()) for t in terms) + ")($|[^\\p{L}\\p{N}_-])')"


def _alerts_sql() -> str:
    rows = []
    for r in RULES:
        own = tuple(t for t in r.terms if t not in AMBIGUOUS)
        term = _has(r.terms) if r.discontinuation else f"CASE WHEN kind='reply' THEN {_has(r.terms)} ELSE {_free(r.terms)} END"
        co = _has(r.co_terms) if r.discontinuation or not r.co_terms else f"({_has(r.co_terms)} AND (conv_id IN (SELECT conv_id FROM seg WHERE kind='reply') OR {_free(r.co_terms)}))"
        rows.append(f"SELECT conv_id, '{r.key}' AS rule, '{r.severity}' AS severity, {S.SEVERITY.get(r.severity, 9)} AS severity_rank, ref FROM seg WHERE {term} AND (kind<>'user' OR {_has(own)})" + (f" AND conv_id IN (SELECT conv_id FROM seg WHERE {co})" if r.co_terms else ""))
    return f"WITH {SEGMENTS} SELECT conv_id, rule, severity, severity_rank, count(DISTINCT ref) AS texts, min(ref) AS first_ref FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


@query("turn_alerts", _alerts_sql())
def turn_alerts(ev: Evidence) -> DataFrame:
    """Alerts of every conversation by rules about stopping, which negations don't silence, by one that isn't, and by a thousand that find nothing."""
    kind = F.when(F.col("role") == "assistant", "reply").when(F.col("turn") % 3 == 0, "evidence").otherwise("user")
    seg = ev.read("conversations").select("conv_id", kind.alias("kind"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    return S.alerts(seg, RULES + MORE, "conv_id", AMBIGUOUS, NEGATORS)


FORMS = {"first": ("le",), "second": ("der", "die"), "third": ("nothing like it",)}
PROPERTIES = {"first": ("listed",), "third": ("listed", "shown")}
PHRASES = {"listed": ("los", "las"), "shown": ("unheard of",)}


@query("implicated_concepts", " UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept FROM documents WHERE {_has((*f, *(p for prop in PROPERTIES.get(c, ()) for p in PHRASES[prop])))}" for c, f in FORMS.items()))
def implicated_concepts(ev: Evidence) -> DataFrame:
    """Concepts that a text names, or reaches by a property that they have."""
    return S.implicated(ev.read("documents").select("doc_id", "text"), "doc_id", FORMS, PROPERTIES, PHRASES)
