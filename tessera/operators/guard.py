"""Guards, budgets, keys and hashes of the work loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a token, and tokens of a model's window that stay free.
CHARS_PER_TOKEN, BUDGET_MARGIN = 4, 256
# Fixed value: seconds that a judgment of a claim takes.
SECONDS_PER_CLAIM = 5.76


def sufficient(says: Column, direct: Column, sources: Column, blocked: Column) -> Column:
    """Whether a verdict finds the evidence sufficient: all four answers count, and a missing one says no."""
    return F.coalesce(says & direct & (sources >= 2) & blocked.isNull(), F.lit(False))


def entailed(follows: Column, exceeds: Column, contradicts: Column, restates: Column) -> Column:
    """Whether a pattern follows from what it cites: all four answers count."""
    return F.coalesce(follows & ~exceeds & ~contradicts & ~restates, F.lit(False))


# How sure an answer is where its sources agree, and else; characters of a page that are read at least, and those around it in a prompt.
AGREED, DIVIDED, LEAST_READ, PROMPT_CHARS = 0.8, 0.5, 2_000, 1_500


def confidence(agree: Column) -> Column:
    """How sure an answer is: less where its sources don't agree, or nobody says."""
    return F.when(agree, AGREED).otherwise(DIVIDED)


def read_chars(n_ctx: Column, max_tokens: int = 256) -> Column:
    """Characters of a page that a model's window has room for beside the prompt and the answer."""
    room = F.greatest(n_ctx.cast("long") - (BUDGET_MARGIN + max_tokens), F.lit(0))
    return F.greatest(room * CHARS_PER_TOKEN - PROMPT_CHARS, F.lit(LEAST_READ))


def capped_text(body: Column, most: int) -> Column:
    """The text of a body's first bytes; a character that the cut goes through, or that isn't UTF-8, becomes a replacement character."""
    return F.make_valid_utf8(F.substring(body, 1, most).cast("string"))


def is_pressure(status: Column, unavailable: Column) -> Column:
    """Whether a failure means that a resource is short: the model is down, too many requests, or a server's error."""
    return F.coalesce(unavailable | (status == 429) | ((status >= 500) & (status < 600)), unavailable, F.lit(False))


def over_budget(prompt: Column, max_tokens: Column, n_ctx: Column) -> Column:
    """Whether a prompt and its answer don't fit into a model's window."""
    return F.floor(F.length(prompt) / CHARS_PER_TOKEN) + max_tokens > n_ctx - BUDGET_MARGIN


def drifted(asked: Column, active: Column) -> Column:
    """Whether work was asked for under another focus than the active one; work that names none fits any."""
    return F.coalesce(asked != active, active.isNull() & asked.isNotNull())


def short_key(c: Column, digits: int = 6) -> Column:
    """A stable short key of a text (SHA-2 has no keyed short form, so its first digits)."""
    return F.left(F.sha2(c, 256), F.lit(digits))


def judgment_hash(fields: dict[str, Column]) -> Column:
    """Hash of a judgment: its fields as JSON texts in order of their names, nulls included."""
    said = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), F.lit("null"))) for n, c in sorted(fields.items())]
    return F.left(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}")), 256), F.lit(16))


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (name, interval_s, run_on_start, last_run) with due and the last_run that is stored: a job seen for the
    first time runs at once or starts its clock; a job that runs restarts it."""
    first = F.col("last_run").isNull()
    is_due = F.when(first, F.col("run_on_start")).otherwise(F.unix_timestamp(now) - F.unix_timestamp("last_run") >= F.col("interval_s"))
    return jobs.withColumn("due", is_due).withColumn("stored", F.when(first | is_due, now).otherwise(F.col("last_run")))


def all_or_nothing(refs: DataFrame, shown: DataFrame, by: str, ref: str) -> DataFrame:
    """Groups of references of which every one was shown, with the rows that they mean; a group with another is left out."""
    met = refs.join(shown.withColumn("there", F.lit(True)), ref, "left")
    bad = met.filter("there is null").select(by).distinct()
    return met.join(bad, by, "left_anti").drop("there")


def rebuilt(old: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table in a new form: columns that both have stay (cast), new ones are null; others go."""
    return old.select(*[(F.col(c) if c in old.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def queue_state(log: DataFrame, now: Column, lease_s: int, most: int) -> DataFrame:
    """State of each task from its log (task_id, at, entry_id, verb: queued, claimed, done, failed, cancelled).

    The last entry decides; claims that nobody ended within ``lease_s`` seconds are orphans and wait
    again; failures wait again until ``most`` attempts are used up."""
    last = F.max(F.struct("at", "entry_id", "verb")).alias("l")
    g = log.groupBy("task_id").agg(last, F.sum((F.col("verb") == "claimed").cast("int")).cast("long").alias("attempts"), F.min("at").alias("queued_at"))
    verb, orphan = F.col("l.verb"), (F.col("l.verb") == "claimed") & (F.unix_timestamp(now) - F.unix_timestamp("l.at") > lease_s)
    again = F.when(F.col("attempts") >= most, "dead").otherwise("pending")
    state = F.when(verb == "queued", "pending").when(orphan | (verb == "failed"), again).when(verb == "claimed", "running").otherwise(verb)
    return g.select("task_id", state.alias("state"), "attempts", F.coalesce(orphan, F.lit(False)).alias("orphan"))
