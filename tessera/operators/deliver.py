"""Rendering, parsing and pacing of what goes out and comes back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACEHOLDER = re.compile(r"\$([a-z_]+)")


def render(template: str, values: dict[str, Column]) -> Column:
    """A text from a template with $names; a name without a value, or a value that no name asks for, is an error. Null values are empty."""
    asked = set(PLACEHOLDER.findall(template))
    if asked != set(values):
        raise ValueError(f"placeholders {sorted(asked - set(values))} have no value, values {sorted(set(values) - asked)} no placeholder")
    parts = PLACEHOLDER.split(template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def parsed_answers(answers: DataFrame, body: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """Adds answer (a struct, null if refused) and refused: 'truncated' (no closing brace), 'malformed', or the first rule of the answer's fields (as answer.name) that doesn't hold."""
    text = F.trim(F.col(body))
    parsed = answers.withColumn("answer", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    whole = F.get_json_object(text, "$").isNotNull()
    why = F.when(F.coalesce(~text.endswith("}"), F.lit(True)), "truncated").when(~whole | F.col("answer").isNull(), "malformed")
    for name, holds in rules.items():
        why = why.when(~F.coalesce(holds, F.lit(False)), name)
    return parsed.withColumn("refused", why).withColumn("answer", F.when(F.col("refused").isNull(), F.col("answer")))


#: Times that an answer may be asked for again.
REPAIRS = 2


def repaired_answers(attempts: DataFrame, request: str, attempt: str, body: str, schema: str, rules: dict[str, Column], most: int = REPAIRS) -> DataFrame:
    """What becomes of each request whose answer is asked for again when it doesn't hold: request, outcome, attempts (used), answer, refused.

    attempts: one row for each try (from 0).  The first try that holds is the answer ('valid'); a blank one ends the request, as the same
    budget gives the same ('truncated'); after ``most`` repairs a request is 'invalid', before that it is 'open'.  Of what isn't valid ``refused``
    keeps why the last try was refused and ``said`` its text, as quarantine.  Tries after the end are ignored, and so are rows without a number."""
    tried = parsed_answers(attempts.filter(F.col(attempt).between(0, most)), body, schema, rules)
    n, blank = F.col(attempt), F.trim(F.coalesce(body, F.lit(""))) == ""
    g = tried.groupBy(request).agg(
        F.min(F.when(F.col("refused").isNull(), n)).alias("good"), F.min(F.when(blank, n)).alias("blank"), F.max(n).alias("last"), F.min_by("answer", F.when(F.col("refused").isNull(), n)).alias("answer"),
        F.max_by(F.struct("refused", F.col(body).alias("said")), n).alias("end"), F.min_by(F.struct("refused", F.col(body).alias("said")), F.when(blank, n)).alias("stop"),
    )
    stopped = F.coalesce(F.col("blank") < F.coalesce("good", F.lit(most + 1)), F.lit(False))
    outcome = F.when(stopped, "truncated").when(F.col("good").isNotNull(), "valid").when(F.col("last") >= most, "invalid").otherwise("open")
    valid, why = outcome == "valid", F.when(stopped, F.col("stop")).otherwise(F.col("end"))
    used = 1 + F.when(stopped, F.col("blank")).otherwise(F.coalesce("good", "last"))
    return g.select(request, outcome.alias("outcome"), used.alias("attempts"), F.when(valid, F.col("answer")).alias("answer"), F.when(~valid, why["refused"]).alias("refused"), F.when(~valid, why["said"]).alias("said"))


def paced(requests: DataFrame, by: str, at: str, order: str, rate_per_s: float) -> DataFrame:
    """Adds starts: seconds at which each request of a group may start, no two closer than 1 / rate.

    start(i) = max(at(i), start(i - 1) + d), so start(i) - i d is the running maximum of at(j) - j d:
    a window without a loop.  A group is what one host takes at this rate."""
    d, w = 1.0 / rate_per_s, Window.partitionBy(by).orderBy(at, order)
    n = requests.withColumn("place", F.row_number().over(w))
    free = F.col(at) - F.col("place") * d
    return n.withColumn("starts", F.max(free).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("place") * d)


def word_vector(text: Column, dim: int) -> Column:
    """Counts of the words of a text by a hash into ``dim`` places: an embedding that needs no model."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("long") % dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)))
