"""Text, null and time semantics, decided once."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spaces_collapsed(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def text_key(c: Column) -> Column:
    """Key under which equal texts meet: lower case, white space collapsed."""
    return F.lower(spaces_collapsed(c))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC) without case; only texts that need it come here, all others are null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def folded_key(c: Column) -> Column:
    """Key under which equal texts meet whatever their form: composed characters, full case folding ('ß' is 'ss'), white space collapsed.

    Texts of ASCII stay in the engine; the others are handed to Python in batches."""
    other = c.rlike(r"[^\x00-\x7F]")
    return spaces_collapsed(F.coalesce(_composed(F.when(other, c)), F.lower(c)))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def marker_to_null(c: Column, markers: tuple[str, ...] = ("", "none", "n/a", "null", "unknown")) -> Column:
    """Null where the text only says that there is nothing; other texts stay as they are."""
    return F.when(~F.lower(F.trim(c)).isin(*markers), c)


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or nothing is there."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def tokens(c: Column) -> Column:
    """Search tokens: a letter or digit, then letters, digits and hyphens; lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-zà-ÿ0-9][a-zà-ÿ0-9\-]*"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def iso(c: Column) -> Column:
    """UTC time as text that sorts like time."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
