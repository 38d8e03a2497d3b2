"""Terms in texts by one automaton: all terms of all rules are found in one pass, whatever their number.

Terms are rows of a table.  They go to the tasks as one list, of which each task makes an Aho-Corasick automaton; a
list beyond SLICE characters is sent in slices, each with a pass of its own, so that what is sent has a bound.  The
plan doesn't depend on the terms."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that are sent to the tasks at once.
SLICE = 1_000_000
#: Characters that may be between a negator and a term.
REACH = 40
_STOP = re.compile(r"[.;!?]")
_GAP = re.compile(r"\s+")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def plain(term: str) -> str:
    """A term as the automaton has it: lower case, one blank between words."""
    return _GAP.sub(" ", lowered(term)).strip()


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "_-" or unicodedata.category(c)[0] == "M"


class Spotter:
    """Finds terms as wholes, across any white space and whatever the case, and says which stand outside of negations."""

    def __init__(self, terms: list[str], negators: tuple[str, ...]) -> None:
        self.machine = ahocorasick.Automaton()
        for t in terms:
            self.machine.add_word(t, t)
        self.machine.make_automaton()
        self.negators = [re.compile(rf"(?i)\b(?:{n})\b") for n in negators]

    def spots(self, text: str) -> dict[str, bool]:
        """The terms in a text, and whether one of its places has no negator before it in the sentence, REACH characters away at most."""
        if not text or not len(self.machine):
            return {}
        squeezed = _GAP.sub(" ", lowered(text))
        behind, lost = [], [0]  # places behind long gaps, and the characters that gaps have lost up to there
        for gap in _GAP.finditer(text) if len(squeezed) < len(text) else ():
            if gap.end() - gap.start() > 1:
                lost.append(lost[-1] + gap.end() - gap.start() - 1)
                behind.append(gap.end() - lost[-1])

        found: dict[str, bool] = {}
        denied: list[int] | None = None
        for last, term in self.machine.iter(squeezed):
            first = last + 1 - len(term)
            if found.get(term) or (first and _in_word(squeezed[first - 1])) or (last + 1 < len(squeezed) and _in_word(squeezed[last + 1])):
                continue
            if denied is None:
                denied = sorted({m.end() for n in self.negators for m in n.finditer(text)})
            place = first + lost[bisect_right(behind, first)]
            ends = [e for e in denied[: bisect_right(denied, place)] if place - e <= REACH]
            found[term] = not any(not _STOP.search(text, e, place) for e in ends)
        return found


def spotted(texts: DataFrame, terms: DataFrame, keys: list[str], negators: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, term and free of every text of ``texts`` (keys, text) and term of ``terms`` (term) in it; free is false where all places are negated.

    Terms come back as ``plain`` has them.  Null and empty texts have none, null and blank terms are nowhere; with no terms there are no rows."""
    spark = texts.sparkSession
    held = terms.select("term").filter("term is not null").distinct()
    rows = texts.select(*keys, "text")
    schema = rows.drop("text").schema.add("term", "string").add("free", "boolean")

    def one(part: DataFrame) -> DataFrame:
        words = spark.sparkContext.broadcast(sorted({p for r in part.toLocalIterator() if (p := plain(r[0]))}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spotter = Spotter(words.value, negators)
            for batch in batches:
                row, term, free = [], [], []
                for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                    for t, f in spotter.spots(text).items():
                        row.append(i)
                        term.append(t)
                        free.append(f)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(term, pa.string()), pa.array(free, pa.bool_())], names=schema.names)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(one, _slices(held, "term")))


def _slices(strings: DataFrame, name: str) -> list[DataFrame]:
    """The rows in parts of SLICE characters, about."""
    n = max(1, -(-(strings.agg(F.sum(F.length(name))).first()[0] or 0) // SLICE))
    return [strings] if n == 1 else [strings.filter(F.pmod(F.xxhash64(name), F.lit(n)) == i) for i in range(n)]


def holding(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id and doc_id where a quotation (item_id, q) stands in a text (doc_id, t), letter by letter, each pair once.

    All quotations of a slice are found in one pass over the texts; what they have in common, with each other or with very many texts, costs
    nothing more and nothing is shuffled.  Null and empty ones stand nowhere."""
    spark = texts.sparkSession
    asked = quotes.select(F.col("item_id").cast("long").alias("item_id"), "q").filter("q <> ''").distinct()

    def one(part: DataFrame) -> DataFrame:
        items: dict[str, list[int]] = {}
        for r in part.toLocalIterator():
            items.setdefault(r.q, []).append(r.item_id)
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for q, ids in sent.value.items():
                machine.add_word(q, (q, ids))
            machine.make_automaton()
            for batch in batches:
                item, row = [], []
                for i, text in enumerate(batch.column(1).to_pylist() if len(machine) else []):
                    for ids in {q: ids for _, (q, ids) in machine.iter(text or "")}.values():
                        item += ids
                        row += [i] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), batch.column(0).take(pa.array(row, pa.int64()))], names=["item_id", "doc_id"])

        return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "t").mapInArrow(run, "item_id long, doc_id long")

    return reduce(DataFrame.unionByName, map(one, _slices(asked, "q")))
