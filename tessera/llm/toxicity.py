"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

The lexicon holds fixed terms and terms and stems learnt from labelled rows.  A
trie of its entries, together with the allowed edits, is one nondeterministic
automaton; it is made deterministic lazily, one transition at a time, and all
words of a batch run through its table at once.  Windows around the hits tell
quoted and reported terms from terms said to someone, and a logistic model over
these sums gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow_text import flat, ranges, runs
from tessera.llm.runtime import small_batches

#: Labelled ids, by hash order, that lexicon and model are fitted on (half each).
FIT_IDS = 8_000
#: Learnt entries at most, by log-odds.
LEARNT_ENTRIES = 400
#: Words to either side of a hit that belong to its context.
WINDOW = 8
THRESHOLD = 0.3

# Common English terms of abuse that need no labels to be known.
TERMS = (
    "idiot moron stupid dumb imbecile fool loser scum trash garbage pathetic worthless disgusting clown jerk "
    "bastard bitch asshole crap damn hate kill ugly vermin filth parasite degenerate retard dumbass shithead fucker fuck shit"
).split()
# Words that report speech, and words that address someone.
REPORTING = set("said says say called calls quote quoted wrote writes reported word term dijo llamó dit appelé sagte nannte".split())
ADDRESSING = set("you your youre du dich dir euch tu te vous tú usted ustedes".split())
QUOTES = "\"'“”„‟«»‘’‹›"


def allowed_edits(term: str) -> int:
    """Edits of a hit.  Short terms have common words one edit away ('have' of 'hate'), so they must be exact."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    terms: list[str]
    stems: list[str]
    weights: list[float]  # of the terms, then of the stems
    coefficients: list[float] = field(default_factory=list)


class Automaton:
    """Lazily determinised product of the lexicon trie and the Levenshtein automata of its terms.

    A state is a set of (trie node, edits so far).  The first letter must agree;
    stems accept without edits whatever follows."""

    DEAD, START = 0, 1

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.child: list[dict[int, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.room = [0]
        letters = sorted({c for t in (*lex.terms, *lex.stems) for c in t})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}  # 0: no letter, 1: any other letter
        for kind, entries in ((self.word_at, lex.terms), (self.stem_at, lex.stems)):
            for i, t in enumerate(entries):
                node = 0
                edits = allowed_edits(t) if kind is self.word_at else 0
                for c in t:
                    node = self._step(node, self.symbol[c])
                    self.room[node] = max(self.room[node], edits)
                kind[node] = i
        self.codes = np.zeros(1 << 16, np.uint8)
        everything = np.array([chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)])
        self.codes[np.char.isalnum(everything)] = 1
        for c, s in self.symbol.items():
            for x in (c, c.upper()):
                if len(x) == 1 and ord(x) < 1 << 16:
                    self.codes[ord(x)] = s
        for c, x in zip("01345@$", "oieasas"):  # digits and signs written for letters
            if x in self.symbol:
                self.codes[ord(c)] = self.symbol[x]
        self.sets: list[frozenset] = [frozenset(), frozenset([(0, 0)])]
        self.known = {s: i for i, s in enumerate(self.sets)}
        width = len(letters) + 2
        self.table = np.full((2, width), -1, np.int32)
        self.table[0] = 0
        self.accept = np.array([-1, -1], np.int32)  # entry number, stems after terms
        self.edits = np.zeros(2, np.int8)
        self.stop = np.array([True, False])

    def _step(self, node: int, symbol: int) -> int:
        if symbol not in self.child[node]:
            self.child[node][symbol] = len(self.child)
            self.child.append({})
            self.room.append(0)
        return self.child[node][symbol]

    def _next(self, state: int, symbol: int) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state]:
            moves = [(self.child[node][symbol], e)] if symbol in self.child[node] else []
            if node and e < self.room[node]:
                moves.append((node, e + 1))
            if node:
                moves += [(c, e + 1) for c in self.child[node].values() if e + 1 <= self.room[c]]
            for n, d in moves:
                best[n] = min(best.get(n, 9), d)
        waiting = list(best.items())
        while waiting:  # a letter of the term that the word lacks
            node, e = waiting.pop()
            for c in self.child[node].values():
                if e + 1 <= self.room[c] and e + 1 < best.get(c, 9):
                    best[c] = e + 1
                    waiting.append((c, e + 1))
        key = frozenset(best.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            entry, edits, stop = -1, 0, False
            for node, e in sorted(best.items(), key=lambda x: (x[1], x[0])):
                if e == 0 and node in self.stem_at:
                    entry, edits, stop = len(self.lex.terms) + self.stem_at[node], 0, True
                if entry < 0 and node in self.word_at and e <= allowed_edits(self.lex.terms[self.word_at[node]]):
                    entry, edits = self.word_at[node], e
            self.accept = np.append(self.accept, np.int32(entry))
            self.edits = np.append(self.edits, np.int8(edits))
            self.stop = np.append(self.stop, stop)
            row = np.full((1, self.table.shape[1]), self.known[key] if stop else -1, np.int32)
            self.table = np.concatenate((self.table, row))
        return self.known[key]

    def match(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the words that match, their entries and edits."""
        live, state, at = np.arange(len(start)), np.full(len(start), self.START, np.int32), start.copy()
        out = []
        while len(live):
            symbol = classes[at]
            after = self.table[state, symbol]
            if (miss := after < 0).any():
                width = self.table.shape[1]
                for pair in np.unique(state[miss].astype(np.int64) * width + symbol[miss]).tolist():
                    s, c = divmod(pair, width)
                    to = self._next(s, c)
                    self.table[s, c] = to
                after = self.table[state, symbol]
            at = at + 1
            done = (at >= end[live]) | self.stop[after]
            hit = done & (self.accept[after] >= 0)
            out.append((live[hit], self.accept[after[hit]], self.edits[after[hit]]))
            keep = ~done & (after != self.DEAD)
            live, state, at = live[keep], after[keep], at[keep]
        words, entries, edits = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        order = np.argsort(words)
        return words[order], entries[order], edits[order]


NAMES = ("exact", "stem", "one_edit", "two_edits", "density", "distinct", "quoted", "reported", "addressed", "length", "any_exact", "any")


class Scorer:
    def __init__(self, lex: Lexicon):
        self.lex, self.auto = lex, Automaton(lex)
        self.weights = np.array(lex.weights)

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of sums for each text, and the number of hits."""
        raw, offsets = flat(column)
        rows = [self._chunk(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in ranges(offsets)]
        if not rows:
            return np.zeros((0, len(NAMES))), np.zeros(0, np.int64)
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        text = raw.tobytes().decode(errors="replace")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        doc_at = lead[offsets]
        classes = self.auto.codes[np.minimum(codes, 65535)]
        inside = classes > 0
        start, end = runs(inside)
        split = doc_at[1:-1]
        split = np.unique(split[(split > 0) & (split < len(codes))])
        split = split[inside[split] & inside[split - 1]]
        if len(split):
            start, end = np.sort(np.concatenate((start, split))), np.sort(np.concatenate((end, split)))
        first = np.searchsorted(start, doc_at)
        n_words = np.diff(first)
        hit, entry, edits = self.auto.match(classes, start, end)
        f, hits = np.zeros((n, len(NAMES))), np.zeros(n, np.int64)
        doc = np.searchsorted(first, hit, "right") - 1
        w, stems = self.weights[entry], entry >= len(self.lex.terms)
        for column, mask in ((0, ~stems & (edits == 0)), (1, stems), (2, edits == 1), (3, edits == 2)):
            np.add.at(f[:, column], doc[mask], w[mask])
        quoted, reported, addressed = self._contexts(text, hit, doc, start, end, first, doc_at)
        for column, mask in ((6, quoted), (7, reported), (8, addressed)):
            np.add.at(f[:, column], doc[mask], w[mask])
        np.add.at(hits, doc, 1)
        pairs = np.unique(doc.astype(np.int64) * (len(self.weights) + 1) + entry)
        np.add.at(f[:, 5], pairs // (len(self.weights) + 1), 1)
        f[:, 10], f[:, 11] = f[:, 0] > 0, hits > 0
        f[:, 4] = 100 * f[:, :4].sum(axis=1) / np.maximum(n_words, 1)
        f[:, 9] = n_words / 100
        f[:, :10] = np.log1p(f[:, :10])
        return f, hits

    def _contexts(self, text: str, hit, doc, start, end, first, doc_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hit whether its window quotes it, reports it, or addresses someone."""
        out = np.zeros((3, len(hit)), bool)
        for k, (i, d) in enumerate(zip(hit.tolist(), doc.tolist())):
            a, b = max(i - WINDOW, int(first[d])), min(i + WINDOW, int(first[d + 1]) - 1)
            before, after = text[int(start[a]) if a > first[d] else int(doc_at[d]) : int(start[i])], text[int(end[i]) : int(end[b]) if b < first[d + 1] - 1 else int(doc_at[d + 1])]
            opened = max((before.rfind(q) for q in QUOTES), default=-1)
            out[0, k] = opened >= 0 and (opened == 0 or not before[opened - 1].isalnum()) and any(q in after for q in QUOTES)
            near = {w.strip(".,;:!?()" + QUOTES).lower() for w in (before + " " + after).split()}
            out[1, k], out[2, k] = not REPORTING.isdisjoint(near), not ADDRESSING.isdisjoint(near)
        return out[0], out[1], out[2]


def score_of(f: np.ndarray, coefficients: list[float]) -> np.ndarray:
    c = np.array(coefficients)
    return 1 / (1 + np.exp(-np.clip(f @ c[1:] + c[0], -30, 30)))


#: Used where too few labelled rows exist to fit a model.
PRIOR = [-4.0, 1.5, 1.0, 0.7, 0.3, 0.5, 0.5, -0.7, -0.3, 0.3, -0.2, 1.5, 1.0]


def fit_logistic(f: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack((np.ones((len(f), 1)), f))
    c, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * c)
        c = c + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return c.tolist()


_WORD = re.compile(r"[^\W_]{3,}")


def _doc_features(text: str) -> set[str]:
    """The words of a text, and their stems of four to six letters marked by *."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}


def _count(docs: DataFrame, only: set[str] | None) -> dict[str, int]:
    """In how many texts each feature (of ``only``) is; without it, features in at least 1 % of the texts and in three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = _doc_features(t or "")
                seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    summed = docs.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    if only is None:
        summed = summed.filter(F.col("n") >= max(3, docs.count() // 100))
    return {r[0]: r[1] for r in summed.collect()}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems that toxic texts of the sample (text, toxic) have far oftener than others."""
    bad, good = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    n_bad, n_good = bad.count(), good.count()
    weights: dict[str, float] = {}
    if n_bad >= 5:
        in_bad = _count(bad, None)
        in_good = _count(good, set(in_bad))
        odds = {k: float(np.log((n + 0.5) / (n_bad + 1)) - np.log((in_good.get(k, 0) + 0.5) / (n_good + 1))) for k, n in in_bad.items()}
        top: dict[str, int] = {}
        for k, n in in_bad.items():
            if not k.endswith("*"):
                for m in (4, 5, 6):
                    top[k[:m] + "*"] = max(top.get(k[:m] + "*", 0), n)
        chosen: list[str] = []
        for k in sorted((k for k, o in odds.items() if o >= 1.5), key=lambda k: (len(k), k)):
            # a stem counts if no single word makes most of it; what a stem covers is left out
            if k.endswith("*") and (top.get(k, 0) > 0.5 * in_bad[k] or any(k.startswith(c[:-1]) and odds[c] >= odds[k] - 0.5 for c in chosen if c.endswith("*"))):
                continue
            chosen.append(k)
        stems = [c[:-1] for c in chosen if c.endswith("*")]
        chosen = [c for c in chosen if c.endswith("*") or not any(c.startswith(s) for s in stems)]
        for k in sorted(chosen, key=lambda k: (-odds[k], k))[:LEARNT_ENTRIES]:
            weights[k] = min(odds[k], 6.0)
        for t in TERMS:
            if t in in_bad:
                weights.setdefault(t, max(odds[t], 0.0))
    terms = sorted({*TERMS, *(k for k in weights if not k.endswith("*"))})
    stems = sorted(k[:-1] for k in weights if k.endswith("*"))
    return Lexicon(terms, stems, [weights.get(t, 1.0) for t in terms] + [weights[s + "*"] for s in stems])


_SCORERS: dict[str, Scorer] = {}


def _scorer(lex: Lexicon) -> Scorer:
    key = repr((lex.terms, lex.stems, lex.weights))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lex)
    return _SCORERS[key]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out_remainder: int = 2) -> Lexicon:
    """Lexicon and model from labelled rows outside the held-out remainder.

    FIT_IDS labelled ids at most, those with the smallest hashes, bound the fit
    whatever the size of the tables, and LEARNT_ENTRIES the learnt part of the lexicon (those
    of the highest log-odds; TERMS come on top).  Half of the ids give the lexicon, the
    other half the model.  With fewer than five toxic texts in the first half nothing is
    learnt but TERMS; with fewer than ten rows of a class in the second the fixed
    coefficients PRIOR take the model's place, which every table of some size has rows enough to avoid.
    Null labels and ids take no part; an id that labels repeat is toxic if one says so;
    of rows that share an id one is used; null and empty texts are texts without words;
    empty tables give TERMS and PRIOR."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.filter(F.crc32(F.col("id").cast("string")) % 4 != held_out_remainder)
    picked = ids.orderBy(F.xxhash64("id"), "id").limit(FIT_IDS).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([tuple(r) for r in picked], ids.schema)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])  # FIT_IDS rows
    sample = sample.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).persist()
    lex = learn_lexicon(sample.filter("half = 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, _ = _scorer(lex).features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["toxic", "f"])

    rows = sample.filter("half = 1").select("toxic", "text").mapInArrow(run, "toxic int, f array<double>").collect()
    sample.unpersist()
    y = np.array([r[0] for r in rows], float)
    if len(rows) and min(y.sum(), len(y) - y.sum()) >= 10:
        lex.coefficients = fit_logistic(np.array([r[1] for r in rows]), y)
    else:
        lex.coefficients = PRIOR
    return lex


def score(docs: DataFrame, lex: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every whole text.

    Null and empty texts have no hits and get the score of that; a null id is
    not held out; repeated rows are scored each; other columns are ignored; an
    empty table gives no rows."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[doc_id], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, hits = _scorer(lex).features(batch.column(1))
            s = score_of(f, lex.coefficients)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(hits)], names=schema.names)

    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
    return docs.select(doc_id, text).mapInArrow(run, schema).select(doc_id, held.alias("held_out"), "score", "predicted", "n_hits")


def not_toxic(docs: DataFrame, lex: Lexicon, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts score below the threshold.

    Null and empty texts have no hits and stay; ids aren't looked at, so null and repeated ones change nothing; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    spot = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, _ = _scorer(lex).features(batch.column(spot))
            yield batch.filter(pa.array(score_of(f, lex.coefficients) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
