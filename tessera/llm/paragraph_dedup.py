"""Removal of repeated paragraphs and passages by MinHash banding.

Every line of PARAGRAPH_WORDS words or more is a paragraph, and so are shorter
neighbouring lines together, up to a blank or longer line, if they have as many
words: its MinHash bands are exchanged, colliding paragraphs are joined, and pairs
count if the exact Jaccard similarity of their 5-word shingles is 0.8 or more.  So
that a passage set inside a longer paragraph or across lines is found too, every
text also has windows of WINDOW_WORDS words of its whole word sequence, beginning
where the words alone decide (least hash of each WINNOW neighbours), and equal
windows are repeats; any passage of WINDOW_WORDS + WINNOW + 1 words has one.
Clusters are connected components; all but the first place of a cluster are removed.  Windows are only seeds: within a
repeated passage they adjoin, and its first and last ones are less than WINNOW
words from its edges, so the outer windows of a removed run grow word by word as
far as the words equal those beside any earlier place of the same window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.arrow_text import combine, flat, mix, ranges, word_hashes, words
from tessera.llm.buckets import ENTRY, exchange
from tessera.llm.linking import FOUND, INDEXED, linked_components, receive
from tessera.llm.runtime import key_filter, may_have, parts, small_batches, trimmed, written

#: Words from which on a line, or shorter neighbouring lines together, are a paragraph.
PARAGRAPH_WORDS = 20
#: Words of a window; of so many neighbouring word triples the one of least hash begins a window.
WINDOW_WORDS, WINNOW = 20, 20
#: Adjoining removals of fewer words together are not made.
LEAST_REMOVED = 20
#: 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9992: the recall of pairs at a similarity of just 0.8.
BANDS, ROWS = 10, 3

_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64)
PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "doc_id", "text_no", "first_word", "last_word", "first_byte", "last_byte")])


class Lines:
    """Paragraphs and pieces of the texts raw[offsets[i]:offsets[i+1]]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        cut = np.flatnonzero(raw == 10) + 1
        bounds = np.unique(np.concatenate((offsets, cut)))
        self.start, self.end, self.line = words(raw, bounds)  # bounds end with len(raw)
        self.h = word_hashes(raw, self.start, self.end)
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        a, b = self.line[:-1], self.line[1:]
        short = (b > a) & (b - a < PARAGRAPH_WORDS)
        alone = ~short | np.isin(bounds[:-1], offsets)
        alone[1:] |= ~short[:-1]
        lead = np.flatnonzero(alone)
        a, b = a[lead], b[np.append(lead[1:], len(b)) - 1] if len(lead) else b[:0]
        self.para = np.stack((a, b), 1)[b - a >= PARAGRAPH_WORDS]

    def windows(self) -> np.ndarray:
        """Bounds (in words) of the windows, which may cross lines but not texts."""
        g = combine(self.h, 3)
        place = np.uint64((1 << max(24, len(g).bit_length())) - 1)  # the least hash's place is in its low bits
        low = (g & ~place) | np.arange(len(g), dtype=np.uint64)
        have = 1
        while have < WINNOW:
            step = min(have, WINNOW - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = np.arange(len(low))
        end = self.first[np.searchsorted(self.first, at, "right")]
        inside = at + WINNOW + 2 <= end
        start = (low[inside] & place).astype(np.int64)
        end = end[inside]
        new = np.append(True, start[1:] != start[:-1]) if len(start) else np.zeros(0, bool)
        start, end = start[new], end[new]
        start = start[start + WINDOW_WORDS <= end]
        return np.stack((start, start + WINDOW_WORDS), 1)

    def spans(self) -> np.ndarray:
        """Bounds of all paragraphs and windows."""
        return np.concatenate((self.para, self.windows()))

    def sums(self, spans: np.ndarray) -> np.ndarray:
        """A hash of the word sequence of each span."""
        if not len(spans):
            return np.zeros(0, np.uint64)
        n = spans[:, 1] - spans[:, 0]
        at = np.concatenate(([0], np.cumsum(n)))[:-1]
        pos = np.arange(int(n.sum())) - np.repeat(at, n)
        values = mix(self.h[np.repeat(spans[:, 0], n) + pos] + mix(pos.astype(np.uint64) + np.uint64(1)))
        return mix(np.add.reduceat(values, at) + n.astype(np.uint64))

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """Band keys of each paragraph (a row each), and its distinct shingles' number."""
        s, n = combine(self.h, 5), self.para[:, 1] - self.para[:, 0] - 4
        at = np.concatenate(([0], np.cumsum(n)))[:-1]
        flat_ = s[np.repeat(self.para[:, 0], n) + np.arange(int(n.sum())) - np.repeat(at, n)]
        keys = np.zeros((len(n), BANDS), np.uint64)
        for k in range(BANDS):
            h = np.full(len(n), k + 1, np.uint64)
            for r in range(k * ROWS, (k + 1) * ROWS):
                h = mix(h + np.minimum.reduceat((flat_ ^ _B[r]) * _A[r], at))
            keys[:, k] = h
        sizes = np.array([len(np.unique(flat_[a : a + m])) for a, m in zip(at.tolist(), n.tolist())], np.int64)
        return keys, sizes

    def shingles(self, span: tuple[int, int]) -> np.ndarray:
        return np.unique(combine(self.h[span[0] : span[1]], 5))


def _count_entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    raw, offsets = flat(batch.column(0))
    for a, b in ranges(offsets):
        t = Lines(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key, n = np.unique(t.sums(t.spans()), return_counts=True)
        e = np.zeros(len(key), ENTRY)
        e["key"], e["size"] = key, n
        yield e


def _repeated(e: np.ndarray) -> pa.Table:
    return pa.table({"node": e["key"][e["size"] > 1].view(np.int64)})


def _places(docs: DataFrame, wanted) -> DataFrame:
    """Where each paragraph and window is whose hash may be in ``wanted``: node (hash of its words), doc_id, text_no, words and bytes within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            ids, numbers = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b in ranges(offsets):
                t = Lines(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                spans = t.spans()
                node = t.sums(spans).view(np.int64)
                ok = may_have(wanted.value, node)
                spans, node = spans[ok], node[ok]
                if not len(node):
                    continue
                doc = np.searchsorted(t.first, spans[:, 0], "right") - 1
                base, byte = t.first[doc], t.offsets[doc]
                cols = [node, ids[doc + a], numbers[doc + a], spans[:, 0] - base, spans[:, 1] - base, t.start[spans[:, 0]] - byte, t.end[spans[:, 1] - 1] - byte]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=PLACE.names)

    return docs.mapInArrow(trimmed(run), PLACE)


BESIDE = T.StructType([*PLACE.fields[:3], *(T.StructField(n, T.LongType()) for n in ("side", "word", "byte", "bucket")), T.StructField("h", T.BinaryType()), T.StructField("at", T.BinaryType())])
LEFT, RIGHT = 0, 1


#: Places of windows that a task gathers before it sends them.
GATHERED = 80_000


class _Beside:
    """Words beside windows: node, doc and text, side, the edge's word and byte, hashes and byte bounds from the edge outwards."""

    def __init__(self, node, doc, text, side, word, byte, h, at):
        self.columns = [node, doc, text, side, word, byte, h, at]
        self.node, self.doc, self.text, self.side, self.word, self.byte, self.h, self.at = self.columns

    def take(self, spots) -> "_Beside":
        return _Beside(*[c[spots] for c in self.columns])

    @staticmethod
    def join(parts: list["_Beside"]) -> "_Beside":
        return _Beside(*[np.concatenate(c) for c in zip(*[p.columns for p in parts])])

    def sorted(self) -> "_Beside":
        """By node, side and words, equal ones by place."""
        return self.take(np.lexsort((self.word, self.text, self.doc, *(self.h[:, k] for k in range(WINNOW - 2, -1, -1)), self.side, self.node)))

    def grown(self, by: np.ndarray) -> list[np.ndarray]:
        """doc_id, text_no, first and last word, first and last byte of what the windows gain by so many words each."""
        some = by > 0
        g, by = self.take(some), by[some]
        last = g.at[np.arange(len(by)), by - 1] if len(by) else g.byte
        right = g.side == RIGHT
        return [g.doc, g.text, np.where(right, g.word, g.word - by), np.where(right, g.word + by, g.word), np.where(right, g.byte, last), np.where(right, last, g.byte)]


def _beside(docs: DataFrame, wanted, n_buckets: int) -> DataFrame:
    """Up to WINNOW - 1 words beside each window asked for, and what windows gain that a task can tell itself.

    ``wanted`` holds the node where its left side is asked for, its complement for the
    right side.  Of places with equal words a task sends only its first: the others
    gain all these words (rows without h), so that a passage that very many places
    share comes once from each task."""
    reach = np.arange(WINNOW - 1)

    def read(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> Iterator[_Beside]:
        t = Lines(raw, offsets)
        spans = t.windows()
        nodes = t.sums(spans).view(np.int64)
        for side in (LEFT, RIGHT):
            ok = may_have(wanted.value, ~nodes if side else nodes)
            edge, node = spans[ok, side], nodes[ok]
            doc = np.searchsorted(t.first, spans[ok, 0], "right") - 1
            n = t.first[doc + 1] - edge if side else edge - t.first[doc]
            some = n > 0
            edge, node, doc, n = edge[some], node[some], doc[some], n[some]
            if not len(node):
                continue
            word = edge[:, None] + reach if side else edge[:, None] - 1 - reach
            held = reach < n[:, None]
            word = np.where(held, word, 0)
            base, byte = t.first[doc], t.offsets[doc]
            h = np.where(held, t.h[word], np.uint64(0))
            at = np.where(held, (t.end if side else t.start)[word] - byte[:, None], -1)
            start = t.end[edge - 1] if side else t.start[edge]
            yield _Beside(node, ids[doc], numbers[doc], np.full(len(node), side), edge - base, start - byte, h, at)

    def sent(held: list[_Beside]) -> Iterator[pa.RecordBatch]:
        b = _Beside.join(held).sorted()
        new = np.append(True, (b.node[1:] != b.node[:-1]) | (b.side[1:] != b.side[:-1]) | (b.h[1:] != b.h[:-1]).any(1))
        rest = b.take(~new)
        doc, text, w0, w1, b0, b1 = rest.grown((rest.at >= 0).sum(1))
        none = pa.array([b""] * len(doc), pa.binary())
        bucket = (mix(doc.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (w1, doc, text, b0, w0, b1, bucket)] + [none, none], names=BESIDE.names)
        b = b.take(new)
        # only equal first words can go on, so they choose the bucket
        bucket = (mix(b.node.view(np.uint64) ^ mix(b.h[:, 0] + b.side.astype(np.uint64))) % np.uint64(n_buckets)).astype(np.int64)
        cols = [pa.array(np.asarray(c, np.int64)) for c in (b.node, b.doc, b.text, b.side, b.word, b.byte, bucket)]
        cols += [pa.array([row.tobytes() for row in m], pa.binary()) for m in (b.h, b.at.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=BESIDE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            ids, numbers = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b in ranges(offsets):
                for part in read(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], numbers[a:b]):
                    held.append(part)
                    total += len(part.node)
            if total >= GATHERED:
                yield from sent(held)
                held, total = [], 0
        if held:
            yield from sent(held)

    return docs.mapInArrow(trimmed(run), BESIDE)


def _grown(t: pa.Table) -> pa.Table:
    """The words by which each place's window grows: as many as equal those beside an earlier place."""
    t = t.combine_chunks()
    whole = t.filter(pa.compute.equal(pa.compute.binary_length(t["h"]), 0))  # told by the task: last word, document and text, first byte, first word, last byte
    t = t.filter(pa.compute.greater(pa.compute.binary_length(t["h"]), 0)).combine_chunks()
    node, doc, text, side, word, byte = (t[n].to_numpy() for n in ("node", "doc_id", "text_no", "side", "word", "byte"))
    h, at = (np.frombuffer(flat(t[n])[0], kind).reshape(len(node), WINNOW - 1) for n, kind in (("h", np.uint64), ("at", np.int64)))
    b = _Beside(node, doc, text, side, word, byte, h, at)
    by_place = np.lexsort((word, text, doc))
    later = (doc[by_place[1:]] != doc[by_place[:-1]]) | (text[by_place[1:]] != text[by_place[:-1]]) | (word[by_place[1:]] != word[by_place[:-1]])
    rank = np.empty(len(node), np.int64)
    rank[by_place] = np.concatenate(([0], np.cumsum(later))) if len(node) else 0
    order = np.lexsort((*(h[:, k] for k in range(WINNOW - 2, -1, -1)), side, node))
    b, rank = b.take(order), rank[order]
    by = np.zeros(len(node), np.int64)
    if len(node):
        new = np.append(True, (b.node[1:] != b.node[:-1]) | (b.side[1:] != b.side[:-1]))
        for k in range(WINNOW - 1):
            new[1:] |= b.h[1:, k] != b.h[:-1, k]
            first = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            by += (rank > first) & (b.at[:, k] >= 0)
    told = [whole[n].to_numpy() for n in ("doc_id", "text_no", "word", "node", "side", "byte")]
    names = ("doc_id", "text_no", "first_word", "last_word", "first_byte", "last_byte")
    return pa.table({n: np.concatenate((x, np.asarray(y, np.int64))) for n, x, y in zip(names, told, b.grown(by))})


def _band_entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    raw, offsets = flat(batch.column(0))
    for a, b in ranges(offsets):
        t = Lines(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if not len(t.para):
            continue
        keys, sizes = t.bands()
        node, first = np.unique(t.sums(t.para).view(np.int64), return_index=True)
        e = np.empty(len(node) * BANDS, ENTRY)
        e["key"], e["node"], e["size"], e["flag"] = keys[first].ravel(), np.repeat(node, BANDS), np.repeat(sizes[first], BANDS), INDEXED
        yield e


def repeats(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans to remove: one row per removed run of words.

    Returns doc_id, text_no (a hash of the text, as rows may share an id), first_byte and last_byte (bounds in
    the UTF-8 text), n_words and kept_doc_id (smallest document that keeps a copy of part of the run).  Of
    each cluster the place with the smallest (doc_id, text_no, position) stays, so every
    repeated text keeps one copy.  Rows with a null id take no part; rows that
    share an id and have different texts are documents of their own, those with equal ones count as one; null, empty and short texts have no
    paragraphs; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_no", F.xxhash64("text"))
    body = texts.select("text")
    repeated = written(exchange(body, _count_entries, _repeated, "node long", add=True), "repeated")
    found = written(exchange(body, _band_entries, receive(percent, counted=False), FOUND), "collisions")
    colliding = found.select(F.col("a").alias("node")).union(found.filter("kind < 2").select("b"))
    places = written(_places(texts, key_filter(repeated.union(colliding))), "places")
    nodes = written(places.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_no", "first_word", "last_word")).alias("home")), "nodes")

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = asked.join(nodes, "node")
        asked = written(asked.groupBy(F.col("home.doc_id").alias("doc_id"), F.col("home.text_no").alias("text_no")).agg(F.collect_list(F.struct("node", "home.first_word", "home.last_word")).alias("asked")), "asked")
        wanted = key_filter(asked.select("doc_id"))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_have(wanted.value, batch.column(0).to_numpy())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = flat(batch.column(0))
                node, packed = [], []
                for i, wanted in enumerate(batch.column(1).to_pylist()):
                    part = raw[offsets[i] : offsets[i + 1]]
                    t = Lines(part, np.array([0, len(part)]))
                    for w in wanted:
                        node.append(w["node"])
                        packed.append(t.shingles((w["first_word"], w["last_word"])).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(packed, pa.binary())], names=["node", "s"])

        met = texts.mapInArrow(some, texts.schema).join(asked.hint("shuffle_hash"), ["doc_id", "text_no"]).select("text", "asked")
        return written(met.mapInArrow(trimmed(run), "node long, s binary"), "sets")

    linked = linked_components(found, sets_of, percent, counted=False)
    again = nodes.join(linked, "node", "left").filter((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("cluster", F.coalesce("component", "node"))
    again = written(again.select("node", "cluster", "home"), "repeated")
    homes = again.groupBy("cluster").agg(F.min("home").alias("home"))
    marked = places.join(again.select("node", "cluster").join(homes, "cluster"), "node")
    marked = marked.filter((F.col("doc_id") != F.col("home.doc_id")) | (F.col("text_no") != F.col("home.text_no")) | (F.col("first_word") != F.col("home.first_word")))
    marked = written(marked.select("node", "doc_id", "text_no", "first_word", "last_word", "first_byte", "last_byte", F.col("home.doc_id").alias("kept_doc_id")), "marked")

    def in_runs(spans: DataFrame) -> DataFrame:
        """Adjoining and overlapping removals of a document become one run."""
        order = Window.partitionBy("doc_id", "text_no").orderBy("first_word", "last_word")
        before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return spans.withColumn("new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))

    run = Window.partitionBy("doc_id", "text_no", "run")
    outer = in_runs(marked).select("node", "first_word", "last_word", F.min("first_word").over(run).alias("a"), F.max("last_word").over(run).alias("b"))
    outer = outer.filter(F.col("last_word") - F.col("first_word") == WINDOW_WORDS)
    left, right = outer.filter(F.col("first_word") - F.col("a") < WINNOW - 1), outer.filter(F.col("b") - F.col("last_word") < WINNOW - 1)
    asked_sides = written(left.select("node").union(right.select(F.bitwise_not("node"))).distinct(), "sides")
    beside = _beside(texts, key_filter(asked_sides), 4 * parts(docs.sparkSession))
    grown = beside.groupBy("bucket").applyInArrow(_grown, "doc_id long, text_no long, first_word long, last_word long, first_byte long, last_byte long")
    joined = in_runs(marked.drop("node").unionByName(grown, allowMissingColumns=True))
    out = joined.groupBy("doc_id", "text_no", "run").agg(F.min("first_byte").alias("first_byte"), F.max("last_byte").alias("last_byte"), (F.max("last_word") - F.min("first_word")).alias("n_words"), F.min("kept_doc_id").alias("kept_doc_id"))
    return out.filter(F.col("n_words") >= LEAST_REMOVED).drop("run")


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the spans cut out of their texts; nothing else changes.

    Rows without spans stay as they are, null and empty texts too; of rows that share an id those with the text that the
    spans are of are cut, rows of a null id never; columns may have any names; an empty table on either side is as it says."""
    key, number, held = (next(n for n in (f"{stem}_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for stem in ("span_key", "span_text", "span_cuts"))
    cuts = spans.groupBy(F.col("doc_id").alias(key), F.col("text_no").alias(number)).agg(F.array_sort(F.collect_list(F.struct("first_byte", "last_byte"))).alias(held))
    joined = docs.join(cuts.hint("shuffle_hash"), (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(number)), "left").drop(key, number)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = names.index(text_col)
        for batch in batches:
            texts = batch.column(spot).to_pylist()
            for i, cut in enumerate(batch.column(len(names)).to_pylist()):
                if cut and texts[i]:
                    raw, out, at = texts[i].encode(), [], 0
                    for c in cut:
                        out.append(raw[at : c["first_byte"]])
                        at = c["last_byte"]
                    texts[i] = b"".join([*out, raw[at:]]).decode(errors="replace")
            columns = list(batch.columns[: len(names)])
            columns[spot] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return joined.mapInArrow(trimmed(run), docs.schema)
