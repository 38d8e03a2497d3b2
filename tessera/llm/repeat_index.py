"""Removal of byte strings of 200 that occur anywhere else, by run-compressed BWT indexes.

Every 200-byte string has an anchor: its 64-byte substring of least hash.  Equal
strings have equal anchors at equal distances, so only texts around anchors that
occur more than once can hold repeats.  The strings of one anchor place lie in
one segment.  Equal segments of an anchor are a class, of which one copy with its
number of places is indexed; classes are indexed by anchor in blocks.  A
multi-string BWT is built and held as runs with the suffix array sampled at the
run ends, and matching statistics are streamed along the text from these samples
(inside a run they fall by one from each position to the next); a string with
several copies also matches its copies up to its end.  Neighbouring segments of a text that only
their own copies share anchors with are indexed as one string.  Positions with a match of
200 bytes elsewhere are marked, in all places of the class.

An anchor with very many classes is split: strings whose bytes to the left of
the anchor number from a to b share a core, and equal strings have equal cores.
Segments become such parts, keyed by the core's hash, equal parts become classes
again, and cores that still have very many classes are split more finely; at last
a core is a whole string, which has one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow_text import flat, mix, powers, ranges, substring_hashes, _VALUE
from tessera.llm.buckets import ENTRY, exchange
from tessera.llm.runtime import key_filter, may_have, small_batches, trim, trimmed, written

LENGTH, GRAM = 200, 64
#: Candidate anchors of a string.
SPAN = LENGTH - GRAM + 1
PLACE_BITS = np.uint64(24)
#: Longer texts are hashed in slices of so many bytes (that overlap by LENGTH - 1).
SLICE = 8 << 20
#: Bytes of the segments that one index is built over.
BLOCK_BYTES = 1 << 19
#: Bytes of a text whose neighbouring segments may be indexed as one string.
STRETCH = 1 << 14
#: Classes of one anchor or core from which on it is split by finer cores, and the widths of these.
HOT_CLASSES, WIDTHS = 2_000, (34, 8, 1)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor places of texts: text number, first and last string start (in the text), the anchor's distance from the first, anchor hash, segment hash."""
    span = length - GRAM + 1
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    p, q = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[raw] * p[:n], out=total[1:])
    h = mix((total[GRAM:] - total[: n - GRAM + 1]) * q[: n - GRAM + 1])
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    owner = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
    start = np.arange(len(owner))
    ok = start + length <= offsets[text + 1]
    start, owner, text = start[ok], owner[ok], text[ok]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])))
    last = start[np.append(new[1:], len(start)) - 1]
    first, own, text = start[new], owner[new], text[new]
    end = last + length
    seg = mix((total[end] - total[first]) * q[first] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((own - first).astype(np.uint64)))
    base = offsets[text]
    return text, first - base, last - base, own - first, h[own], seg


def _slices(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """Anchors of runs of texts, long texts in slices: first text, first byte in it, anchors."""
    for a, b in ranges(offsets):
        size = int(offsets[b] - offsets[a])
        if size <= SLICE:
            yield a, 0, anchors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
            continue
        for at in range(0, size, SLICE):
            part = raw[offsets[a] + at : min(offsets[a] + at + SLICE + length - 1, offsets[b])]
            yield a, at, anchors(part, np.array([0, len(part)]), length)


def suffix_order(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix order of strings laid one after another, each with a terminator (a zero in
    ``text``) that is less than all letters; equal suffixes are ordered by string."""
    n = len(text)
    wide = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # letters to the string's end, with the terminator
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(k < left, wide[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    depth = 7
    done = (left <= depth)[order]
    new = np.append(True, (key[order][1:] != key[order][:-1]) | done[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    while True:
        start = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
        sizes = np.diff(np.append(start, n))
        if (sizes == 1).all():
            return order
        # only suffixes that are still equal to another are sorted on
        tied = np.repeat(sizes > 1, sizes)
        spots = np.flatnonzero(tied)
        who = order[spots]
        # a rank is the number of its first row, so that a tied group has room for its finer ranks
        head = np.repeat(start, sizes)
        rank[order] = head
        after = rank[np.minimum(who + depth, n - 1)]
        fine = np.argsort(head[spots] * n + after, kind="stable")
        order[spots] = who[fine]
        key2 = (head[spots] * n + after)[fine]
        ended = (left[order[spots]] <= 2 * depth)
        new = np.append(True, (key2[1:] != key2[:-1]) | ended[1:])
        rank[order[spots]] = spots[np.maximum.accumulate(np.where(new, np.arange(len(spots)), 0))]
        depth *= 2


class RunIndex:
    """BWT of many strings as runs, with the suffix array and the lengths of matches sampled at run ends."""

    def __init__(self, blobs: list[bytes], copies: np.ndarray):
        lengths = np.array([len(b) + 1 for b in blobs], np.int64)
        text = np.zeros(int(lengths.sum()), np.uint16)
        self.at = np.cumsum(lengths) - lengths
        letters = np.ones(len(text), bool)
        letters[self.at + lengths - 1] = False
        text[letters] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint16) + 1
        order = suffix_order(text, lengths)
        bwt = text[order - 1]  # the letter before; a terminator before the first letter of a string
        turn = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)  # terminators differ from one another
        self.runs = bwt[np.append(True, turn)]
        self.run_start = np.flatnonzero(np.append(True, turn))
        # samples: text positions at the first and last row of each run
        self.head, self.tail = order[self.run_start], order[np.append(self.run_start[1:], len(order)) - 1]
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text)) - 1
        self.text = text
        self.several = np.repeat(copies > 1, lengths)
        # length of the match with the row above a run's head and below a run's tail
        with_above = self._match(self.head[1:], self.tail[:-1])
        self.above = np.concatenate(([0], with_above))
        self.below = np.concatenate((with_above, [0]))

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at a and b have in common."""
        out = np.zeros(len(a), np.int64)
        live, room = np.arange(len(a)), np.minimum(self.left[a], self.left[b])
        step = 0
        while len(live):
            width = 8
            spots = step + np.arange(width)
            x, y = a[live][:, None] + spots, b[live][:, None] + spots
            top = len(self.text) - 1
            same = (self.text[np.minimum(x, top)] == self.text[np.minimum(y, top)]) & (spots < room[live][:, None])
            good = np.where(same.all(1), width, same.argmin(1))
            out[live] += good
            live = live[good == width]
            step += width
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position the longest match that starts elsewhere, streamed from the samples."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for spots, lengths in ((self.head, self.above), (self.tail, self.below)):
            value = np.full(n, -1, np.int64)
            value[spots] = lengths
            sampled = np.maximum.accumulate(np.where(value >= 0, np.arange(n), 0))
            best = np.maximum(best, np.where(value[sampled] >= 0, value[sampled] - (np.arange(n) - sampled), 0))
        # equal rows of the copies of a string would stand side by side; one of them is held
        return np.where(self.several, self.left, np.minimum(best, self.left))


def _spans_of(ok: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _index_block(length: int):
    """Runs of string starts (first, last; from a class' first start) of the classes of a block that occur elsewhere.

    A row is a text with one class or several neighbouring ones: keys, classes and their first starts in the text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # rows that are equal throughout give their classes more than once
        keys, classes, starts = (table[c].combine_chunks() for c in ("keys", "classes", "starts"))
        lead = keys.offsets.to_numpy()[:-1]
        pairs = np.stack((keys.values.to_numpy()[lead], classes.values.to_numpy()[lead]), 1)
        table = table.take(pa.array(np.sort(np.unique(pairs, axis=0, return_index=True)[1])))
        blobs, n = [b.as_buffer().to_pybytes() for b in table["segment"]], table["n"].to_numpy()
        keys, classes, starts = (table[c].combine_chunks() for c in ("keys", "classes", "starts"))
        del table
        index = RunIndex(blobs, n)
        del blobs
        count = np.diff(keys.offsets.to_numpy())
        begin = np.repeat(index.at, count) + starts.flatten().to_numpy()
        ms = index.matching_statistics() >= length  # never behind a string's last start, whose bytes end there
        cut = np.zeros(len(ms) + 1, bool)
        cut[begin] = True
        first = np.flatnonzero(ms & (cut[:-1] | ~np.append(False, ms[:-1])))
        last = np.flatnonzero(ms & (cut[1:] | ~np.append(ms[1:], False))) + 1
        of = np.searchsorted(begin, first, "right") - 1
        out = pa.table({"key": keys.flatten().take(pa.array(of)), "cls": classes.flatten().take(pa.array(of)), "first": first - begin[of], "last": last - begin[of]})
        del index, ms, cut
        trim()
        return out

    return run


def _in_blocks(classes: DataFrame, length: int) -> DataFrame:
    """key, cls, first, last: runs of string starts of the classes (keys, classes, starts, n, segment) that occur elsewhere among their key's."""
    total = classes.agg(F.sum(F.length("segment"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return classes.withColumn("block", F.pmod(F.xxhash64(F.element_at("keys", 1)), F.lit(blocks))).select("block", "keys", "classes", "starts", "n", "segment").groupBy("block").applyInArrow(_index_block(length), "key long, cls long, first long, last long")


PART = "key long, cls long, old_key long, old_cls long, shift long, n long, own int, segment binary"


def _split(classes: DataFrame, width: int, length: int) -> DataFrame:
    """Parts of the classes by cores of ``width`` distances to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cls, n, own = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for i, blob in enumerate(batch.column(4)):
                text = blob.as_buffer().to_pybytes()
                starts = len(text) - length + 1
                for a in range(0, length - GRAM + 1, width):
                    low, high = max(0, own[i] - a - width + 1), min(starts - 1, own[i] - a)
                    if low <= high:
                        core, part = text[own[i] - a : own[i] - a - width + 1 + length], text[low : high + length]
                        seed = (key[i] * 257 + a) & 0xFFFFFFFFFFFFFFFF
                        out.append((_signed(xxhash.xxh3_64_intdigest(core, seed)), _signed(xxhash.xxh3_64_intdigest(part, own[i] - low)), key[i], cls[i], low, n[i], own[i] - low, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PART_TYPES)], names=[f.split()[0] for f in PART.split(", ")])

    return classes.select("key", "cls", "n", "own", "segment").mapInArrow(trimmed(run), PART)


PART_TYPES = [pa.int64()] * 6 + [pa.int32(), pa.binary()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, first, last: byte spans (last is past the end) whose strings of ``length`` bytes occur elsewhere.

    ``docs`` has row (a binary key) and text; rows that share a key have equal texts."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "row binary, first long, last long, own int, anchor long, seg long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            for a, shift, (text, first, last, own, anchor, seg) in _slices(raw, offsets, length):
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + a)), pa.array(first + shift), pa.array(last + shift), pa.array(own, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))], names=["row", "first", "last", "own", "anchor", "seg"])

    placed = written(docs.select("row", "text").mapInArrow(trimmed(places), schema), "anchors")

    def entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        e = np.empty(batch.num_rows, ENTRY)
        e["key"], e["node"], e["size"], e["flag"] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), 1, 0
        yield e

    def repeated(e: np.ndarray) -> pa.Table:
        """Classes of the anchors that occur more than once: their places, and the classes of the anchor."""
        start = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1])) if len(e) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(e)))
        classes = np.repeat(n, n)
        ok = (classes > 1) | (e["size"] > 1)
        return pa.table({"anchor": e["key"][ok].view(np.int64), "seg": e["node"][ok], "n": e["size"][ok].astype(np.int64), "classes": classes[ok]})

    again = exchange(placed.select("anchor", "seg"), entries, repeated, "anchor long, seg long, n long, classes long", add=True)
    again = written(again, "repeated")
    met = written(placed.join(again.hint("shuffle_hash"), ["anchor", "seg"]), "met")
    one = met.groupBy("anchor", "seg").agg(F.min(F.struct("row", "first", "last", "own")).alias("x"), F.max("n").alias("n"), F.max("classes").alias("classes"))
    by_row = written(one.groupBy("x.row").agg(F.collect_list(F.struct("anchor", "seg", "n", "classes", "x.first", "x.last", "x.own")).alias("w")), "by-row")
    kept = key_filter(by_row.select(F.xxhash64("row").alias("key")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(kept.value, batch.column(2).to_numpy()))).select(["row", "text"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(0))
            w = batch.column(1)
            owner = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
            got = pa.RecordBatch.from_struct_array(w.flatten())
            order = np.lexsort((got["first"].to_numpy(), owner))
            owner, got = owner[order], got.take(pa.array(order))
            first, last, n, several = (got[c].to_numpy() for c in ("first", "last", "n", "classes"))
            # neighbours with no classes but their own copies stay together
            alone = (several == 1) & (n > 1)
            lead = np.ones(len(first), bool)
            lead[1:] = ~(alone[1:] & alone[:-1] & (owner[1:] == owner[:-1]) & (first[1:] == last[:-1] + 1) & (first[1:] // STRETCH == first[:-1] // STRETCH))
            a = np.flatnonzero(lead)
            b = np.append(a[1:], len(first))
            blobs = [raw[offsets[o] + x : offsets[o] + y + length].tobytes() for o, x, y in zip(owner[a].tolist(), first[a].tolist(), last[b - 1].tolist())]
            starts = first - np.repeat(first[a], b - a)
            bounds = pa.array(np.append(a, len(first)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (got["anchor"], got["seg"], pa.array(starts))]
            lowest = np.minimum.reduceat(n, a) if len(a) else n
            yield pa.RecordBatch.from_arrays([*lists, pa.array(lowest), pa.array(several[a]), got["own"].take(pa.array(a)), pa.array(blobs, pa.binary())], names=["keys", "classes", "starts", "n", "rivals", "own", "segment"])

    texts = docs.select("row", "text", F.xxhash64("row").alias("key")).mapInArrow(trimmed(some), "row binary, text string")
    # rows that share a key have one text, so any of them will do; a class that is fetched twice is a class once
    met_rows = texts.join(by_row.hint("shuffle_hash"), "row").select("text", "w")
    classes = written(met_rows.mapInArrow(trimmed(fetch), "keys array<long>, classes array<long>, starts array<long>, n long, rivals long, own int, segment binary"), "classes")
    cool, hot = F.col("rivals") <= HOT_CLASSES, F.col("rivals") > HOT_CLASSES
    marks = _in_blocks(classes.filter(cool), length).withColumnsRenamed({"key": "anchor", "cls": "seg"})
    members = None
    for width in WIDTHS:
        classes = classes.filter(hot).withColumn("key", F.element_at("keys", 1)).withColumn("cls", F.element_at("classes", 1)).dropDuplicates(["key", "cls"])
        if classes.isEmpty():
            break
        parts_ = written(_split(classes, width, length), "parts")
        own = parts_.select("key", "cls", "old_key", "old_cls", "shift").distinct()
        if members is None:
            own = own.select("key", "cls", F.col("old_key").alias("anchor"), F.col("old_cls").alias("seg"), "shift")
        else:
            old = members.select(F.col("key").alias("old_key"), F.col("cls").alias("old_cls"), "anchor", "seg", F.col("shift").alias("before"))
            own = own.join(old, ["old_key", "old_cls"]).select("key", "cls", "anchor", "seg", (F.col("shift") + F.col("before")).alias("shift"))
        members = written(own, "members")
        classes = parts_.groupBy("key", "cls").agg(F.sum("n").alias("n"), F.min("own").alias("own"), F.min("segment").alias("segment"))
        often = classes.groupBy("key").agg(F.count(F.lit(1)).alias("rivals"), F.sum("n").alias("places")).filter("places > 1").drop("places")
        one = [F.array("key").alias("keys"), F.array("cls").alias("classes"), F.array(F.lit(0).cast("long")).alias("starts")]
        classes = written(classes.join(often, "key").select(*one, "n", "rivals", "own", "segment"), "classes")
        found = _in_blocks(classes.filter(cool if width > 1 else F.lit(True)), length).join(members, ["key", "cls"])
        marks = marks.unionByName(found.select("anchor", "seg", (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))
    marks = written(marks, "marks")
    spans = met.select("row", "anchor", "seg", F.col("first").alias("at")).join(marks, ["anchor", "seg"])
    return spans.select("row", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") - 1 + length).alias("last"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts anywhere else too.

    Returns per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256; ``with_text`` adds kept (binary).  Strings are judged on the
    input, matches never cross texts, and overlaps count.  Null and empty texts
    have no bytes; shorter texts than ``length`` stay whole.  Rows with null or
    repeated ids count like others (two equal rows are copies of each other, so
    both are removed); other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "text"))))
    spans = repeated_spans(base, length).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = written(spans, "spans")
    fields = [T.StructField("doc_id", base.schema["doc_id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            w = batch.column(2)
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                removed = spans = 0
                if w[i].is_valid:
                    s = pa.RecordBatch.from_struct_array(w[i].values)
                    depth = np.zeros(len(text) + 1, np.int64)
                    np.add.at(depth, s["first"].to_numpy(), 1)
                    np.add.at(depth, s["last"].to_numpy(), -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = text[~gone].tobytes()
                else:
                    kept = text.tobytes()
                for c, v in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            cols = [batch.column(0)] + [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols[: len(fields)], names=[f.name for f in fields])

    joined = base.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(trimmed(run), T.StructType(fields))
