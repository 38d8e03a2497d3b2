"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

Symbols of many distinct words lie in one flat array.  In each round every
neighbouring pair inside a word is looked up by binary search over the sorted
pair keys; the pairs that have the lowest rank of their word are merged, and the
array is packed.  Very long words are merged one by one: their pairs lie in bins by
rank, so that a round touches only the places of its rank.  A worker keeps the words
it has encoded in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.runtime import small_batches

# Fixed value: the split pattern that byte-level vocabularies of this kind are made for.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker keeps, and their characters.
KEPT_WORDS, KEPT_CHARS = 300_000, 1 << 24
#: Bytes from which on a word is merged by itself, and ranks that one of its bins holds.
LONG_WORD, BIN = 4096, 256
NONE = np.int64(1 << 40)

#: In texts without these characters the standard library's classes agree with SPLIT's.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]")
PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+")


class Words(dict):
    """Numbers each word when it is first looked up."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self.chars += len(word)
        i = self[word] = len(self)
        return i


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start+size] of all rows, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_letters() -> list[str]:
    """The letter by which a vocabulary file writes each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    seen, spare, out = set(plain), 256, []
    for b in range(256):
        out.append(chr(b) if b in seen else chr(spare))
        spare += b not in seen
    return out


class Bpe:
    """A vocabulary file, its merges as sorted keys, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.span = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.split = regex.compile(SPLIT)
        texts = {i: bytes(value[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        n = max(texts) + 1
        self.token_len = np.array([len(texts.get(i, b"")) for i in range(n)], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(n)), np.uint8)
        self.decimal = [str(i) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known = Words()
        self.sizes = self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        for text in self.special:
            self.known[text]
        self._grow(np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def _grow(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.new.clear()
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.at = np.cumsum(self.sizes) - self.sizes

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rank of each pair (NONE if it has none) and the symbol it becomes."""
        key = left * self.span + right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.ranks[spot], NONE), self.joined[spot]

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given as byte symbols, flat, with each word's length."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_words = [], []
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.rank(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        while len(sym):
            first = np.append(True, word[1:] != word[:-1])
            starts = np.flatnonzero(first)
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            alive = lowest < NONE
            done_ids.append(sym[~alive])  # finished words leave the array
            done_words.append(word[~alive])
            run = np.flatnonzero(alive & (rank == lowest))
            # of overlapping equal pairs every second one counts, from the left
            fresh = np.append(True, np.diff(run) != 1)
            base = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - base) % 2 == 0]
            sym[run] = into[run]
            merged = np.zeros(len(sym), bool)
            merged[run] = True
            keep = alive
            keep[run + 1] = False
            sym, word, rank, into, merged = sym[keep], word[keep], rank[keep], into[keep], merged[keep]
            # only pairs with a new symbol have a new rank
            stale = np.flatnonzero(merged | np.append(merged[1:], False))
            last = np.append(word[1:] != word[:-1], True)[stale] if len(word) else stale
            rank[stale[last == 1]] = NONE
            stale = stale[last == 0]
            rank[stale], into[stale] = self.rank(sym[stale], sym[stale + 1])
        ids, owner = np.concatenate([*done_ids, sym]), np.concatenate([*done_words, word])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """Token ids of one word given as byte symbols.

        Neighbours are linked; places wait in bins of BIN ranks, and those of the lowest
        bin in lists by rank.  A place is looked at once for each rank that its pair gets."""
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, into = np.full(n, NONE), np.zeros(n, np.int64)
        rank[:-1], into[:-1] = self.rank(sym[:-1], sym[1:])
        bins: dict[int, list[np.ndarray]] = {}
        lists: dict[int, list[np.ndarray]] = {}
        order: list[int] = []  # heap of the ranks in lists
        now = -1

        def parts(places: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            by = np.argsort(keys, kind="stable")
            places, keys = places[by], keys[by]
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)]):
                yield int(keys[x]), places[x:y]

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            if len(places):
                soon = rank[places] // BIN <= now
                for key, group in parts(places[soon], rank[places[soon]]) if soon.any() else ():
                    if key not in lists:
                        heapq.heappush(order, key)
                    lists.setdefault(key, []).append(group)
                for key, group in parts(places[~soon], rank[places[~soon]] // BIN) if not soon.all() else ():
                    bins.setdefault(key, []).append(group)

        wait(np.arange(n - 1))
        while bins or order:
            if not order:
                now = min(bins)
                wait(np.concatenate(bins.pop(now)))
                continue
            lowest = heapq.heappop(order)
            run = np.unique(np.concatenate(lists.pop(lowest)))
            run = run[rank[run] == lowest]
            if not len(run):
                continue
            # of overlapping equal pairs every second one counts, from the left
            fresh = np.append(True, after[run[:-1]] != run[1:])
            base = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - base) % 2 == 0]
            gone = after[run]
            sym[run] = into[run]
            rank[gone] = NONE
            after[run] = after[gone]
            after[gone] = -1
            right = after[run]
            inside = right < n
            before[right[inside]] = run[inside]
            rank[run[~inside]] = NONE
            stale = np.unique(np.concatenate((run[inside], before[run][before[run] >= 0])))
            rank[stale], into[stale] = self.rank(sym[stale], sym[after[stale]])
            wait(stale)
        return sym[after >= 0]

    def learn(self) -> None:
        blobs = [w.encode("utf-8", "surrogatepass") for w in self.known.new]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        long = np.flatnonzero(size >= LONG_WORD).tolist()
        apart = {k: self.merge_long(self.first[np.frombuffer(blobs[k], np.uint8)]) for k in long}
        size[long] = 0
        data = np.frombuffer(b"".join(b for k, b in enumerate(blobs) if k not in apart), np.uint8)
        ids, counts = self.merge(self.first[data], size)
        if apart:
            at = np.cumsum(counts) - counts
            ids = np.insert(ids, np.repeat(at[long], [len(apart[k]) for k in long]), np.concatenate([apart[k] for k in long]))
            counts[long] = [len(apart[k]) for k in long]
        self._grow(ids, counts)

    def words(self, text: str) -> list[str]:
        split = self.split if ODD.search(text) else PLAIN_SPLIT
        if self.cut is None or not any(s in text for s in self.special):
            return split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += split.findall(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text."""
        if len(self.known) > KEPT_WORDS or self.known.chars > KEPT_CHARS:
            self.forget()
        pieces = [self.words(t) for t in texts]
        known = self.known.__getitem__
        which = [np.fromiter(map(known, p), np.int64, len(p)) for p in pieces]
        if self.known.new:
            self.learn()
        for w in which:
            yield gathered(self.ids, self.at[w], self.sizes[w])

    def names(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of the ids; ill-formed sequences become U+FFFD."""
        raw = gathered(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the id column, n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256; ``with_ids`` adds token_ids, ``with_text`` the
    decoded text.  A null text counts as empty (no tokens); null and repeated
    ids are kept as rows; other columns are ignored; an empty table gives none.
    ``vocabulary`` is a path that every worker can open."""
    small_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for ids in bpe.encode(texts):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(bpe.names(ids).encode()).hexdigest())
                    raw = bpe.decode(ids)
                    text_sha.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                    if with_text:
                        decoded.append(raw.decode())
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                cols += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(decoded, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
