"""Repeated passages go whole, by comparison with brute force over all earlier places."""

import collections
import random
import re

from tessera.llm import paragraph_dedup

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def kept_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    spans = paragraph_dedup.repeats(docs)
    return {r.doc_id: r.text.split() for r in paragraph_dedup.without(docs, spans).collect()}


def repeated_earlier(texts, length):
    """For each text which words lie in a run of ``length`` words that an earlier place has too."""
    seen, out = set(), []
    for t in texts:
        w, gone = t.split(), set()
        for i in range(len(w) - length + 1):
            run = tuple(w[i : i + length])
            if run in seen:
                gone.update(range(i, i + length))
            seen.add(run)
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_inside_long_lines_go_whole(spark):
    rng = random.Random(51)
    texts = []
    for n in [51] * 20 + [45, 60, 75, 100]:
        passage = words(rng, n)
        # a part of it alone comes first, so that some windows have an earlier home than the passage
        part = " ".join(passage.split()[12:40])
        texts += [words(rng, 25) + " " + x + " " + words(rng, 30) for x in (part, passage, passage, passage)]
    got = kept_words(spark, texts)
    for i, want in enumerate(repeated_earlier(texts, 41)):
        if i % 4 > 1:
            assert got[i] == want, i


def wrapped(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_passages_in_short_lines_go_whole(spark):
    rng = random.Random(52)
    texts = []
    for n in [51] * 10 + [80]:
        passage = words(rng, n)
        texts += [words(rng, 25) + "\n" + wrapped(passage, 8) + "\n" + words(rng, 30), wrapped(words(rng, 40) + " " + passage, 11), wrapped(passage + " " + words(rng, 30), 7)]
    got = kept_words(spark, texts)
    for i, want in enumerate(repeated_earlier(texts, 41)):
        assert got[i] == want, i


def test_short_neighbouring_lines_are_one_paragraph():
    import numpy as np

    rng = random.Random(53)
    a, b, c = wrapped(words(rng, 30), 7), words(rng, 25), words(rng, 9)
    texts = [a + "\n" + b + "\n" + c + "\n", "", c, a.replace("\n", " "), "\n\n" + a + "\n \n" + c + "\n" + c]
    raw = [t.encode() for t in texts]
    t = paragraph_dedup.Lines(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert t.para.tolist() == [[0, 30], [30, 55], [73, 103], [103, 133]]
    sums = t.sums(t.para)
    assert sums[0] == sums[2] == sums[3] != sums[1]
    assert paragraph_dedup.Lines(np.zeros(0, np.uint8), np.zeros(1, np.int64)).para.shape == (0, 2)


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def paragraphs(text):
    """(first word, words) of lines of twenty words or more, and of shorter neighbouring ones together."""
    out, held, at = [], [], 0
    for line in [*text.split("\n"), ""]:
        w = re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER))
        if 0 < len(w) < 20:
            held += w
            at += len(w)
            continue
        if held:
            out.append((at - len(held), held))
            held = []
        if w:
            out.append((at, w))
        at += len(w)
    return [(a, w) for a, w in out if len(w) >= 20]


LOWER = {c: c + 32 for c in range(65, 91)}


def test_like_all_paragraphs_against_all(spark):
    """Over whole texts: what has an earlier paragraph of a similarity of 0.8 goes; nothing goes that has neither that nor an equal run of words elsewhere."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = paragraph_dedup.repeats(docs).collect()
    words_of = {i: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))] for i, t in rows}
    gone = {i: set() for i, _ in rows}
    for s in spans:
        gone[s.doc_id] |= {k for k, (a, b, _) in enumerate(words_of[s.doc_id]) if a >= s.first_byte and b <= s.last_byte}
    paras = [(i, a, len(w), shingles(w)) for i, t in rows for a, w in paragraphs(t)]
    root = list(range(len(paras)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for k, (*_, s) in enumerate(paras):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    for k, (*_, s) in enumerate(paras):
        shared = collections.Counter(o for x in s for o in by_shingle[x] if o < k)
        for o, n in shared.items():
            if n >= 0.8 * (len(s) + len(paras[o][3]) - n):
                a, b = sorted((top(o), top(k)))
                root[b] = a
    sizes = collections.Counter(top(k) for k in range(len(paras)))
    must = [p for k, p in enumerate(paras) if top(k) != k]
    found = sum(set(range(a, a + n)) <= gone[i] for i, a, n, _ in must)
    assert len(must) > 20 and found >= 0.99 * len(must)
    may = {i: set() for i, _ in rows}
    for k, (i, a, n, _) in enumerate(paras):
        if sizes[top(k)] > 1:
            may[i] |= set(range(a, a + n))
    runs = collections.Counter(tuple(x for *_, x in w[k : k + 20]) for w in words_of.values() for k in range(len(w) - 19))
    for i, w in words_of.items():
        for k in range(len(w) - 19):
            if runs[tuple(x for *_, x in w[k : k + 20])] > 1:
                may[i] |= set(range(k, k + 20))
    assert all(gone[i] <= may[i] for i in gone)
