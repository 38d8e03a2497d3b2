"""Document operators against brute force, with nulls, empty and long texts, repeats, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, jaccard_join, linking, paragraph_dedup, repeat_index, sharding, toxicity

SCHEMA = "doc_id long, text string, score double, node long, span_key string, label int"


def rows_of(texts, first=1):
    return [(first + i, t, 0.5, 7, "x", 1) for i, t in enumerate(texts)]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 90)) for _ in range(40)]
    passage = words(rng, 70)
    out = list(base)
    out += base[:6]  # exact copies
    for t in base[6:20]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [words(rng, 30) + " " + passage + " " + words(rng, 25) for _ in range(4)]
    out += [words(rng, 12) + "\n" + passage + "\n" + words(rng, 9), "", "   ", "a b", "A B", None, "é " * 200, "ab " * 400, words(rng, 6000), "UPPER lower Mixed words here now", "upper LOWER mixed words here now"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts) + [(1, texts[0], 0.1, 1, "y", 2), (None, "null id text " * 30, 0.1, 1, "y", 2), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def test_jaccard_join(docs, texts, empty):
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    sets = {i + 1: shingles(t) for i, t in enumerate(texts)}
    want = components_of(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_light_sets(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.choice(pool[:k]) for _ in range(rng.randint(4, 16))) for k in (2, 3, 4, 9) for _ in range(60)]
    for t in texts[:80]:
        w = t.split()
        texts.append(" ".join(w + ["end"]))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == components_of({i + 1: shingles(t) for i, t in enumerate(texts)})


def test_jaccard_long_lists(spark, monkeypatch):
    rng = random.Random(2)
    w = words(rng, 60).split()
    texts = []
    for i in range(45):  # one large group of near copies and some that only share half
        c = list(w) if i % 5 else w[:30] + words(rng, 30).split()
        c[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(c))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0.2)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == components_of({i + 1: shingles(t) for i, t in enumerate(texts)})


def test_needed_and_boundary():
    for n in range(1, 60):
        for m in jaccard_join.partners(n):
            c = jaccard_join.needed(n, m)
            assert 100 * c >= 80 * (n + m - c) and 100 * (c - 1) < 80 * (n + m - c + 1)
    assert jaccard_join.boundary({3: 1000, 200: 5}) >= 3


def removed(texts, length):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeat_index(docs, empty, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeat_index, "HOT_CLASSES", 1)
    got = repeat_index.without_repeats(docs).collect()
    all_ = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = collections.Counter()
    for (i, b), gone in zip(all_, removed([b for _, b in all_], 200)):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert repeat_index.without_repeats(empty).count() == 0


def test_run_index_on_small_strings():
    rng = random.Random(1)
    for _ in range(60):
        blobs = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 25))).encode() for _ in range(rng.randint(1, 7))]
        copies = np.array([rng.randint(1, 3) if k % 4 == 0 else 1 for k in range(len(blobs))])
        index = repeat_index.RunIndex(blobs, copies)
        ms = index.matching_statistics()
        assert len(index.runs) <= len(index.text)
        places = [(i, j) for i, b in enumerate(blobs) for j in range(len(b))]
        for i, j in places:
            best = 0
            for k, m in places:
                if (k, m) != (i, j):
                    n = 0
                    while j + n < len(blobs[i]) and m + n < len(blobs[k]) and blobs[i][j + n] == blobs[k][m + n]:
                        n += 1
                    best = max(best, n)
            assert ms[index.at[i] + j] == (len(blobs[i]) - j if copies[i] > 1 else best)


def test_long_texts_are_sliced(monkeypatch):
    raw = np.frombuffer(random.Random(5).randbytes(5000) * 2, np.uint8)
    whole = list(repeat_index._slices(raw, np.array([0, len(raw)]), 200))
    monkeypatch.setattr(repeat_index, "SLICE", 1500)
    parts = list(repeat_index._slices(raw, np.array([0, len(raw)]), 200))
    cover = lambda x: sorted(i for _, shift, (_, a, b, *_) in x for f, g in zip(a, b) for i in range(f + shift, g + shift + 1))
    assert cover(whole) == cover(parts) == list(range(len(raw) - 199))


def test_paragraph_dedup(docs, texts, empty):
    spans = paragraph_dedup.repeats(docs)
    got = {(r.doc_id) for r in spans.collect()}
    base, copies, inline = range(7, 21), range(41, 47), range(61, 65)
    assert set(i for i, n in zip(copies, texts[:6]) if len(n.split()) >= 20) <= got  # copies go, first places stay
    assert set(inline[1:]) <= got and inline[0] not in got and 65 in got
    assert not got & set(base)
    cut = {r.doc_id: r.text for r in paragraph_dedup.without(docs, spans).collect() if r.doc_id}
    assert len(cut) == len(texts) and paragraph_dedup.without(docs, spans).count() == docs.count()
    assert cut[7] == texts[6] and len(cut[62].split()) < 80
    assert paragraph_dedup.repeats(empty).count() == 0


def test_paragraph_jaccard_is_exact_on_pairs(spark):
    rng = random.Random(8)
    lines = [words(rng, 50) for _ in range(12)]
    near = []
    for k, line in enumerate(lines):
        w = line.split()
        for j in range(k % 6):
            w[(j * 9) % 50] = f"z{k}{j}"
        near.append(" ".join(w))
    got = {r.doc_id for r in paragraph_dedup.repeats(spark.createDataFrame(rows_of(lines + near), SCHEMA)).collect()}
    for k, (a, b) in enumerate(zip(lines, near)):
        x, y = shingles(a), shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            assert 13 + k in got


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame(
        [(1, "If Alice has 12 apples and gives 5 apples to Bob, then how many apples does Alice keep after 3 days?"), (2, "too short"), (3, None), (None, "a b c d e f g h i j"), (4, "five plain words of text")], "item_id long, text string"
    )
    asked = [
        "hello. If Carol has 77 apples and gives 9 apples to Dave, then how many apples does Carol keep after 8 weeks? ok",  # other slots
        "If Carol has 77 apples and gives 9 apples to Dave, then how many apples does Erin keep after 8 weeks?",  # one name maps to two
        "x if Alice has 12 apples and gives 5 apples to Bob, then how many apples does Alice keep after 3 days?",
        "if Alice has 12 apples", None, "", "here are FIVE plain words of text again", "five plain words of texts",
    ]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(spark.createDataFrame(rows_of(asked), SCHEMA), bench).collect()}
    assert got == {(1, 1, "reparameterised"), (3, 1, "exact"), (7, 4, "exact")}
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_decontaminate_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame(rows_of(["zero one two three four five six seven eight nine ten eleven", "other words"]), SCHEMA)
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 5)]


def test_bpe_round_trip(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    t = tokenizers.Tokenizer.from_file(path)
    got = bpe.encode_decode(docs, path, with_ids=True, with_text=True).collect()
    want = collections.Counter()
    for r in docs.collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        want[r.doc_id, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_on_very_long_words(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    t, own, rng = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path), random.Random(21)
    monkeypatch.setattr(bpe, "LONG_WORD", 64)
    letters = ["the", "ing", "a", "aa", "tion", "é", "ß", "x", "ABC", "日本"]
    texts = ["a" * 5001, "ab" * 3000, "".join(rng.choice(letters) for _ in range(9000)), "x " + "aaa" * 700 + " y " + "b" * 64 + "c" * 63, "=" * 3000 + "-" * 100, "word " * 50]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(60, 400))) for _ in range(40)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_time_follows_the_length():
    """One word of ten million letters takes seconds, not hours."""
    own, rng = bpe.Bpe(bpe.default_vocabulary()), np.random.default_rng(3)
    word = rng.integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    began = time.process_time()
    (ids,) = own.encode([word])
    assert own.decode(ids).decode() == word and time.process_time() - began < 120


def test_bpe_against_library_on_odd_text():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    t, b = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path)
    rng = random.Random(5)
    letters = "aabbcc  \n\t'sdtr1920.,!?é漢🙂ñ\x1c\x85\xa0²½_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|> x", "a" * rng.randint(0, 80)]) for _ in range(3000)]
    for s, ids, e in zip(texts, b.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids, s
        assert b.decode(ids).decode() == t.decode(e.ids, skip_special_tokens=False)


def test_minimax_cuts_are_least():
    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 12))), reverse=True)
        k = rng.randint(1, 5)
        c = collections.Counter(sizes)
        runs = sharding.Runs(sorted(c, reverse=True), [c[s] for s in sorted(c, reverse=True)])
        best = min(max(sum(sizes[a:b]) for a, b in zip(cut, cut[1:])) for cut in ([0, *x, len(sizes)] for x in _splits(len(sizes), k)))
        assert sharding.smallest_capacity(runs, k) == best
        at = [0, *sharding.cuts(runs, k), len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:])) == best


def _splits(n, k):
    import itertools

    return itertools.combinations_with_replacement(range(n + 1), k - 1)


def test_shards(docs, empty, texts):
    rows = sharding.minimax_shards(docs, 5).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(5))
    want = {i + 1: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    shard_of = {}
    for r in rows:
        if r.doc_id:
            assert (r.size, r.text_crc32) == want[r.doc_id] and r.law == "bytes" and r.grown_shard is None
            assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard
    assert sharding.minimax_shards(empty, 5).count() == 0


def test_shards_are_minimax(spark):
    """The largest shard is as small as any cut of the ordered groups allows; ids may be called as columns of the result are."""
    rng = random.Random(12)
    for shards in (1, 3, 7):
        texts = ["x" * rng.randint(0, 300) for _ in range(40)] + ["same text " * rng.randint(1, 20)] * rng.randint(1, 9) + [None] * 3
        rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 5 + [(None, "same")] * 4
        got = sharding.minimax_shards(spark.createDataFrame(rows, "shard_id long, size string"), shards, id_col="shard_id", text_col="size").collect()
        assert len(got) == len(rows)
        groups = collections.Counter()
        for _, t in rows:
            groups[t or ""] += len(t or "") + 16
        order = sorted(groups.values(), reverse=True)
        at = np.concatenate(([0], np.cumsum(order)))
        best = {(0, 0): 0}
        for k in range(1, shards + 1):  # least largest part of the first j groups in k shards
            for j in range(len(order) + 1):
                best[k, j] = min(max(best[k - 1, i], int(at[j] - at[i])) for i in range(j + 1) if (k - 1, i) in best)
        held, slots = collections.Counter(), collections.defaultdict(list)
        for r in got:
            held[r.shard] += r[1]
            slots[r.shard].append(r.slot)
        assert max(held.values()) == best[shards, len(order)]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = words(rng, 60).split()
        for _ in range(4 * bad):
            t.insert(rng.randrange(60), rng.choice(["you idiot", "stupid", "patheticc", "zorkle" + rng.choice(["ab", "xyz", "qqq"])]))
        rows.append(" ".join(t))
        labels.append((i + 1, int(bad), 1))
    table = spark.createDataFrame(rows_of(rows), SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    lex = toxicity.fit(table, lab)
    got = {r.doc_id: r for r in toxicity.score(table, lex).collect()}
    held = [i for i, *_ in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].predicted == int((i - 1) % 5 == 0) for i in held) >= 0.97 * len(held)
    odd = toxicity.score(docs, lex).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert toxicity.not_toxic(table, lex).columns == table.columns
    assert toxicity.score(empty, toxicity.fit(empty, lab.limit(0))).count() == 0


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    rng = random.Random(3)
    lex = toxicity.Lexicon(["idiot", "disgusting", "scum"], ["lowei"], [1.0] * 4)
    auto = toxicity.Automaton(lex)
    said = []
    for _ in range(3000):
        w = list(rng.choice(lex.terms + ["loweix", "hello"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(1, len(w)) if len(w) > 1 else 0
            w[i : i + rng.randint(0, 1)] = rng.choice(["", *"idotsgunck"])
        if w:
            said.append("".join(w))
    text = " ".join(said)
    classes = auto.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    start, end = toxicity.runs(classes > 0)
    hit, entry, edits = auto.match(classes, start, end)
    found = {int(i): (int(a), int(b)) for i, a, b in zip(hit, entry, edits)}
    for i, w in enumerate(said):
        near = [distance(w[1:], t[1:]) for t in lex.terms if t[0] == w[0] and distance(w[1:], t[1:]) <= toxicity.allowed_edits(t)]
        if w.startswith("lowei"):
            assert found[i] == (3, 0)
        else:
            assert (i in found) == bool(near) and (not near or found[i][1] == min(near)), w


def test_quoted_terms_have_their_own_sums():
    s = toxicity.Scorer(toxicity.Lexicon(["idiot"], [], [1.0]))
    import pyarrow as pa

    f, hits = s.features(pa.array(['he said "what an idiot" and left', "you are an idiot", "nothing", None]))
    quoted, reported, addressed = (toxicity.NAMES.index(n) for n in ("quoted", "reported", "addressed"))
    assert hits.tolist() == [1, 1, 0, 0]
    assert f[0, quoted] > 0 and f[0, reported] > 0 and f[1, quoted] == 0 and f[1, addressed] > 0


@pytest.mark.parametrize("tile", [1 << 16, 300])
def test_jaccard_many_near_copies(spark, monkeypatch, tile):
    """One long list whose members mostly link with their original, some only with one another and some with nothing."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 50, 130)
    rows = []
    for i in range(1500):
        w = base.copy()
        edits = (1, 2, 3, 4, 5)[i % 5]
        spots = rng.choice(130, edits, replace=False)
        w[spots] = rng.integers(50, 60 if i % 7 else 10_000, edits)
        rows.append(" ".join(f"v{x}" for x in (w if i % 11 else w[: 118 - i % 3])))
    monkeypatch.setattr(linking, "TILE_SHINGLES", tile)
    sets = [shingles(t) for t in rows]
    number = {x: k for k, x in enumerate(set().union(*sets))}
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    want = np.arange(len(rows))
    while (low := np.where(linked, want[None, :], len(rows)).min(1)).tolist() != want.tolist():
        want = low
    assert 0.05 < linked.mean() < 0.6 and len(set(want.tolist())) > 20
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()}
    assert got == {i + 1: int(c) + 1 for i, c in enumerate(want)}


def test_toxicity_on_held_out_documents(spark):
    """Whole table, fitted on what is not held out."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    bad, good = [r for r in scored if r.toxic == 1], [r for r in scored if r.toxic == 0]
    auc = sum((b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.95 and sum(r.predicted for r in bad) >= 0.75 * len(bad) and sum(r.predicted for r in good) <= 0.04 * len(good)
