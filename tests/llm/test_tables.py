"""Operators on vectors, pages and conversations against brute force; components; the pipeline."""

import collections
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from tessera.llm import chat, embedding_dedup, queries, warc_zip
from tessera.llm.components import components
from tessera.llm.runtime import shared_dir, written


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("block,tile", [(4096, 512), (17, 5)])
def test_embeddings(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(240):
        v = base[i % 60] + (0 if i % 4 == 0 else rng.normal(size=16) * rng.choice([0.02, 0.06, 0.3]))
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3, "x"))
    rows += [(300, None, 1, "x"), (301, [0.0] * 16, 1, "x"), (302, [float("nan")] + [1.0] * 15, 1, "x"), (303, [None] + [1.0] * 15, 1, "x"), (304, rows[0][1], None, "x"), (305, [1.0, 2.0], 1, "x"), (306, [2.0, 4.0], 1, "x"), (307, [], 1, "x"), (None, rows[0][1], 0, "x")]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string")).collect()}
    assert len(got) == len(rows)
    ok = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    link = collections.defaultdict(set)
    for k, a in enumerate(ok):
        for b in ok[k + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                    link[a[0]].add(b[0])
                    link[b[0]].add(a[0])
    for i, r in got.items():
        assert r.n_links == len(link[i])
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        if i is not None:
            assert r.component_id == min(seen) and r.kept == (i == min(seen))


def test_embeddings_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (1, [0.0, 0.0, 1.0], 1), (3, [0.0, 0.0, 1.0], 1), (3, [0.0, 0.0, 1.0], 1), (4, [-0.0, 1.0, 0.0], 2), (5, [0.0, 1.0, 0.0], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    u = embedding_dedup.unit(rng.normal(size=(200, 64)) * 10.0 ** rng.integers(-100, 100, (200, 1)))
    q, f, e = embedding_dedup.quantised(u)
    near = (q.astype(float) * f[:, None]) @ (q.astype(float) * f[:, None]).T
    assert (np.abs(near - u @ u.T) <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-12).all()


def test_zip_directories():
    for wide in (False, True):
        data = [("a.txt", b"xyz"), ("dir/é.bin", b"12345" * 1000), ("empty", b"")]
        z = warc_zip.zip_bytes(data, zip64=wide)
        whole = zipfile.ZipFile(io.BytesIO(z))
        assert whole.testzip() is None and [whole.read(n) for n, _ in data] == [d for _, d in data]
        found = warc_zip.members(io.BytesIO(z), len(z))
        assert {n: z[a : a + k] for n, (a, k) in found.items()} == dict(data)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as f:
        f.writestr("stored", b"s" * 50)
        f.writestr("packed", b"p" * 500, zipfile.ZIP_DEFLATED)
        f.comment = b"note"
    z = packed.getvalue()
    assert list(warc_zip.members(io.BytesIO(z), len(z))) == ["stored"]
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"no zip"), 6)


def test_attempts_leave_each_others_archives_alone(spark, monkeypatch):
    """Two attempts at the same rows in different orders: what either has listed reads back whole."""
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 1500)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 30) for i in range(60)], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc-attempts"
    rows = warc_zip.marked(pages).coalesce(1)
    one, two = (written(warc_zip.write_archives(rows.sortWithinPartitions(order), folder), "archives") for order in ("page_id", "digest"))
    for listed in (one, two):
        got = warc_zip.read_records(warc_zip.locate_records(listed), with_payload=True).collect()
        assert sorted((int(r.page_key), bytes(r.payload).decode()) for r in got) == [(i, f"page {i} " * 30) for i in range(60)]
    assert one.join(two, "archive").count() == 0 and warc_zip.marked(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 2000)
    long = "<p>é" + "x" * 300
    rows = [(9, "http://a/ü b", long, 1), (4, None, long, 1), (5, "u", long, 1), (6, "u", "short", 1), (7, "u", "short", 1), (8, "u", None, 1), (10, "u", "", 1), (11, "u", "\r\n\r\n" * 60, 1), (None, "u", long + "y", 1)]
    rows += [(100 + i, f"http://x/{i}", f"page {i} " * 40, 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives = written(warc_zip.write_archives(warc_zip.marked(pages), f"{shared_dir(spark)}/warc-test"), "archives")
    assert archives.count() > 1
    got = {r.page_key: r for r in warc_zip.read_records(warc_zip.locate_records(archives), with_payload=True).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        r, b = got[None if i is None else str(i)], (html or "").encode()
        revisit = i in (9, 5)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_key) == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", "4" if revisit else None)
        assert revisit or bytes(r.payload) == b
    assert warc_zip.marked(pages.limit(0)).count() == 0
    none = written(warc_zip.write_archives(warc_zip.marked(pages.limit(0)), f"{shared_dir(spark)}/warc-none"), "archives")
    assert none.count() == 0 == warc_zip.read_records(warc_zip.locate_records(none)).count()
    # a page that is listed twice is written and read twice
    twice = written(warc_zip.write_archives(warc_zip.marked(pages.filter("page_id = 5").union(pages.filter("page_id = 5"))), f"{shared_dir(spark)}/warc-twice"), "archives")
    assert [(r.page_key, r.record_type) for r in warc_zip.read_records(warc_zip.locate_records(twice)).collect()] == [("5", "response")] * 2


def test_chat(spark):
    rng = random.Random(3)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, "user", None), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, 0, "assistant", "a"), (2, 1, "user", "tail"), (3, 0, "user", "only"), (4, 2, None, "x: y"), (4, 1, "a: b\\c", " </turn>\n"), (None, 1, "assistant", "n"), (5, None, "assistant", "é🙂")]
    rows += [(10 + i % 20, i, rng.choice(["user", "assistant", "system"]), "".join(rng.choice("\\#<>: /turn\nelhc") for _ in range(30))) for i in range(200)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    examples = chat.expand(turns)
    got = {r.conv_id: r for r in chat.digests(written(examples, "chat")).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, v in by.items():
        v.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in v)
        loss = "".join(x for *_, r, x in v if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(v), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.filter("loss_start is not null").count() == sum(r == "assistant" for _, _, r, _ in rows)
    assert chat.expand(turns.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, None, "en", "s", None)], docs.schema)).withColumn("span_key", docs["lang"]).withColumn("score", docs["n_chars"])
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, written(stage(spark, kept, "/root/testdata/sf0.001"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == before.columns and kept.schema == before.schema
            assert kept.count() <= before.count() and kept.filter("doc_id is null or doc_id > 10000").count() == 3
    assert kept.count() > 0
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, "/root/testdata/sf0.001"), name)
    assert empty.count() == 0


def test_pipeline_run_leaves_only_its_result(spark):
    import corpus_pipeline
    from tessera.llm import runtime

    before = runtime.written_so_far(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and runtime.written_so_far(spark) == before + 1
    assert runtime.clear(spark, before) == before


def test_queries_are_registered():
    names = queries.queries()
    assert {k.split("_")[0] for k in names} == {f"op{i}" for i in range(1, 11)} and len(names) == 10


def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions on what the stage before has kept, against brute force: links of all pairs, removals as subsequences, tokens of the library."""
    import corpus_pipeline
    import public_tokenizers
    from test_documents import components_of, shingles

    tokenizers = pytest.importorskip("tokenizers")
    at = "/root/testdata/sf0.001"
    kept, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, at), name)
        seen[name] = kept.collect()
    texts = {name: {r.doc_id: r.text or "" for r in rows} for name, rows in seen.items() if name != "bpe"}
    root = components_of({i: shingles(t) for i, t in texts["toxicity"].items()})
    assert set(texts["jaccard_join"]) == {i for i in root if root[i] == i} and all(texts["jaccard_join"][i] == texts["toxicity"][i] for i in texts["jaccard_join"])
    assert set(texts["paragraph_dedup"]) == set(texts["jaccard_join"]) and sum(map(len, texts["paragraph_dedup"].values())) < sum(map(len, texts["jaccard_join"].values()))
    for i, t in texts["paragraph_dedup"].items():
        rest = iter(texts["jaccard_join"][i].split())
        assert all(w in rest for w in t.split())
    assert set(texts["decontaminate"]) < set(texts["paragraph_dedup"])
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in seen["bpe"]} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts["decontaminate"].items()}
