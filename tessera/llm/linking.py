"""Components of sets that link by Jaccard similarity, from inverted lists of any length.

Short lists give their pairs.  The members of a long list are compared with its
head, the member that is in most lists (of many edited copies that is their common
original).  What that leaves outside of the head's component is compared through
differences: with D(s) the symmetric difference of s and the head, a set that is
not linked to the head can only link with sets whose differences share elements
with its own.  Its whole difference is indexed, and every other member probes with
so few elements of its own difference that a linking pair must meet in one of them.
Elements that edits brought in come first, so these lists are short; the members
of those that aren't short are compared in tiles of bounded size, which give a
spanning set of links and no pairs.  Nothing is dropped: every pair that shares a
list is compared, known to be connected, or proven not to link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import mix
from tessera.llm.buckets import exchange, groups_of
from tessera.llm.components import components
from tessera.llm.runtime import trimmed, written

#: Lists up to this length give all their pairs at once.
SHORT_LIST = 12
#: Shingles of either side of a tile.
TILE_SHINGLES = 1 << 16
#: Entry flags: LIGHT subsets, prefix shingles that only larger sets of a pair need (PROBED) or that both do (INDEXED); HOT keys are known to be in very many sets.
PROBED, INDEXED, LIGHT, HOT = 0, 1, 2, 4
FOUND = "a long, b long, kind long, size long, flag long"
PAIR, MEMBER = 0, 2
LOW = np.uint64(0xFFFFFFFF)
PROBE, INDEX = 1, 2
DIFFERENCE = np.dtype([("key", "<u8"), ("node", "<i8"), ("head", "<i8"), ("size", "<i4"), ("flag", "<i4")])


def _admissible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the smaller of two entries is indexed and the sizes can link."""
    swap = a["size"] > b["size"]
    small, large = np.where(swap, b["size"], a["size"]), np.where(swap, a["size"], b["size"])
    first = np.where(swap, b["flag"], a["flag"])
    same = small == large
    return (100 * small.astype(np.int64) >= percent * large.astype(np.int64)) & (first == INDEXED) & (~same | ((a["flag"] == INDEXED) & (b["flag"] == INDEXED)))


def _least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1 + np.minimum(n, m).astype(np.int64) // 20


def _summed(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs, how often each is given, and the least that it needs."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, least = low[order], high[order], least[order]
    new = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, np.int64)
    return low[new], high[new], np.diff(np.append(new, len(low))), least[new]


def receive(percent: int, counted: bool = True) -> Callable[[np.ndarray], pa.Table]:
    """What the lists of a bucket give: pairs (kind PAIR; size: shared keys, flag: keys that must be
    shared) and members of long lists (MEMBER; a: node, b: key).  A list of a HOT key
    may lie in several buckets and counts as long."""

    def reduce(entries: np.ndarray) -> pa.Table:
        open_: list[tuple] = []
        hot = entries["flag"] >= HOT
        long = [entries[hot]]
        for g in groups_of(entries[~hot]):
            if g["flag"][0] == LIGHT:
                # sets of the two sizes of the key link if they share it: each with the first of the other size
                low, high = g[g["size"] == g["size"].min()], g[g["size"] == g["size"].max()]
                one = np.ones(len(low) + len(high), np.int64)
                open_.append((np.append(low["node"], high["node"]), np.append(np.repeat(high["node"][:1], len(low)), np.repeat(low["node"][:1], len(high))), one))
            elif len(g) <= SHORT_LIST:
                i, j = np.triu_indices(len(g), 1)
                ok = _admissible(g[i], g[j], percent)
                i, j = i[ok], j[ok]
                open_.append((g["node"][i], g["node"][j], _least_common(g["size"][i], g["size"][j]) if counted else np.ones(len(i), np.int64)))
            else:
                long.append(g)
        a, b, times, least = _summed(*(np.concatenate(x) for x in zip(*open_))) if open_ else (np.zeros(0, np.int64),) * 4
        some = a != b
        a, b, times, least = a[some], b[some], times[some], least[some]
        m = np.concatenate(long)
        columns = zip((a, b, np.full(len(a), PAIR), times, least), (m["node"], m["key"].view(np.int64), np.full(len(m), MEMBER), m["size"], m["flag"]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["a", "b", "kind", "size", "flag"])

    return reduce


def count(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that really link; sets has node and s (packed 64-bit shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                r, s = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((r, s))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long")


def probes(size: int, difference: int, head_size: int, percent: int = 80) -> int:
    """Elements of a set's difference to the head, any, with one of which it must meet the
    difference of a set that links with it but not with the head.

    With q = (100 - p) / (100 + p), sets link if |A ^ B| <= q (|A| + |B|).  For B linked with
    A, and A not with the head H: 2 |DA & DB| >= |DA| + |DB| - q (|A| + |B|) > |DB| + q (|H| - |B|)."""
    shared = ((100 - percent) * (head_size - size) + (100 + percent) * difference) // (2 * (100 + percent)) + 1
    return max(0, min(difference, difference - shared + 1))


#: Members of a head whose lists of differences one bucket takes.
BUCKET_MEMBERS = 2_000


def _difference_entries(percent: int):
    """Entries of the differences of members to their heads; columns node, head, s, head's s, outside, members of the head.

    The upper half of a key is of the head and one of so many parts of its elements, so
    that a member is in few buckets and a large head in many."""

    def entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        node, head, outside, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4, 5))
        seed, of = node.view(np.uint64), mix(head.view(np.uint64))
        out, total = [], 0
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            r, s = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((r, s))
            order = np.argsort(both, kind="stable")
            both = both[order]
            single = np.ones(len(both), bool)
            same = both[1:] == both[:-1]
            single[1:] &= ~same
            single[:-1] &= ~same
            own = order[single] < len(r)
            d = both[single]
            # brought in first, then those that are missing in an order of the member's own, which spreads them over their lists
            d = d[np.lexsort((mix(d ^ seed[i]), ~own))]
            k = probes(len(r), len(d), len(s), percent)
            e = np.empty(len(d) if outside[i] else k, DIFFERENCE)
            h = mix(d[: len(e)] ^ of[i])
            part = of[i] + (h >> np.uint64(32)) % np.uint64(1 + n[i] // BUCKET_MEMBERS)
            e["key"] = (mix(part) & ~LOW) | (h & LOW)
            e["node"], e["head"], e["size"] = node[i], head[i], len(r)
            e["flag"] = INDEX if outside[i] else 0
            e["flag"][:k] |= PROBE
            out.append(e)
            total += len(e)
            if total > 200_000:
                yield np.concatenate(out)
                out, total = [], 0
        if out:
            yield np.concatenate(out)

    return entries


def _meet(entries: np.ndarray) -> pa.Table:
    """Pairs that meet in a short list of differences, and members (a: node, b: head, flag: role) of long ones."""
    pairs, long = [], []
    for g in groups_of(entries):
        index, probe = np.flatnonzero(g["flag"] & INDEX), np.flatnonzero(g["flag"] & PROBE)
        if not len(index) or not len(probe):
            continue
        if len(index) * len(probe) <= 4 * len(g):
            pairs.append((np.repeat(g["node"][index], len(probe)), np.tile(g["node"][probe], len(index))))
        else:
            long.append(g)
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    a, b, times, _ = _summed(a, b, np.ones(len(a), np.int64))
    some = a != b
    m = np.concatenate(long) if long else entries[:0]
    if len(m):
        m = m[np.lexsort((m["flag"], m["node"], m["head"]))]
        m = m[np.append(True, (m["node"][1:] != m["node"][:-1]) | (m["head"][1:] != m["head"][:-1]) | (m["flag"][1:] != m["flag"][:-1]))]
    columns = zip((a[some], b[some], np.full(some.sum(), PAIR), times[some], times[some]), (m["node"], m["head"], np.full(len(m), MEMBER), m["size"], m["flag"]))
    return pa.Table.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["a", "b", "kind", "size", "flag"])


def _tile(percent: int):
    """Links between the indexed and the probing sets of a tile, enough to connect what its links connect."""

    def run(table: pa.Table) -> pa.Table:
        node, index = table["node"].to_numpy(), table["index"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["s"]]
        rows, asking = np.flatnonzero(index), np.flatnonzero(~index.astype(bool))
        out: list[tuple[int, int]] = []
        if len(rows) and len(asking):
            n = np.array([len(sets[k]) for k in rows], np.int64)
            value, owner = np.concatenate([sets[k] for k in rows]), np.repeat(np.arange(len(rows)), n)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            root = np.arange(len(rows))
            for k in asking.tolist():
                s = sets[k]
                low, high = np.searchsorted(value, s, "left"), np.searchsorted(value, s, "right")
                length = high - low
                at = np.arange(int(length.sum())) + np.repeat(low - np.cumsum(length) + length, length)
                same = np.bincount(owner[at], minlength=len(rows))
                hit = np.flatnonzero(((100 + percent) * same >= percent * (n + len(s))) & (node[rows] != node[k]))
                if len(hit):
                    roots, first = np.unique(root[hit], return_index=True)
                    out += [(node[k], node[rows[hit[f]]]) for f in first.tolist()]
                    if len(roots) > 1:
                        root[np.isin(root, roots[1:])] = roots[0]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _in_tiles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members with role INDEX and members with role PROBE of the same head.

    Both roles of a head are dealt into blocks of some TILE_SHINGLES shingles."""
    index, probe = F.col("role").bitwiseAND(INDEX) != 0, F.col("role").bitwiseAND(PROBE) != 0
    blocks = lambda role: F.ceil(F.sum(F.when(role, F.col("size")).otherwise(0)) / TILE_SHINGLES).cast("int")
    dims = members.groupBy("head").agg(F.greatest(F.lit(1), blocks(index)).alias("rows"), F.greatest(F.lit(1), blocks(probe)).alias("columns"))
    dealt = members.join(dims, "head").join(sets, "node")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter(index).select("head", "node", "s", F.lit(1).alias("index"), own("rows", 1).alias("row"), all_of("columns").alias("column"))
    right = dealt.filter(probe).select("head", "node", "s", F.lit(0).alias("index"), all_of("rows").alias("row"), own("columns", 2).alias("column"))
    return left.unionByName(right).groupBy("head", "row", "column").applyInArrow(_tile(percent), "a long, b long")


def linked_components(found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, counted: bool = True) -> DataFrame:
    """node and component from the (written) rows of ``receive``; sets_of(nodes) gives node and s, the packed sets of the nodes asked for.

    Nodes without a link may be left out.  An empty table gives no rows."""
    met = found.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("size").alias("n"), F.max("flag").alias("least"))
    long = found.filter(F.col("kind") == MEMBER).select(F.col("a").alias("node"), F.col("b").alias("key"), "size")
    lists = long.groupBy("node").agg(F.count(F.lit(1)).alias("lists"), F.max("size").alias("size"))
    if counted:
        # keys that a pair shares in short lists are counted; in long lists it shares no more than either member has
        lists = written(lists, "lists")
        of_list = lambda name: lists.select(F.col("node").alias(name), F.col("lists").alias(f"{name}_lists"))
        met = written(met, "met")
        few = met.filter("n < least").join(of_list("a"), "a").join(of_list("b"), "b").filter(F.col("n") + F.least("a_lists", "b_lists") >= F.col("least"))
        short = met.filter("n >= least").select("a", "b").unionByName(few.select("a", "b"))
        smallest = F.ceil(F.lit(percent) * F.col("size") / 100)  # of the sets that can link with a member
        lists = lists.filter(F.col("lists") >= 1 + F.floor(smallest / 20))
    else:
        short = met.select("a", "b")
    often = long.join(lists.select("node", "lists"), "node")
    heads = often.groupBy("key").agg(F.max(F.struct("lists", F.xxhash64("node").alias("x"), "node", "size")).alias("h"))
    # written, so that the join by key has no grouping in its stage and Spark can split a long list
    heads = written(heads.select("key", F.col("h.node").alias("head"), F.col("h.size").alias("head_size")), "heads")
    members = often.join(heads, "key").filter("node <> head")
    members = written(members.select("head", "node", "size", "head_size").distinct(), "members")
    star = members.filter(100 * F.least("size", "head_size") >= percent * F.greatest("size", "head_size"))
    pairs = written(short.unionByName(star.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).unionByName(members.select(F.col("head").alias("node"))).distinct())
    links = written(count(pairs, sets, percent), "counted")
    parts_ = components(links, "a", "b")

    of = lambda name, to: parts_.select(F.col("node").alias(name), F.col("component").alias(to))
    placed = members.join(of("node", "x"), "node", "left").join(of("head", "y"), "head", "left")
    placed = placed.select("head", "node", (F.coalesce("x", "node") != F.coalesce("y", "head")).alias("outside"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("head").agg(F.max("outside").alias("mixed"), F.count(F.lit(1)).alias("n")).filter("mixed").select("head", "n")
    mixed = written(mixed, "mixed-heads")
    asked = written(placed.join(mixed, "head"), "mixed")
    if asked.isEmpty():
        return parts_
    both = asked.join(sets, "node").join(sets.select(F.col("node").alias("head"), F.col("s").alias("head_s")), "head").select("node", "head", "s", "head_s", "outside", "n")
    met = written(exchange(both, _difference_entries(percent), _meet, FOUND, dtype=DIFFERENCE), "differences")
    pairs = written(met.filter(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    tiled = met.filter(F.col("kind") == MEMBER).groupBy(F.col("b").alias("head"), F.col("a").alias("node")).agg(F.bit_or("flag").alias("role"), F.max("size").alias("size"))
    more = written(count(pairs, sets, percent).unionByName(_in_tiles(written(tiled, "tiled"), sets, percent)), "counted")
    if more.isEmpty():
        return parts_
    return components(parts_.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
