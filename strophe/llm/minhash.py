"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature keeps b = 16 bits of each of chunks x width min-hashes. Two signatures are at a
distance d, the number of min-hashes that differ. Cut into `chunks` chunks, two signatures with
d <= 2 * chunks - 1 have, by pigeonhole, a chunk with at most one error; every chunk is therefore
entered once for each min-hash left out of it, and all pairs within that distance meet under a common
key. Pairs that meet at a larger distance are verified as well, never cut. Texts with the same shingle
set are one class from the start. Under a key, every member is first compared with a leader, the member
that meets most others. Keys that then hold one component are done. The members of the others are
compared by prefixes: in an order of items by rarity, two sets over the threshold share one of the first
(1 - threshold) * size + 1 items of each, so sets that share none of these cannot link. Sets with such
items in common are dealt into blocks, and blocks are compared in one matrix product each, which gives a
forest of the links found; blocks that one component fills aren't compared with each other. So no link
between different sets is lost, and a group's pairs are not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import frames
from strophe.llm import words as W
from strophe.llm.graph import connected_components
from strophe.llm.store import Workspace

CHUNKS, WIDTH = 9, 5
#: Sets and items of a block of the exact comparison, and sets from which a component has blocks of its own.
BLOCK_SETS, BLOCK_ITEMS, OWN_BLOCKS = 256, 200_000, 64
SET_SALTS = (0x51ED270B35D4F1A7, 0x2545F4914F6CDD1D)


def _constants(n: int, seed: int) -> np.ndarray:
    return W.mix(np.arange(1, n + 1, dtype=np.uint64), seed)


def signatures(sets: W.ShingleSets, rows: np.ndarray, k: int) -> np.ndarray:
    """k 16-bit min-hashes of the non-empty sets in rows."""
    low = (sets.values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(rows), k), np.uint16)
    flips = (_constants(k, 11) >> np.uint64(32)).astype(np.uint32)
    times = (_constants(k, 23) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    starts = sets.offsets[:-1][rows]
    for i in range(k):
        v = (low ^ flips[i]) * times[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(v, starts)
        least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
        out[:, i] = (least >> np.uint32(16)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunks: int, width: int) -> np.ndarray:
    """(rows, chunks * width) keys: each chunk with each one of its min-hashes left out."""
    out = np.empty((len(sig), chunks * width), np.int64)
    salts = _constants(chunks * width, 37)
    for c in range(chunks):
        part = sig[:, c * width : (c + 1) * width].astype(np.uint64)
        for j in range(width):
            packed = np.zeros(len(sig), np.uint64)
            for t in range(width):
                if t != j:
                    packed = W.mix(packed) ^ part[:, t] if width > 5 else (packed << np.uint64(16)) | part[:, t]
            out[:, c * width + j] = W.mix(packed, int(salts[c * width + j])).view(np.int64)
    return out


def _sign(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("minhash")
        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(1)):
                sets = W.shingle_sets(W.split_words(W.lower_ascii(buf), offsets), n)
                sizes = sets.sizes()
                full = np.flatnonzero(sizes)
                sig = np.zeros((j - i, k), np.uint16)
                if len(full):
                    sig[full] = signatures(sets, full, k)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * k), j - i, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                h = [pa.array(sets.sums(s).view(np.int64)) for s in SET_SALTS]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(sizes), *h, packed], names=["doc_id", "text_key", "n_shingles", "h1", "h2", "sig"])

    return run


def _enter(chunks: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("minhash")
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, chunks * width)
            keys = chunk_keys(sig, chunks, width)
            again = (pa.array(np.repeat(b.column(c).to_numpy(), keys.shape[1])) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *again], names=["key", "id", "n"])

    return run


def _gather(n: int):
    """Sets of the wanted classes; a class is given once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("minhash")
        seen: set[int] = set()
        for b in batches:
            want = {c: b.column(c + 1).to_numpy() for c in range(3)}
            for i, j, buf, offsets in W.pieces(b.column(0)):
                sets = W.shingle_sets(W.split_words(W.lower_ascii(buf), offsets), n)
                ids, (h1, h2) = want[0][i:j], (sets.sums(s).view(np.int64) for s in SET_SALTS)
                rows = [r for r in np.flatnonzero((h1 == want[1][i:j]) & (h2 == want[2][i:j])).tolist() if ids[r] not in seen and not seen.add(ids[r])]
                if rows:
                    parts = [sets.values[sets.offsets[r] : sets.offsets[r + 1]] for r in rows]
                    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))], names=["id", "items"])

    return run


def _verify(work: Workspace, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the linked ones among pairs of ids a, b."""
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    looked = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("n"))
    return work.save(looked.where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _block_pairs(percent: int):
    """Links between the sets of two blocks that join different components, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("minhash")
        for b in batches:
            for r in range(b.num_rows):
                sides = []
                for c in (0, 1):
                    rows = b.column(c).slice(r, 1).flatten()
                    items = rows.field("items")
                    sides.append((rows.field("id").to_numpy(), rows.field("g").to_numpy(), np.diff(items.offsets.to_numpy()), items.flatten().to_numpy()))
                edges = list(_forest(*sides, percent))
                if edges:
                    src, dst = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _forest(x: tuple, y: tuple, percent: int) -> Iterator[tuple[int, int]]:
    (ia, ga, na, va), (ib, gb, nb, vb) = x, y
    _, at = np.unique(np.r_[va, vb], return_inverse=True)
    ca, cb = at[: len(va)], at[len(va) :]
    shared = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    shared[np.intersect1d(ca, cb)] = 1
    column = np.cumsum(shared) - 1
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ka, kb = shared[ca] > 0, shared[cb] > 0
    ra, ca, rb, cb = ra[ka], column[ca[ka]], rb[kb], column[cb[kb]]
    both = np.zeros((len(na), len(nb)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        one, two = np.zeros((len(na), 4096), np.float32), np.zeros((len(nb), 4096), np.float32)
        for m, rows, cols in ((one, ra, ca), (two, rb, cb)):
            k = (cols >= c) & (cols < c + 4096)
            m[rows[k], cols[k] - c] = 1
        both += one @ two.T
    linked = (both * 100 >= (na[:, None] + nb[None] - both) * percent) & (ga[:, None] != gb[None])
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = g = root.get(root[g], root[g])
        return g

    for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
        g, h = find(int(ga[i])), find(int(gb[j]))
        if g != h:
            root[max(g, h)] = min(g, h)
            yield int(ia[i]), int(ib[j])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(item, id, g, n) of the items that sets (id, g, items) must be compared by.

    Items are ordered by how many of the sets have them. Of two linked sets each has at least
    percent * n / 100 items of the other, so its first n - that + 1 items hold a common one. Items of a single set come
    first in the order and meet nothing: they take their places in the prefix, but make no rows.
    """
    each = sets.select("id", F.explode("items").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    ranked = each.join(shared, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("s"))
    ranked = ranked.join(sets.select("id", "g", F.size("items").alias("n")), "id")
    places = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1 - (F.col("n") - F.size("s"))
    return ranked.where(places > 0).select("id", "g", "n", F.explode(F.slice("s", 1, F.greatest(F.lit(1), places))).alias("x")).select(F.col("x.item").alias("item"), "id", "g", "n")


def _list_edges(work: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components g among sets (id, g, items).

    The sets of a prefix item are its list. Sets that lists of several components connect are dealt into
    blocks, those of a large component apart, and blocks with a common list are compared.
    """
    listed = _prefixes(sets, percent)
    open_ = listed.groupBy("item").agg(F.min("id").alias("first"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1")
    listed = work.save(listed.join(open_.select("item", "first"), "item"))
    clusters = connected_components(work, listed.select(F.col("id").alias("src"), F.col("first").alias("dst")))
    dealt = listed.select("id", "g", "n").distinct().join(clusters, F.col("id") == F.col("node")).select("id", "g", "n", F.col("component").alias("cluster"))
    counted = dealt.groupBy("cluster", "g").agg(F.count("*").alias("m"), F.sum("n").alias("s")).withColumn("part", F.when(F.col("m") >= OWN_BLOCKS, F.col("g")).otherwise(-1))
    counted = work.save(counted)
    blocks = counted.groupBy("cluster", "part").agg(F.ceil(F.greatest(F.sum("m") / BLOCK_SETS, F.sum("s") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    dealt = dealt.join(counted.select("cluster", "g", "part"), ["cluster", "g"]).join(blocks, ["cluster", "part"])
    dealt = work.save(dealt.select("id", F.struct("cluster", "part", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).alias("b")))
    rows = work.save(dealt.join(sets, "id").groupBy("b").agg(F.collect_list(F.struct("id", "g", "items")).alias("rows")))
    # blocks of one cluster that share an item; those of one component need no comparison
    held = listed.select("item", "id").join(dealt, "id").select("item", "b").distinct()
    apart, own = held.where("b.part = -1"), held.where("b.part <> -1")
    other = lambda df: df.select("item", *[F.col(c).alias({"b": "c", "part": "part2"}[c]) for c in df.columns if c != "item"])
    large = own.select("item", "b", F.col("b.part").alias("part"))
    parts = large.select("item", "part").distinct()
    meeting = parts.join(other(parts), "item").where("part < part2").join(large, ["item", "part"]).join(other(large), ["item", "part2"])
    pairs = apart.join(other(apart), "item").where("b < c").unionByName(apart.join(other(own), "item")).select("b", "c").unionByName(meeting.select("b", "c")).distinct()
    across = pairs.join(rows, "b").join(rows.select(F.col("b").alias("c"), F.col("rows").alias("y")), "c").select(F.col("rows").alias("x"), "y")
    alone = rows.where("b.part = -1").select(F.col("rows").alias("x"), F.col("rows").alias("y"))
    return work.save(alone.unionByName(across).mapInArrow(_block_pairs(percent), "src long, dst long"))


def _fetch(work: Workspace, texts: DataFrame, reps: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, items) of the wanted classes, from the texts of their representatives."""
    need = work.save(reps.join(ids, "id").select("id", "h1", "h2", F.col("rep_doc").alias("doc_id")))
    rows = texts.alias("t").join(need.alias("w").hint("shuffle_hash"), F.expr("t.doc_id <=> w.doc_id")).select("t.text", "w.id", "w.h1", "w.h2")
    return work.save(rows.mapInArrow(_gather(n), "id long, items array<long>").dropDuplicates(["id"]))


def near_duplicates(spark: SparkSession, documents: DataFrame, n: int = 5, percent: int = 80, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """One row per row of documents (doc_id long, text): its near-duplicate component.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; sets hold distinct n-word
    shingles (shorter texts: the whole sequence as one). Sets A and B are linked if
    100 * |A and B| >= percent * |A or B|. Null, empty and blank texts have an empty set, link with
    nothing and are their own component. Repeated rows share a class; rows with equal doc_id and
    different texts are compared like any others. A null doc_id counts as larger than any other.
    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id,
    null-safe), text_key (xxhash64 of the text) and group_id (the component's internal number, null for
    an empty set). Other columns of documents are not read.
    """
    work = Workspace(spark, "near")
    k = chunks * width
    texts = frames.pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))
    signed = work.save(texts.mapInArrow(_sign(n, k), "doc_id long, text_key long, n_shingles long, h1 long, h2 long, sig binary"))
    reps = work.save(signed.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles", "sig").agg(F.min("doc_id").alias("rep_doc")).withColumn("id", F.monotonically_increasing_id()))
    entries = reps.select("id", F.col("n_shingles").alias("n"), "sig").mapInArrow(_enter(chunks, width), "key long, id long, n long")
    shared = work.save(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    members = work.save(entries.join(shared, "key"))
    # every key's leader, the member that meets most others, is compared with all members
    meets = members.groupBy("id").agg(F.sum("c").alias("w"))
    leaders = work.save(members.join(meets, "id").groupBy("key").agg(F.max(F.struct("w", "id", "n")).alias("l")).select("key", F.col("l.id").alias("leader"), F.col("l.n").alias("n2")))
    star = members.join(leaders, "key").where(f"id <> leader and 100 * least(n, n2) >= {percent} * greatest(n, n2)")
    star = work.save(star.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    sets = _fetch(work, texts, reps, members.select("id").distinct(), n)
    edges = _verify(work, sets, star, percent)
    groups = connected_components(work, edges)
    # then the members of keys that hold several components beside the leader
    others = members.join(leaders, "key").where("id <> leader").select("key", "id")
    named = work.save(others.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("g")))
    split = named.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("key")
    rest = named.join(split, "key").select("id", "g").distinct()
    more = _list_edges(work, work.save(sets.join(rest, "id")), percent)
    groups = connected_components(work, edges.unionByName(more))
    work.only(signed, reps, groups)
    least = reps.join(groups, reps.id == groups.node).groupBy("component").agg(F.min("rep_doc").alias("least"))
    named = reps.join(groups, reps.id == groups.node, "left").join(least, "component", "left")
    named = named.select("h1", "h2", F.coalesce("component", "id").alias("group_id"), F.coalesce("least", "rep_doc").alias("least"))
    out = signed.drop("sig").join(named, ["h1", "h2"], "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", F.when(~empty, F.col("group_id")).alias("group_id"))


def drop_near_duplicates(spark: SparkSession, documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents without the near-duplicates of others: one row of each component stays, one with its least doc_id.

    Of rows that repeat both doc_id and text one stays; empty texts all stay. Columns are kept as they are, whatever their names.
    """
    marks = near_duplicates(spark, documents, n, percent).where("kept").select("doc_id", "text_key", "group_id")
    marks = Workspace(spark, "keep").save(marks.groupBy("group_id", "doc_id", "text_key").agg(F.count("*").alias("same")))
    one = marks.where("group_id is not null").groupBy("group_id", "doc_id").agg(F.min(F.struct("text_key", "same")).alias("x"))
    keep = one.select("doc_id", "x.text_key", "x.same").unionByName(marks.where("group_id is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("same")))
    d, text = (f"c{frames.place(documents, c)}" for c in ("doc_id", "text"))
    rows = frames.numbered(documents).join(keep.hint("shuffle_hash"), F.expr(f"cast({d} as long) <=> doc_id and xxhash64({text}) = text_key")).drop("doc_id", "text_key")
    once = rows.where("same = 1").unionByName(rows.where("same > 1").dropDuplicates([d, text]))
    return once.select(*frames.named(once, documents.columns))
