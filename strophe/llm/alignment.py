"""Cross-tokenizer alignment by a cogroup of postings.

Each text is encoded by a byte-level vocabulary (A) and a sentence-piece model (B). Where a token of both ends, the bytes before are a
group, and the two tokens that end there are a link. A text's links become postings: its pairs of ids with their numbers.
Postings of many texts travel together by their B id; in the tasks they stand sorted behind the corpus-wide counts of that id's pairs, so
one pass over the sorted stream knows a pair's count and its id's highest before the postings come, and adds up what each document gets.
These contributions then meet by batch of documents. A B id that stands in very many links is dealt over several tasks, each of which
gets its counts; these are at most one for each A id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import encoders, frames
from strophe.llm import words as W
from strophe.llm.store import Workspace

#: Links and documents of a batch of postings, contributions that a task adds up at a time, links of a B id that go to one task.
BATCH_LINKS, BATCH_DOCS, HELD, SHARE = 1 << 20, 1 << 12, 1 << 20, 1 << 19
_BITS = 21  # of ids and of a document's place in its batch
_PART = (1 << _BITS) - 1


def _byte_of() -> dict[str, int]:
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class PartLinks:
    """Groups and links of texts by way of remembered parts.

    Both vocabularies encode the parts that encoders.py cuts by themselves: no piece of B may hold a space behind something else, and B must
    leave texts unnormalised; else texts are taken whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoders.PartIds(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = _byte_of()
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > _PART:
            raise ValueError("vocabularies of more than 2**21 - 1 ids")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.shown: dict[int, bytes] = {}
        probe = "a  b c \t é é ﬁ"
        self.cuts = self.a.cuts and not self.b.is_unknown(self.space) and not any("▁" in p.lstrip("▁") for p in pieces) and "".join(self.b.encode_as_pieces(probe)) == "▁" + probe.replace(" ", "▁").replace("\t", "<0x09>")
        self.clear()

    def clear(self) -> None:
        self.memory: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []
        #: Of each part: tokens of A and B, groups, whether its bytes differ, where its links begin. One link ends each group.
        self.n_a, self.n_b, self.n_groups, self.differs, self.starts = (encoders.Grown(np.int64) for _ in range(5))
        self.links = encoders.Grown(np.int64)  # B id << _BITS | A id

    def learn(self, parts: list[str]) -> None:
        parts, a_flat, n_a = self.a.parts_flat(parts)
        b_ids = self.b.encode(parts, num_threads=1)
        for k in [k for k, p in enumerate(parts) if not p]:
            b_ids[k] = [self.space]
        n_b = np.fromiter(map(len, b_ids), np.int64, len(parts))
        b_flat = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        whole = [(" " + p).encode() for p in parts]
        sizes = np.fromiter(map(len, whole), np.int64, len(parts))
        same = np.ones(len(parts), bool)
        for ids, n, table, lengths in ((a_flat, n_a, self.a_bytes, self.a_sizes), (b_flat, n_b, self.b_bytes, self.b_sizes)):
            made = [table[i] for i in ids.tolist()]
            ends = np.cumsum(n)
            if np.array_equal(np.diff(np.r_[0, np.cumsum(lengths[ids])][np.r_[0, ends]]), sizes) and b"".join(made) == b"".join(whole):
                continue
            same &= [b"".join(made[y - x : y]) == w for x, y, w in zip(n.tolist(), ends.tolist(), whole, strict=True)]
        if not same.all():
            a_flat, b_flat = a_flat[np.repeat(same, n_a)], b_flat[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        # the parts' bytes in a row: both sides have the same ends of parts
        a_ends, b_ends = np.cumsum(self.a_sizes[a_flat]), np.cumsum(self.b_sizes[b_flat])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
        n_groups = np.diff(np.searchsorted(a_last, np.r_[0, np.cumsum(n_a)]))
        text, cuts = self._text(a_flat, b_flat, a_last, b_last, np.cumsum(n_groups))
        self.memory.update(zip(parts, range(self.n_a.size, self.n_a.size + len(parts)), strict=True))
        self.groups += [text[x:y] for x, y in zip((cuts[:-1] + (n_groups > 0)).tolist(), cuts[1:].tolist(), strict=True)]
        ends = np.cumsum(n_groups)
        for table, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.differs, ~same), (self.starts, self.links.size + ends - n_groups)):
            table.add(more)
        self.links.add(b_flat[b_last] << _BITS | a_flat[a_last])
        self.chars += sum(map(len, parts))

    def _text(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each with a ; before it, and where the text of each part ends, which has groups up to ends."""
        n_a, n_b = np.diff(np.r_[0, a_last + 1]), np.diff(np.r_[0, b_last + 1])
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        at_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
        code = np.empty(len(a) + len(b), np.int64)  # the id, and what stands before it
        code[at_a], code[at_b] = a * 3 + 2, b * 3 + 2
        code[at_a[np.r_[0, a_last[:-1] + 1]] if len(a_last) else []] -= 2
        code[at_b[np.r_[0, b_last[:-1] + 1]] if len(b_last) else []] -= 1
        codes = code.tolist()
        table = self.shown
        for c in set(codes).difference(table):
            table[c] = b";|,"[c % 3 : c % 3 + 1] + str(c // 3).encode()
        pieces = [table[c] for c in codes]
        upto = np.r_[0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        tokens = np.r_[0, np.cumsum(n_a + n_b)]
        return b"".join(pieces), upto[tokens[np.r_[0, ends]]]

    def texts(self, texts: list[str], digest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(tokens of A, of B, groups, the groups as text or its digest, links) of each text; links of all texts in a row."""
        if len(self.memory) > encoders.REMEMBERED or self.chars > encoders.REMEMBERED_CHARS:
            self.clear()
        keys: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                parts = encoders._CUT.split(t) if self.cuts else [t]
                keys += parts
                sizes[k] = len(parts)
        missing = {p for p in keys if p not in self.memory}
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.memory.__getitem__, keys), np.int64, len(keys))
        ends = np.r_[0, np.cumsum(sizes)]

        def total(table: encoders.Grown) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(table.data[at])][ends])

        bad = total(self.differs) > 0
        sizes[bad] = 0
        if bad.any():
            at = at[encoders.spread(ends[:-1], sizes)]
            ends = np.r_[0, np.cumsum(sizes)]
        groups, held = [], at.tolist()
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            whole = b";".join([self.groups[k] for k in held[x:y]])
            groups.append((hashlib.sha256(whole).hexdigest() if whole else "") if digest else whole.decode())
        links = self.links.data[encoders.spread(self.starts.data[at], self.n_groups.data[at])]
        return total(self.n_a), total(self.n_b), total(self.n_groups), groups, links


#: Of this process; Python workers serve many tasks.
_LINKS: dict[tuple[str, str], PartLinks] = {}
DOCUMENT, TOTALS, POSTINGS = 0, 1, 2


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)


def _postings(a_path: str, b_path: str, digest: bool, key: pa.DataType):
    info = pa.struct([("doc_id", key), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())])
    ints = pa.list_(pa.int32())
    schema = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("b", pa.int32()), ("a", ints), ("doc", ints), ("n", ints), ("info", info)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("alignment")
        if (a_path, b_path) not in _LINKS:
            _LINKS[a_path, b_path] = PartLinks(a_path, b_path)
            W.remember("alignment", _LINKS.clear)
        coder = _LINKS[a_path, b_path]
        batch, docs, n_links, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            pair, doc = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            keys, n = np.unique(pair << _BITS | doc, return_counts=True)
            pair, doc = keys >> _BITS, keys & _PART
            if not len(keys):
                return
            new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for kind, p, d, m in ((TOTALS, pair[new], None, np.add.reduceat(n, new)), (POSTINGS, pair, doc, n)):
                b = p >> _BITS
                cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                columns = {"b": pa.array(b[cut].astype(np.int32)), "a": _lists(p & _PART, cut), "n": _lists(m, cut)}
                if d is not None:
                    columns["doc"] = _lists(d, cut)
                rows = _rows(schema, len(cut), kind=pa.array(np.full(len(cut), kind, np.int32)), batch=pa.array(np.full(len(cut), batch)), **columns)
                for k in range(0, len(cut), 2048):
                    yield rows.slice(k, 2048)

        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(1)):
                raw, cuts = buf.tobytes(), offsets.tolist()
                n_a, n_b, n_groups, groups, links = coder.texts([raw[x:y].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], digest)
                place = np.arange(docs, docs + j - i)
                held.append((links, np.repeat(place, n_groups)))
                what = pa.StructArray.from_arrays([b.column(0).slice(i, j - i).cast(key), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_groups), pa.array(groups, pa.string())], fields=list(info))
                n = j - i
                yield _rows(schema, n, kind=pa.array(np.full(n, DOCUMENT, np.int32)), batch=pa.array(np.full(n, batch)), doc=_lists(place, np.arange(n)), info=what)
                docs, n_links = docs + n, n_links + len(links)
                if docs >= BATCH_DOCS or n_links >= BATCH_LINKS:
                    yield from flush()
                    batch, docs, n_links, held = batch + 1, 0, 0, []
        if held:
            yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What documents get from rows (b, kind, batch, a, doc, n, total), sorted by b and kind: a pair's counts stand before its postings."""
    W.enter("alignment")
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    for rows in batches:
        b, kind = rows.column("b").to_numpy().astype(np.int64), rows.column("kind").to_numpy()
        lists = rows.column("a")
        ends = lists.offsets.to_numpy().astype(np.int64)
        per = np.diff(ends)
        pair = np.repeat(b, per) << _BITS | lists.values.to_numpy()[ends[0] : ends[-1]]
        if not len(b):
            continue
        known = kind == TOTALS
        # counts of ids that are past go; an id dealt over several tasks may bring its counts here more than once
        live = keys >> _BITS >= b[0]
        fresh = np.repeat(known, per)
        keys = np.r_[keys[live], pair[fresh]]
        counts = np.r_[counts[live], rows.column("total").to_numpy(zero_copy_only=False)[known].astype(np.int64)]
        keys, first = np.unique(keys, return_index=True)
        counts = counts[first]
        if known.all():
            continue
        side = keys >> _BITS
        cut = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        top_of, tops = side[cut], np.maximum.reduceat(counts, cut)
        posted = ~known
        wanted = pair[~fresh]
        n = rows.column("n").filter(pa.array(posted)).flatten().to_numpy().astype(np.int64)
        doc = rows.column("doc").filter(pa.array(posted)).flatten().to_numpy().astype(np.int64)
        batch = np.repeat(rows.column("batch").to_numpy()[posted], per[posted])
        count = counts[np.searchsorted(keys, wanted)]
        best = np.where(count == tops[np.searchsorted(top_of, wanted >> _BITS)], n, 0)
        held.append((batch, doc, best, n * count))
        size += len(n)
        if size >= HELD:
            yield from _added(held)
            held, size = [], 0
    if held:
        yield from _added(held)


def _added(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, doc, best, total) of contributions, one for each batch, added up by document."""
    batch, doc, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
    batches, nth = np.unique(batch, return_inverse=True)
    place = nth.astype(np.int64) << _BITS | doc
    order = np.argsort(place, kind="stable")
    place, best, total = place[order], best[order], total[order]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    nth, doc, best, total = place[new] >> _BITS, place[new] & _PART, np.add.reduceat(best, new), np.add.reduceat(total, new)
    cut = np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]])
    totals = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(total)].astype(np.int32)), pa.array(total))
    out = pa.RecordBatch.from_arrays([pa.array(batches[nth[cut]]), _lists(doc, cut), _lists(best, cut), totals], names=["batch", "doc", "best", "total"])
    for k in range(0, out.num_rows, 256):
        yield out.slice(k, 256)


def _sum(names: list[str]):
    """Rows of documents with the sums of what they get; rows (batch, kind, doc, best, total, info) stand sorted by batch and kind, documents last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("alignment")
        now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows in batches:
            batch, kind = rows.column("batch").to_numpy(), rows.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (batch[1:] != batch[:-1]) | (kind[1:] != kind[:-1])]) if len(batch) else []
            for x, y in zip(cuts, np.r_[cuts[1:], len(batch)] if len(batch) else [], strict=True):
                if batch[x] != now:
                    now, best, total = batch[x], np.zeros(1, np.int64), np.zeros(1, np.int64)
                some = rows.slice(x, y - x)
                doc = some.column("doc").flatten().to_numpy()
                if doc.max() >= len(best):
                    best, total = (np.r_[t, np.zeros(doc.max() + 1 - len(t), np.int64)] for t in (best, total))
                if kind[x] != DOCUMENT:
                    np.add.at(best, doc, some.column("best").flatten().to_numpy())
                    np.add.at(total, doc, some.column("total").flatten().to_numpy())
                    continue
                columns = [some.column("info").field(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best[doc]), pa.array(total[doc])], names=[*names, "n_best", "count_sum"])

    return run


def _aligned(spark: SparkSession, documents: DataFrame, a_path: str, b_path: str, digest: bool) -> tuple[Workspace, T.DataType, DataFrame, DataFrame]:
    """The tables that all else is made of: rows of documents and postings, and the pairs' counts over all documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    work = Workspace(spark, "alignment")
    documents = frames.pick(documents, "doc_id", "text")
    key = documents.schema["doc_id"].dataType
    info = T.StructType([T.StructField("doc_id", key), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups string")])
    kinds = T.StructType([*T.StructType.fromDDL("kind int, batch long, b int, a array<int>, doc array<int>, n array<int>"), T.StructField("info", info)])
    rows = work.save(documents.mapInArrow(_postings(a_path, b_path, digest, to_arrow_type(key)), kinds), "zstd")
    pairs = rows.where(F.col("kind") == TOTALS).select("b", F.explode(F.arrays_zip("a", "n")).alias("p"))
    return work, info, rows, work.save(pairs.groupBy("b", F.col("p.a").alias("a")).agg(F.sum("p.n").alias("total")))


def pair_counts(spark: SparkSession, documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(b, a, total) of all linked pairs of ids: how many links of all documents (doc_id, text) hold them. Conventions as in align_documents."""
    return _aligned(spark, documents, a_path, b_path, True)[3]


def align_documents(spark: SparkSession, documents: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    A: a space and the text under the byte-level vocabulary file a_path; B: the text under the sentence-piece model b_path, which adds the
    space. No special tokens are added, and their strings are ordinary text. groups lists the ids between common byte ends, A before |,
    B behind it, groups apart by ; - or its SHA-256 if digest. A link is an A and a B token that end together. n_best counts links whose pair
    is no rarer over all documents than any other of its B id; count_sum adds up the pairs' counts over the links. Null and
    empty texts, and those whose tokens' bytes differ from space and text, have no tokens: zeros and an empty groups. Repeated rows and null
    ids are each kept and counted; other columns are not read.
    """
    work, info, rows, counts = _aligned(spark, documents, a_path, b_path, digest)
    # at most one row for each B id, so bounded by the vocabulary's size
    hot = counts.groupBy("b").agg(F.sum("total").alias("links")).where(F.col("links") > SHARE).select("b", F.ceil(F.col("links") / SHARE).cast("int").alias("salts"))
    ints = "CAST(NULL AS array<int>)"
    totals = counts.join(F.broadcast(hot), "b", "left").select("b", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"), F.lit(TOTALS).alias("kind"), F.lit(-1).cast("long").alias("batch"), F.array("a").alias("a"), F.expr(ints).alias("doc"), F.expr(ints).alias("n"), "total")
    postings = rows.where(F.col("kind") == POSTINGS).join(F.broadcast(hot), "b", "left")
    postings = postings.select("b", F.expr("int(pmod(xxhash64(batch), coalesce(salts, 1)))").alias("salt"), "kind", "batch", "a", "doc", "n", F.lit(None).cast("long").alias("total"))
    stream = totals.unionByName(postings).repartition("b", "salt").sortWithinPartitions("b", "kind")
    got = stream.mapInArrow(_merge, "batch long, doc array<int>, best array<int>, total array<long>")
    got = got.select("batch", F.lit(POSTINGS).alias("kind"), "doc", "best", "total", F.lit(None).cast(info).alias("info"))
    own = rows.where(F.col("kind") == DOCUMENT).select("batch", "kind", "doc", F.expr(ints).alias("best"), F.expr("CAST(NULL AS array<long>)").alias("total"), "info")
    both = own.unionByName(got).repartition("batch").sortWithinPartitions("batch", F.desc("kind"))
    return both.mapInArrow(_sum(info.names), T.StructType([*info, *T.StructType.fromDDL("n_best long, count_sum long")]))
