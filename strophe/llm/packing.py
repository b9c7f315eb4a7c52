"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised where they are read; only (document, piece, length) rows travel. Pieces are
dealt by a hash into groups of some thousand, each packed by bin completion: the largest piece left is put into a
new sequence, the undominated fillings of the rest of that sequence are enumerated, and branch and
bound over them starts from a best-fit-decreasing incumbent and prunes by the waste that an improvement
can still afford. What a group leaves in badly filled sequences is packed again with that of other
groups, in groups of the same size, as long as that places a fair share of it.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W
from strophe.llm.store import Workspace

CAPACITY = 4096
#: Pieces of a group, least search nodes of a group, steps after which a search looks at the fillings found so far.
GROUP, NODES, STEPS = 4000, 1_000, 400
#: Search nodes of a group for each sequence of its best fit decreasing packing.
PACKINGS = 4
#: Words whose ids a process remembers.
REMEMBERED = 1_000_000


class IdTable:
    """Token ids of words by their 64-bit hash and length: an open-addressing table over arrays, probed for many words at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.at, self.count, self.bytes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0
        self._spread(1 << 13, np.zeros(0, np.uint64))

    def _spread(self, slots: int, keys: np.ndarray) -> None:
        self.keys, self.slot, self.mask = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), np.uint64(slots - 1)
        self._place(keys, np.arange(len(keys), dtype=np.int32))

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slot[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.slot[at[won]], self.keys[at[won]] = entries[won], keys[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, entries, at = keys[rest], entries[rest], (at[rest] + 1) & int(self.mask)

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 for unknown ones."""
        at = (keys & self.mask).astype(np.int64)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        out = out.astype(np.int64)
        out[(out >= 0) & (self.bytes[out] != sizes)] = -1
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: list[bytes]) -> None:
        n, flat = len(keys), np.frombuffer(b"".join(ids), np.uint32)
        if not n:
            return
        while self.size + n > len(self.at):
            self.at, self.count, self.bytes = (np.r_[x, np.zeros_like(x)] for x in (self.at, self.count, self.bytes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        new = slice(self.size, self.size + n)
        self.at[new], self.count[new], self.bytes[new] = self.used + np.cumsum(counts) - counts, counts, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        if 2 * (self.size + n) > len(self.slot):
            held = np.zeros(self.size, np.uint64)
            full = self.slot >= 0
            held[self.slot[full]] = self.keys[full]
            slots = len(self.slot)
            while 2 * (self.size + n) > slots:
                slots *= 2
            self._spread(slots, held)
        self._place(keys, np.arange(self.size, self.size + n, dtype=np.int32))
        self.size += n


class WordIds:
    """Ids of texts, by way of remembered words.

    The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are those of
    its white-space-separated parts in a row, and a . or , behind a letter or digit that ends a part is a
    token of its own. A-Z and the Latin-1 letters are lower-cased here, so that fewer words differ.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # else each of its threads keeps memory of its own
        self.tokenizer, self.table = Tokenizer.from_file(path), IdTable()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _single(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _several(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of Latin-1 letters, many to a call: each ends with its only word-end token."""
        chunks = [words[i : i + 100] for i in range(0, len(words), 100)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = array("I", e.ids)
            at = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 4).tolist()
            if len(at) != len(chunk):
                yield from self._single(chunk)
                continue
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *at], at, strict=False))

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        parts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = np.array([p.isalpha() and (p.isascii() or max(p) < "\u0100") for p in parts], bool)
        for which, encode in ((plain, self._several), (~plain, self._single)):
            at = np.flatnonzero(which)
            self.table.add(keys[at], (ends - starts)[at], list(encode([parts[i] for i in at.tolist()])))

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts in a buffer; each text's ids are followed by end_id."""
        buf = lower_latin(buf)
        w = W.split_words(buf, offsets)
        last, before = buf[w.ends - 1], buf[np.maximum(w.ends - 2, 0)]
        accent = (before >= 0x80) & (buf[np.maximum(w.ends - 3, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7) & (w.ends - w.starts > 2)
        marked = ((last == 46) | (last == 44)) & (w.ends - w.starts > 1) & (_ALNUM[before] | accent)
        n = 1 + marked
        place = np.cumsum(n) - n
        starts, ends = np.repeat(w.starts, n), np.repeat(w.ends, n)
        ends[place[marked]] -= 1
        starts[place[marked] + 1] = ends[place[marked]]
        units = W.Words(buf, starts, ends, np.r_[0, np.cumsum(n)][w.offsets])
        keys, table = units.hashes(), self.table
        entry = table.find(keys, ends - starts)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if table.size + len(new) > REMEMBERED:
                table.clear()
                new = np.arange(len(keys))
            _, one = np.unique(keys[new], return_index=True)
            first = new[one]
            self._learn(buf.tobytes(), starts[first], ends[first], keys[first])
            entry[new] = table.find(keys[new], (ends - starts)[new])
            lost = new[entry[new] < 0]  # two words of one hash: the later is encoded on its own
        else:
            lost = new
        count = table.count[entry]
        own = [self._single([buf[a:b].tobytes().decode()])[0] for a, b in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)]
        count[lost] = [len(x) // 4 for x in own]
        # every text takes one more place for end_id behind its units
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(units.offsets))
        to = np.cumsum(count) - count + text
        total = np.r_[0, np.cumsum(count)][units.offsets]
        ids = np.full(int(total[-1]) + len(offsets) - 1, end_id, np.uint32)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids[np.repeat(to, count) + step] = table.ids[np.minimum(np.repeat(table.at[entry], count) + step, len(table.ids) - 1)]
        for at, x in zip(to[lost].tolist(), own, strict=True):
            ids[at : at + len(x) // 4] = np.frombuffer(x, np.uint32)
        return ids, total + np.arange(len(offsets))


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals of UTF-8 bytes in lower case."""
    out = W.lower_ascii(buf)
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


#: Of this process; Python workers serve many tasks.
_WORDS: dict[str, WordIds] = {}


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("packing")
        if path not in _WORDS:
            _WORDS[path] = WordIds(path)
            W.remember("packing", _WORDS.clear)
        words = _WORDS[path]
        for b in batches:
            for i, j, buf, offsets in W.pieces(b.column(1)):
                ids, ends = words.encode(buf, offsets, end_id)
                n = -(-np.diff(ends) // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.diff(ends)[row] - start, capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), ((ends[row] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at, length.tolist(), strict=True)]
                arrays = [b.column(0).take(pa.array(row + i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for x in sorted(lengths, reverse=True):
        k = bisect_right(room, (x, -1))
        if k < len(room):
            free, at = room.pop(k)
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(x)
        insort(room, (free - x, at))
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and by pieces that can't share a sequence (over each threshold)."""
    best = -(-sum(lengths) // capacity)
    a = np.sort(np.asarray(lengths, np.int64))
    sums = np.r_[0, np.cumsum(a)]
    for k in np.unique(a[a <= capacity // 2]).tolist() or [1]:
        lo, mid, hi = np.searchsorted(a, [k, capacity // 2 + 1, capacity - k + 1], "left").tolist()
        n1, n2 = len(a) - hi, hi - mid
        free = n2 * capacity - int(sums[hi] - sums[mid])
        rest = int(sums[mid] - sums[lo]) - free
        best = max(best, n1 + n2 + max(0, -(-rest // capacity)))
    return best


def _dominated(filling: list[int], slack: int, left: list[int], free: Callable[[int], bool]) -> bool:
    """Whether a free piece outside could take the place of some of the filling's pieces: such a filling is never better."""
    if len(filling) > 6:
        return False
    sums = {0}
    for x in filling:
        sums |= {s + x for s in sums}
    for s in sums - {0}:
        k = bisect_right(left, s + slack)  # the largest piece of at most s + slack
        while k and left[k - 1] > s:
            if free(left[k - 1]):
                return True
            k -= 1
        if s not in filling and free(s):  # one piece for several of the same sum
            return True
    return False


def fillings(room: int, sizes: list[int], count: dict[int, int], held: int = 0, steps: int = STEPS) -> Iterator[list[tuple[int, list[int]]]]:
    """All undominated maximal fillings of room as (waste, pieces), `held` being a piece already taken.

    They come in batches, of what so many steps find or what they find up to an exact one, each with the least waste and fewest pieces first. A
    batch may be empty. sizes and count may change between batches as long as they are as before when the next one is asked for.
    """
    used = {held: 1}
    free = lambda x: count.get(x, 0) > used.get(x, 0)
    chosen: list[int] = []
    found: list[tuple[int, list[int]]] = []
    path = [[bisect_right(sizes, room), room, False]]  # sizes to try, room left, whether any fits
    taken = 0
    while path:
        top = path[-1]
        k = top[0]
        while k and not free(sizes[k - 1]):
            k -= 1
        if k:
            x = sizes[k - 1]
            top[0], top[2] = k - 1, True
            taken += 1
            chosen.append(x)
            used[x] = used.get(x, 0) + 1
            path.append([bisect_right(sizes, min(top[1] - x, x)), top[1] - x, False])
            continue
        path.pop()
        exact = False
        if not top[2] and not any(free(y) for y in sizes[: bisect_right(sizes, top[1])]) and (not top[1] or not _dominated(chosen, top[1], sizes, free)):
            found.append((top[1], list(chosen)))
            exact = not top[1]
        if path:
            used[chosen.pop()] -= 1
        if exact or taken >= steps:
            yield sorted(found, key=lambda f: (f[0], len(f[1])))
            found, taken = [], 0
    if found:
        yield sorted(found, key=lambda f: (f[0], len(f[1])))


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = None) -> list[list[int]]:
    """Bins of lengths, as few as branch and bound finds within so many nodes; never more than best fit decreasing.

    A node looks for fillings of one sequence, so by default there are enough of them for whole packings and for going back.
    No undominated filling is thrown away: where nodes are left the search goes through all of them, and its result is the least.
    """
    best = best_fit_decreasing(lengths, capacity)
    if nodes is None:
        nodes = max(NODES, PACKINGS * len(best))
    bound = lower_bound(lengths, capacity)
    if len(best) <= bound:
        return best
    count: dict[int, int] = {}
    for x in lengths:
        count[x] = count.get(x, 0) + 1
    sizes = sorted(count)  # of the pieces left

    def take(pieces: list[int]) -> None:
        for x in pieces:
            count[x] -= 1
            if not count[x]:
                del sizes[bisect_right(sizes, x) - 1]

    def give(pieces: list[int]) -> None:
        for x in pieces:
            if not count[x]:
                insort(sizes, x)
            count[x] += 1

    total = sum(lengths)
    levels: list[tuple[Iterator, list, int, int]] = []  # batches of fillings, open ones, largest piece, waste before
    bins: list[list[int]] = []
    waste, placed = 0, 0
    while True:
        if placed == len(lengths):
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            if len(best) <= bound:
                return best
        else:
            big = sizes[-1]
            levels.append((fillings(capacity - big, sizes, count, big), [], big, waste))
        spare = (len(best) - 1) * capacity - total  # the waste that one sequence fewer leaves
        while levels:
            batches, open_, big, before = levels[-1]
            if len(bins) == len(levels):
                done = bins.pop()
                give(done)
                placed -= len(done)
            if not open_:
                batch = next(batches, None)
                if batch is None:
                    levels.pop()
                    continue
                nodes -= 1
                if nodes < 0:
                    return best
                open_ += batch[::-1]
                continue
            free, chosen = open_.pop()
            if before + free <= spare or placed + 1 + len(chosen) == len(lengths):
                break
        else:
            return best
        bins.append([big, *chosen])
        take(bins[-1])
        placed += 1 + len(chosen)
        waste = before + free


def _pack_group(capacity: int):
    """Every piece of a group with its sequence seq, its offset there, and whether that sequence is well filled."""

    def run(key, rows):
        lengths = rows.length.tolist()
        bins = bin_completion(lengths, capacity)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(lengths):
            by.setdefault(x, []).append(i)
        order, seq, offset, good = [], [], [], []
        for k, b in enumerate(bins):
            fine = sum(b) >= capacity - capacity // 64
            at = 0
            for x in b:
                order.append(by[x].pop())
                seq.append(k)
                offset.append(at)
                good.append(fine)
                at += x
        out = rows.iloc[order][["doc_id", "piece", "start", "length", "ids_crc32", "row"]].reset_index(drop=True)
        return out.assign(group=key[0], seq=np.array(seq, np.int64), offset=np.array(offset, np.int64), good=good)

    return run


def tokenise(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and end_id, cut at capacity.

    A null or empty text is the end id alone.
    """
    documents = frames.pick(documents, "doc_id", "text")
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)])
    return documents.mapInArrow(_tokenise(tokenizer, capacity, end_id, with_ids), schema)


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of documents is packed, repeated rows, null ids and null or empty texts (the end id alone) too. Only documents of more than
    capacity tokens are cut. Offsets in a sequence are gapless from 0. Other columns are not read.

    Pieces are dealt by a hash into groups of about `group` pieces, at every level. Sequences that a level leaves badly
    filled are taken apart and their pieces dealt again, until one group held them all or a level has placed less than a
    quarter of its pieces well: then its sequences stand as they are.
    """
    work = Workspace(spark, "pack")
    pieces = work.save(tokenise(documents, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    return pack_pieces(work, pieces, capacity, group)


def pack_pieces(work: Workspace, pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Places of pieces (doc_id, piece, start, length, ids_crc32, row), row being a unique number under 2**56."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = pieces.where(F.col("length") == capacity).select(*cols, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.where(F.col("length") < capacity)
    schema = T.StructType([*pieces.schema, *T.StructType.fromDDL("`group` long, seq long, offset long, good boolean")])
    left, level = open_.count(), 0
    while left:
        groups = -(-left // group)
        dealt = open_.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("long"))
        packed = work.save(dealt.groupBy("group").applyInPandas(_pack_group(capacity), schema))
        again = packed.where("not good").count() if groups > 1 else 0
        last = groups == 1 or 4 * again > 3 * left
        level += 1
        # row numbers stay under 2**56; a group is some thousand pieces at every level, so seq stays under 2**20
        sid = F.lit(level << 56) + F.col("group") * (1 << 20) + F.col("seq")
        done = done.unionByName((packed if last else packed.where("good")).select(*cols, sid.alias("sequence_id"), "offset"))
        if last:
            break
        open_, left = packed.where("not good").select(*cols, "row"), again
    return done
