"""Byte-level token ids of many texts by way of remembered parts.

A byte-level vocabulary's splitting rule never puts a character and white space behind it into one piece, and a run of white space
is split by what follows it. So a text may be cut before every space that stands behind anything but white space, and its ids are those
of the parts in a row. Parts, mostly a word with the space before it, repeat; the tokenizers library encodes each once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from strophe.llm import packing
from strophe.llm import words as W

#: What a process remembers: parts, and characters of them.
REMEMBERED, REMEMBERED_CHARS = 500_000, 1 << 23
#: Parts that the library encodes in one text.
TOGETHER = 200
_CUT = re.compile(r"(?<=\S) ")
_SPACE = re.compile(r"\s")


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.data):
            self.data = np.r_[self.data, np.zeros(max(end - len(self.data), len(self.data)), self.data.dtype)]
        self.data[self.size : end] = more
        self.size = end


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class PartIds:
    """Ids of texts under a byte-level vocabulary file. plain: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = rules.get("pre_tokenizer") or {}
        #: Only under these rules may texts be cut; others are encoded whole.
        self.cuts = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.clear()

    def clear(self) -> None:
        self.memory: dict[str | tuple[str], int] = {}
        self.chars = 0
        self.ids, self.starts, self.counts = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_flat(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the parts in another order, the ids of each with a space before it in a row, how many each has)."""
        simple = [p for p in parts if p and len(p) < 64 and not _SPACE.search(p)]
        rest = [p for p in parts if not p or len(p) >= 64 or _SPACE.search(p)]
        ids, counts = [], []
        for at in range(0, len(simple), TOGETHER):
            some = simple[at : at + TOGETHER]
            x = np.array(self.encode([" " + " ".join(some)])[0], np.int64)
            first = np.flatnonzero(self.opens[x])
            if len(first) != len(some) or first[0]:  # each part opens with the one space it has
                raise ValueError("a token of this vocabulary holds a space behind something else")
            ids.append(x)
            counts.append(np.diff(np.r_[first, len(x)]))
        for x in self.encode([" " + p for p in rest]):
            ids.append(np.array(x, np.int64))
            counts.append(np.array([len(x)]))
        none = [np.zeros(0, np.int64)]
        return simple + rest, np.concatenate(ids or none), np.concatenate(counts or none)

    def learn(self, keys: list) -> None:
        """keys: parts behind a space as strings, texts' first parts as one-tuples."""
        heads = [k for k in keys if isinstance(k, tuple)]
        parts, flat, counts = self.parts_flat([k for k in keys if not isinstance(k, tuple)])
        ids = self.encode([k[0] for k in heads])
        counts = np.r_[counts, np.array([len(x) for x in ids], np.int64)]
        at = self.ids.size
        self.ids.add(np.concatenate([flat.astype(np.uint32), *(np.asarray(x, np.uint32) for x in ids)]))
        self.memory.update(zip(parts + heads, range(self.starts.size, self.starts.size + len(counts)), strict=True))
        self.starts.add(at + np.cumsum(counts) - counts)
        self.counts.add(counts)
        self.chars += sum(map(len, parts)) + sum(len(k[0]) for k in heads)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if len(self.memory) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
        keys: list = []
        sizes = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                parts: list = _CUT.split(t) if self.cuts else [t]
                parts[0] = (parts[0],)
                keys += parts
                sizes[k] = len(parts)
        missing = {p for p in keys if p not in self.memory}
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.memory.__getitem__, keys), np.int64, len(keys))
        counts = self.counts.data[at]
        total = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(sizes)]]
        return self.ids.data[spread(self.starts.data[at], counts)], np.diff(total)


#: White space besides ASCII's; texts that hold some are encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FIRST = np.zeros(256, bool)
_FIRST[[c.encode()[0] for c in ODD_SPACE]] = True
_SPACED = np.uint64(0x5851F42D4C957F2D)


class ByteIds(PartIds):
    """PartIds over buffers of bytes, with remembered words in arrays.

    A text is cut further: into words, each with the space before it if there is one, a . or , behind a letter or digit that ends a word, and what
    else stands between words. Between words the splitting rule takes all white space but its last character as one piece, and the last with the word
    if it is a space, else as a piece of its own.
    """

    def __init__(self, path: str, plain: bool = False):
        super().__init__(path, plain)
        self.table = packing.IdTable()
        special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = _FIRST.copy()
        self.first[[t[0] for t in special]] = True
        self.odd = [*(c.encode() for c in ODD_SPACE), *special]

    def _odd(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold odd white space or the string of a special token."""
        out = np.full(len(offsets) - 1, not self.cuts)
        at = np.flatnonzero(self.first[buf])
        if not len(at):
            return out
        ends = np.searchsorted(offsets, at, "right") - 1
        lead = buf[at]
        for x in self.odd:
            hits = lead == x[0]
            for k in range(1, len(x)):
                hits[hits] = buf[np.minimum(at[hits] + k, len(buf) - 1)] == x[k]
            out[ends[hits]] = True
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, np.uint32).tobytes() for x in self.encode(texts)]

    def _spaced(self, words: list[bytes]) -> list[bytes]:
        """Ids of words with a space before each, many to a call: each opens with the only space it has."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.encode([(b" " + b" ".join(some)).decode()])[0], np.uint32)
            cuts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(cuts) != len(some):
                raise ValueError("a token of this vocabulary holds a space behind something else")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for kind in range(4):
            at = np.flatnonzero(kinds == kind)
            some = [parts[k] for k in at.tolist()]
            if kind == 1:
                ids = self._spaced(some)
            elif kind == 2:  # between words; any letter stands for the next one
                ids = [x[:-4] for x in self._raw([p.decode() + "x" for p in some])]
            else:
                ids = self._raw([p.decode() for p in some])
            self.table.add(keys[at], (ends - starts)[at], ids)

    def buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has) of texts in a buffer."""
        raw = buf.tobytes()
        n = len(offsets) - 1
        cuts = offsets.tolist()
        odd = self._odd(buf, offsets)
        whole = {int(k): np.array(self.encode([raw[cuts[k] : cuts[k + 1]].decode()])[0], np.uint32) for k in np.flatnonzero(odd)}
        w = W.split_words(buf, offsets)
        of = np.repeat(np.arange(n), w.counts())
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        gap = np.where(first, offsets[of], np.r_[0, w.ends[:-1]]) if len(of) else np.zeros(0, np.int64)
        spaced = (w.starts > gap) & (buf[np.maximum(w.starts - 1, 0)] == 32)
        last, before = buf[w.ends - 1], buf[np.maximum(w.ends - 2, 0)]
        mark = ((last == 46) | (last == 44)) & (w.ends - w.starts > 1) & packing._ALNUM[before]
        tail = np.flatnonzero(~odd & (offsets[1:] > offsets[:-1]))  # texts whose end is white space
        ended = np.where(w.counts()[tail] > 0, w.ends[np.maximum(w.offsets[1:][tail] - 1, 0)] if len(of) else 0, offsets[:-1][tail])
        tail, ended = tail[ended < offsets[1:][tail]], ended[ended < offsets[1:][tail]]
        between = np.flatnonzero((w.starts - gap > 1) | ((w.starts - gap == 1) & ~spaced))
        marks = np.flatnonzero(mark)
        # kinds: 0 a word or mark with nothing before it, 1 a word with a space, 2 white space between words, 3 white space at the end
        starts = np.r_[w.starts, w.ends[marks] - 1, gap[between], ended]
        ends = np.r_[w.ends - mark, w.ends[marks], w.starts[between], offsets[1:][tail]]
        kinds = np.r_[spaced.astype(np.int64), np.zeros(len(marks), np.int64), np.full(len(between), 2), np.full(len(tail), 3)]
        text = np.r_[of, of[marks], of[between], tail]
        keep = np.flatnonzero(~odd[text])
        keep = keep[np.lexsort((ends[keep], starts[keep]))]
        starts, ends, kinds, text = starts[keep], ends[keep], kinds[keep], text[keep]
        keys = W.mix(W.Words(buf, starts, ends, offsets).hashes() + kinds.astype(np.uint64) * _SPACED)
        sizes, table = ends - starts, self.table
        entry = table.find(keys, sizes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if table.size + len(new) > packing.REMEMBERED:
                table.clear()
                new = np.arange(len(keys))
            _, one = np.unique(keys[new], return_index=True)
            one = new[one]
            self._learn(raw, starts[one], ends[one], kinds[one], keys[one])
            entry[new] = table.find(keys[new], sizes[new])
            lost = np.unique(text[new[entry[new] < 0]])  # two parts of one hash: the text is encoded on its own
            for k in lost.tolist():
                whole[k] = np.array(self.encode([raw[cuts[k] : cuts[k + 1]].decode()])[0], np.uint32)
            if len(lost):
                stay = ~np.isin(text, lost)
                entry, text = entry[stay], text[stay]
        count = table.count[entry]
        sizes = np.bincount(text, count, n).astype(np.int64)
        ids = table.ids[spread(table.at[entry], count)]
        if not whole:
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k, x in whole.items():
            parts[k], sizes[k] = x, len(x)
        return np.concatenate(parts), sizes
