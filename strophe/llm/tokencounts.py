"""Token counts by linear longest-match matching.

The vocabulary is a trie over bytes. Every node has a failure link, where matching goes on when the
next byte has no edge, and the number of pieces popped on the way; both are precomputed. One walk over a
word's bytes then gives the number of greedy longest-match pieces without building one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strophe.llm import frames
from strophe.llm import words as W

#: Words whose counts a process remembers.
REMEMBERED = 500_000


def byte_tokens(path: str) -> list[bytes]:
    """The tokens of a byte-level BPE vocabulary file as bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(back[c] for c in t) for t in vocabulary if all(c in back for c in t)]


class Matcher:
    """Greedy longest-match piece counts; bytes that start no token count as one piece each."""

    def __init__(self, tokens: list[bytes]):
        tokens = [t for t in tokens if t] + [bytes([b]) for b in range(256)]
        self.edges: dict[int, int] = {}  # node << 8 | byte -> node
        ends, size = {0: False}, 1
        for t in tokens:
            node = 0
            for c in t:
                nxt = self.edges.get(node << 8 | c)
                if nxt is None:
                    nxt = self.edges[node << 8 | c] = size
                    ends[size] = False
                    size += 1
                node = nxt
            ends[node] = True
        self.link, self.pops = np.zeros(size, np.int64).tolist(), np.zeros(size, np.int64).tolist()
        below: dict[int, list[tuple[int, int]]] = {}
        for k, node in self.edges.items():
            below.setdefault(k >> 8, []).append((k & 255, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in below.get(parent, ()):
                queue.append(node)
                if ends[node]:
                    self.pops[node] = 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while (at << 8 | c) not in self.edges:  # ends at the root, which has every byte
                    popped += self.pops[at]
                    at = self.link[at]
                self.link[node], self.pops[node] = self.edges[at << 8 | c], popped
        self.memory: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        edges, link, pops = self.edges, self.link, self.pops
        node = total = 0
        for c in word:
            nxt = edges.get(node << 8 | c)
            while nxt is None:
                total += pops[node]
                node = link[node]
                nxt = edges.get(node << 8 | c)
            node = nxt
        while node:
            total += pops[node]
            node = link[node]
        return total

    def text(self, words: list[bytes]) -> int:
        memory, total = self.memory, 0
        try:
            return sum([memory[w] for w in words])
        except KeyError:
            for w in words:
                n = memory.get(w)
                if n is None:
                    n = self.count(b" " + w)
                    if len(memory) < REMEMBERED and len(w) < 64:
                        memory[w] = n
                total += n
            return total


#: Of this process; Python workers serve many tasks.
_MATCHERS: dict[str, Matcher] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("tokencounts")
        if path not in _MATCHERS:
            _MATCHERS[path] = Matcher(byte_tokens(path))
            W.remember("tokencounts", _MATCHERS.clear)
        matcher = _MATCHERS[path]
        for b in batches:
            words, tokens = [], []
            texts = b.column(1).cast(pa.binary())
            for at in range(0, b.num_rows, 128):
                for t in texts.slice(at, 128).to_pylist():
                    split = (t or b"").split()
                    words.append(len(split))
                    tokens.append(matcher.text(split))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_words, n_tokens.

    Words are runs of bytes other than ASCII white space; each is matched with one space before it against
    the byte-level vocabulary file, longest piece first from its left. Null, empty and blank texts have none.
    Texts are counted whole; repeated rows are each counted; other columns are not read.
    """
    documents = frames.pick(documents, "doc_id", "text")
    return documents.mapInArrow(_count(vocabulary), T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_tokens long")]))
