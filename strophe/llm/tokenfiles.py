"""Token files: documents' ids in order, coded in 64-bit words.

Coding. A word's upper four bits select how many ids of how many bits its other sixty hold. Ids are coded in blocks of BLOCK,
each from a word of its own; a word takes as many of the next ids as fit, with zeros beyond the block's end. Ids of 2**60 - 1 and
more are escaped: a word of selector 15 with all payload bits set stands for the next of the block's escapes, which follow its words.
As blocks share nothing, all blocks of a buffer are coded and decoded together.

File. MAGIC; the blocks; an Arrow stream of the documents (doc_id, n_tokens); the directory, four 64-bit numbers for each block (its
byte offset, ids, words, escapes); the footer, six 64-bit numbers (offset of the documents, offset of the directory, blocks, documents,
ids, crc32 of the blocks); MAGIC. All numbers are little-endian.

Folder. Tasks write files of names of their own; the job's commit writes the manifest, which alone says what the folder holds, and
deletes what attempts that didn't commit have left. A job that fails leaves no file.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from strophe.llm import encoders, frames
from strophe.llm import words as W

#: Ids and bits of a word by its selector (fixed values).
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 1024
ESCAPED = (1 << 60) - 1
MAGIC = b"S8BTOKEN"
#: Ids that are coded together, ids and documents after which a file ends, ids that are decoded together.
BUFFER, FILE_IDS, FILE_DOCS, READ_IDS = 1 << 20, 1 << 26, 1 << 20, 1 << 18
U = np.uint64
_COUNTS = np.array(COUNTS, np.int64)
_STRIDE = BLOCK + COUNTS[0]
#: The narrowest width for so many bits; rounding a large id to a double may add one.
_WIDTH = np.array([next((b for b in BITS if b >= n), BITS[-1]) for n in range(66)], np.uint8)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """The selector of the word that would begin at each id of a padded buffer."""
    need = _WIDTH[np.frexp(ids.astype(np.float64))[1]]
    widest = {1: need}  # over windows of so many ids
    for n, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 15, 15), (60, 30, 30), (120, 60, 60), (240, 120, 120)):
        out = widest[a].copy()
        np.maximum(out[:-a], widest[b][a:], out=out[:-a])
        widest[n] = out
    misses = np.zeros(len(ids), np.uint8)  # what fits a selector fits those behind it
    for s in range(15):
        misses += widest[COUNTS[s]] > BITS[s]
    return misses


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escapes, escapes of each block) of ids, coded in blocks of BLOCK."""
    ids = ids.astype(U)
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros((blocks, _STRIDE), U)
    full = len(ids) // BLOCK
    padded[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        padded[full, : len(ids) - full * BLOCK] = ids[full * BLOCK :]
    sizes = np.full(blocks, BLOCK, np.int64)
    if blocks:
        sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    padded = np.r_[padded.reshape(-1), np.zeros(COUNTS[0], U)]
    escaped = np.flatnonzero(padded >= U(ESCAPED))
    escapes = padded[escaped]
    padded[escaped] = U(ESCAPED)
    chosen = _selectors(padded)
    first = np.arange(blocks, dtype=np.int64) * _STRIDE
    at, end, live, steps = first.copy(), first + sizes, np.arange(blocks), []
    while len(live):
        steps.append(at)
        at = at + _COUNTS[chosen[at]]
        on = at < end[live]
        live, at = live[on], at[on]
    starts = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    selector = chosen[starts]
    words = selector.astype(U) << U(60)
    for s in np.unique(selector).tolist():
        if BITS[s]:
            rows = np.flatnonzero(selector == s)
            part = words[rows]
            for k in range(COUNTS[s]):
                part |= padded[starts[rows] + k] << U(BITS[s] * k)
            words[rows] = part
    return words, np.bincount(starts // _STRIDE, minlength=blocks), escapes, np.bincount(escaped // _STRIDE, minlength=blocks)[:blocks] if blocks else np.zeros(0, np.int64)


def decode_ids(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of blocks with so many words and so many ids each."""
    selector = (words >> U(60)).astype(np.int64)
    counts = _COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, U)
    for s in np.unique(selector).tolist():
        if BITS[s]:
            rows = np.flatnonzero(selector == s)
            at, w, mask = ends[rows] - COUNTS[s], words[rows], U((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[at + k] = (w >> U(BITS[s] * k)) & mask
    if len(escapes):
        out[np.flatnonzero(out == U(ESCAPED))] = escapes
    last = np.cumsum(block_words) - 1  # what the last words hold beyond the blocks' ends goes
    stop = ends[last] if len(last) else np.zeros(0, np.int64)
    begin = np.r_[0, stop[:-1]] if len(stop) else stop
    return out[encoders.spread(begin, np.asarray(sizes, np.int64))]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FileWriter:
    """One token file, written as ids come."""

    def __init__(self, system: fs.FileSystem, path: str, kind: pa.DataType):
        self.system, self.path, self.kind = system, path, kind
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.offset, self.crc, self.n_ids = len(MAGIC), 0, 0
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        self.directory: list[np.ndarray] = []
        self.docs: list[pa.RecordBatch] = []
        self.n_docs = 0

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]))
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BUFFER:
            ids = np.concatenate(self.wait)
            whole = len(ids) // BLOCK * BLOCK
            self._blocks(ids[:whole])
            self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BUFFER):
            some = ids[at : at + BUFFER]
            words, per, escapes, lost = encode_ids(some)
            sizes = np.minimum(BLOCK, len(some) - np.arange(len(per)) * BLOCK)
            held = per + lost  # each block's words, then its escapes
            first = np.cumsum(held) - held
            data = np.zeros(held.sum(), U)
            data[encoders.spread(first, per)] = words
            data[encoders.spread(first + per, lost)] = escapes
            self.directory.append(np.stack([self.offset + 8 * first, sizes, per, lost], 1))
            raw = data.astype("<u8").tobytes()
            self.crc = zlib.crc32(raw, self.crc)
            self.out.write(raw)
            self.offset += len(raw)

    def close(self) -> dict:
        if self.waiting:
            self._blocks(np.concatenate(self.wait))
        directory = np.concatenate(self.directory) if self.directory else np.zeros((0, 4), np.int64)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", self.kind), ("n_tokens", pa.int64())])) as stream:
            for b in self.docs:
                stream.write_batch(b)
        docs = sink.getvalue()
        self.out.write(docs)
        self.out.write(directory.astype("<i8").tobytes())
        self.out.write(struct.pack("<6q", self.offset, self.offset + len(docs), len(directory), self.n_docs, self.n_ids, self.crc) + MAGIC)
        self.out.close()
        return {"file": self.path.rsplit("/", 1)[-1], "n_docs": self.n_docs, "n_ids": self.n_ids}

    def abort(self) -> None:
        self.out.close()
        self.system.delete_file(self.path)


def read_file(system: fs.FileSystem, path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, token counts, ids in a row) of a file's documents, some at a time, in order; a bad file raises ValueError."""
    with system.open_input_file(path) as f:
        size, tail = f.size(), 48 + len(MAGIC)
        if size < tail + len(MAGIC) or f.read_at(len(MAGIC), 0) != MAGIC or (foot := f.read_at(tail, size - tail))[48:] != MAGIC:
            raise ValueError(f"no token file, or not all of it: {path}")
        at_docs, at_blocks, n_blocks, n_docs, n_ids, want = struct.unpack("<6q", foot[:48])
        docs = pa.ipc.open_stream(f.read_at(at_blocks - at_docs, at_docs)).read_all().combine_chunks()
        directory = np.frombuffer(f.read_at(32 * n_blocks, at_blocks), "<i8").reshape(n_blocks, 4)
        counts = docs.column(1).to_numpy().astype(np.int64)
        keys = docs.column(0).combine_chunks() if docs.num_rows else pa.array([], docs.schema.field(0).type)
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        ends = np.cumsum(counts)
        if len(counts) != n_docs or counts.sum() != n_ids or directory[:, 1].sum() != n_ids:
            raise ValueError(f"documents and blocks differ: {path}")
        done, left, got, crc = 0, np.zeros(0, U), 0, 0
        pieces: list[np.ndarray] = []
        step = READ_IDS // BLOCK
        for b in range(0, max(n_blocks, 1), step):
            some = directory[b : b + step]
            if len(some):
                held = some[:, 2] + some[:, 3]
                raw = f.read_at(8 * int(held.sum()), int(some[0, 0]))
                crc = zlib.crc32(raw, crc)
                data = np.frombuffer(raw, "<u8")
                first = np.cumsum(held) - held
                ids = decode_ids(data[encoders.spread(first, some[:, 2])], some[:, 2], data[encoders.spread(first + some[:, 2], some[:, 3])], some[:, 1])
                pieces.append(ids)
                got += len(ids)
            upto = int(np.searchsorted(ends, got, "right"))  # documents that end within what has been decoded
            if upto > done:
                left = np.concatenate(pieces) if pieces else left
                n = int(counts[done:upto].sum())
                yield keys.slice(done, upto - done), counts[done:upto], left[:n]
                pieces, done = [left[n:]], upto
        if crc != want:
            raise ValueError(f"checksum of the blocks differs: {path}")


#: Of this process; Python workers serve many tasks.
_IDS: dict[tuple[str, bool], encoders.ByteIds] = {}


def _encoded(texts: pa.Array, tokenizer: str, end_id: int | None, plain: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids in a row, ids of each) of some rows at a time."""
    if (tokenizer, plain) not in _IDS:
        _IDS[tokenizer, plain] = encoders.ByteIds(tokenizer, plain)
        W.remember("tokenfiles", _IDS.clear)
    for i, j, buf, offsets in W.pieces(texts):
        ids, counts = _IDS[tokenizer, plain].buffer(buf, offsets)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
        yield i, j, ids, counts


@dataclass
class Written(WriterCommitMessage):
    partition: int = 0
    files: list[dict] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, coding: tuple[str, int | None, bool] | None = None):
        if [f.name for f in schema.fields] != ["doc_id", "text" if coding else "ids"]:
            raise ValueError("token files take the columns doc_id and ids, or doc_id and text with a tokenizer")
        self.kind, self.coding = schema.fields[0].dataType, coding
        ids = T.ArrayType(T.IntegerType()) if coding else schema.fields[1].dataType
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.schema = T.StructType([schema.fields[0], T.StructField("ids", ids)]).json()

    def _rows(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc ids, ids of each, ids in a row)."""
        for b in iterator:
            if self.coding:
                for i, j, ids, counts in _encoded(b.column(1), *self.coding):
                    yield b.column(0).slice(i, j - i), counts, ids
            else:
                ends = b.column(1).offsets.to_numpy().astype(np.int64)
                yield b.column(0), np.diff(ends), b.column(1).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        W.enter("tokenfiles")
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        done, out, kind = [], None, to_arrow_type(self.kind)
        try:
            for keys, counts, ids in self._rows(iterator):
                ends, at = np.r_[0, np.cumsum(counts)], 0
                while at < len(keys):
                    if out is None:
                        out = FileWriter(system, f"{folder}/{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.s8b", kind)
                    room = np.searchsorted(ends[at + 1 :] - ends[at], FILE_IDS - out.n_ids) + 1
                    n = min(len(keys) - at, int(room), FILE_DOCS - out.n_docs)
                    out.add(keys.slice(at, n).cast(kind), counts[at : at + n], ids[ends[at] : ends[at + n]])
                    at += n
                    if out.n_ids >= FILE_IDS or out.n_docs >= FILE_DOCS:
                        done.append(out.close())
                        out = None
            if out is not None:
                done.append(out.close())
        except BaseException:
            if out is not None:
                out.abort()
            for x in done:
                system.delete_file(f"{folder}/{x['file']}")
            raise
        return Written(task.partitionId(), done)

    def _sweep(self, keep: set[str], only_own: bool) -> None:
        system, folder = _place(self.path)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.endswith(".s8b") and f.base_name not in keep and (f.base_name.startswith(self.job) or not only_own):
                system.delete_file(f.path)

    def commit(self, messages: list) -> None:
        system, folder = _place(self.path)
        manifest = f"{folder}/_manifest.json"
        if not self.overwrite and system.get_file_info(manifest).type != fs.FileType.NotFound:
            self._sweep(set(), True)
            raise ValueError(f"there are token files already: {self.path}")
        system.create_dir(folder, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for x in m.files:
                files.append(x | {"start": start})
                start += x["n_ids"]
        with system.open_output_stream(f"{folder}/{self.job}.manifest") as f:
            f.write(json.dumps({"schema": self.schema, "files": files}).encode())
        system.move(f"{folder}/{self.job}.manifest", manifest)
        self._sweep({x["file"] for x in files}, False)

    def abort(self, messages: list) -> None:
        self._sweep(set(), True)


@dataclass
class FilePart(InputPartition):
    file: str
    start: int

    def __init__(self, file: str, start: int):
        super().__init__((file, start))
        self.file, self.start = file, start


class Reader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, ids: bool):
        self.path, self.files, self.ids = path.rstrip("/"), [(x["file"], x["start"]) for x in manifest["files"]], ids
        self.element = T.StructType.fromJson(json.loads(manifest["schema"]))["ids"].dataType.elementType

    def partitions(self):
        return [FilePart(f, s) for f, s in self.files] or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        W.enter("tokenfiles")
        if not partition.file:
            return
        system, folder = _place(self.path)
        start = partition.start
        for keys, counts, ids in read_file(system, f"{folder}/{partition.file}"):
            begins = np.cumsum(counts) - counts
            columns = [keys, pa.array(start + begins)]
            if self.ids:
                values = pa.array(ids.astype(np.int64)).cast(to_arrow_type(self.element))
                columns.append(pa.LargeListArray.from_arrays(pa.array(np.r_[begins, len(ids)]), values).cast(pa.list_(values.type)))
            else:
                raw = memoryview(ids.astype("<u4").tobytes())
                columns += [pa.array(counts), pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), counts.tolist(), strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"] if self.ids else ["doc_id", "start", "n_tokens", "ids_crc32"])
            start += len(ids)


class TokenFiles(DataSource):
    """Format "simple8b". Writes (doc_id, ids) in the order of partitions and rows; with options tokenizer, end_id and plain, (doc_id, text). Reads doc_id, start (ids of all documents before it) and ids;
    with option ids=false, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in their place."""

    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def _manifest(self) -> dict:
        system, folder = _place(self.options["path"].rstrip("/"))
        with system.open_input_stream(f"{folder}/_manifest.json") as f:
            return json.loads(f.read())

    def _ids(self) -> bool:
        return self.options.get("ids", "true").lower() != "false"

    def schema(self) -> T.StructType:
        held = T.StructType.fromJson(json.loads(self._manifest()["schema"]))
        tail = [T.StructField("ids", held["ids"].dataType)] if self._ids() else [T.StructField(c, T.LongType()) for c in ("n_tokens", "ids_crc32")]
        return T.StructType([held["doc_id"], T.StructField("start", T.LongType()), *tail])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], self._manifest(), self._ids())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end_id", "")
        coding = (self.options["tokenizer"], int(end) if end else None, self.options.get("plain", "false").lower() == "true") if "tokenizer" in self.options else None
        return Writer(self.options["path"], schema, overwrite, coding)


def _encode(tokenizer: str, end_id: int | None, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.enter("tokenfiles")
        for b in batches:
            for i, j, ids, counts in _encoded(b.column(1), tokenizer, end_id, plain):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int | None = 0, plain: bool = False) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text) under a byte-level vocabulary file, each with end_id behind its ids.

    Null and empty texts are the end id alone. Special tokens are never added; their strings in a text are those tokens, or ordinary
    text if plain. Rows keep their order; other columns are not read.
    """
    documents = frames.pick(documents, "doc_id", "text")
    return documents.mapInArrow(_encode(tokenizer, end_id, plain), T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL("ids array<int>")]))


def write_documents(documents: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, plain: bool = False) -> None:
    """Token files of documents (doc_id, text) under path, in ascending doc_id order, in place of any that are there.

    Rows are dealt by ranges of doc_id, nulls first; rows of one doc_id keep the order in which Spark reads them and may be dealt to
    several tasks. An empty table gives a manifest without files. Texts and ids are as in encode_documents.
    """
    documents.sparkSession.dataSource.register(TokenFiles)
    rows = frames.pick(documents, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    options = {"tokenizer": tokenizer, "plain": str(plain).lower()} | ({} if end_id is None else {"end_id": str(end_id)})
    ordered.select("doc_id", "text").write.format("simple8b").options(**options).mode("overwrite").save(path)


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start and ids of the token files under path; without ids, n_tokens and ids_crc32 of the ids read."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("simple8b").option("ids", str(ids).lower()).load(path)
