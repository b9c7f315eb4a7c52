"""MIDI files below a root as a data source that plans by size and lists only what is asked for.

Files lie at root/<split>/<hex digit>/<md5>.mid. Conditions on split, hex and md5 reach the listing: folders that they rule out are not listed,
files that they rule out are not opened. A task gets files of at most so many bytes together, a larger file alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from strophe.sources import midi
from strophe.sources.files import place

SPLITS, HEX = ("train", "valid", "test"), "0123456789abcdef"
#: Bytes of files that a task gets, bytes of contents in a batch, folders that are listed at a time.
TASK_BYTES, BATCH_BYTES, LISTED = 64 << 20, 8 << 20, 16
_COLUMNS = "path string, split string, hex string, md5 string, bytes long"


@dataclass
class Found:
    path: str
    split: str
    hex: str
    md5: str
    bytes: int


class Share(InputPartition):
    def __init__(self, files: list[Found]):
        super().__init__(None)
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, root: str, what: str, task_bytes: int, log: str | None):
        self.root, self.what, self.task_bytes, self.log = root, what, task_bytes, log
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, (EqualTo, EqualNullSafe)) else tuple(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("split", "hex", "md5"):
                yield f
                continue
            held = {v for v in values if v is not None}
            self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], held) & held

    def _keep(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[InputPartition]:
        system, root = place(self.root)
        first = {m[:1].lower() for m in self.wanted["md5"]} if "md5" in self.wanted else set(HEX)
        folders = [(s, h) for s in SPLITS if self._keep("split", s) for h in HEX if self._keep("hex", h) and h in first]

        def listed(folder: tuple[str, str]) -> list[Found]:
            split, digit = folder
            out = []
            for f in system.get_file_info(fs.FileSelector(f"{root}/{split}/{digit}", allow_not_found=True)):
                name, end = os.path.splitext(f.base_name)
                if f.is_file and end == ".mid" and not name.startswith(("._", ".", "_")) and self._keep("md5", name):
                    out.append(Found(f.path, split, digit, name, f.size))
            return out

        with ThreadPoolExecutor(LISTED) as pool:
            files = [f for some in pool.map(listed, folders) for f in some]
        shares: list[list[Found]] = []
        size = 0
        for f in files:
            if not shares or size + f.bytes > self.task_bytes:
                shares.append([])
                size = 0
            shares[-1].append(f)
            size += f.bytes
        return [Share(s) for s in shares] or [Share([])]

    def _opened(self, f: Found) -> bytes:
        system, _ = place(self.root)
        if self.log:
            with open(self.log, "a") as out:
                out.write(f.path + "\n")
        with system.open_input_stream(f.path) as file:
            return file.read()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        size = 0
        for f in partition.files:
            held.append(f)
            size += f.bytes
            if size >= BATCH_BYTES or len(held) >= 1024:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, files: list[Found]) -> pa.RecordBatch:
        columns = {c: pa.array([getattr(f, c) for f in files]) for c in ("path", "split", "hex", "md5", "bytes")}
        if self.what == "content":
            columns["content"] = pa.array([self._opened(f) for f in files], pa.binary())
        elif self.what == "counts":
            counts = [midi.count_raw(self._opened(f)) or (None, None) for f in files]
            columns |= {c: pa.array([x[k] for x in counts], pa.int64()) for k, c in enumerate(("note_events", "tracks"))}
        return pa.RecordBatch.from_pydict(columns)


class MidiTree(DataSource):
    """Format "midi_tree". Option read: content (the bytes), counts (note_events and tracks, null of what is no MIDI file) or none, which opens no file."""

    @classmethod
    def name(cls) -> str:
        return "midi_tree"

    def _what(self) -> str:
        what = self.options.get("read", "content")
        if what not in ("content", "counts", "none"):
            raise ValueError("read is content, counts or none")
        return what

    def schema(self) -> T.StructType | str:
        return _COLUMNS + {"content": ", content binary", "counts": ", note_events long, tracks long", "none": ""}[self._what()]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], self._what(), int(self.options.get("task_bytes", TASK_BYTES)), self.options.get("log"))


def read_tree(spark: SparkSession, root: str, read: str = "content", task_bytes: int = TASK_BYTES, log: str | None = None) -> DataFrame:
    """(path, split, hex, md5, bytes, ...) of the files below root; log names a file that gets the path of every file opened.

    Conditions on split, hex and md5 (equal to, or in a list) are taken by the listing; the session's setting for that is switched on.
    """
    spark.dataSource.register(MidiTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("midi_tree").option("read", read).option("task_bytes", task_bytes)
    return (reader if log is None else reader.option("log", log)).load(root)
