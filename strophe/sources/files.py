"""Trees of files: a sink that commits, and copying, moving and linking by many tasks.

Files are named by their path below a root, such as train/0/0a1b.mid. Tasks reach the file system by the root's URI; without a scheme it is a
folder that the driver and all executors share.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strophe.plans.scratch import stored

#: Renames that a commit has under way at a time.
RENAMES = 32
HOW = ("copy", "move", "link")
#: Bytes that a task holds of a file.
BUFFER = 8 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri.rstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def there(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Staged(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)


class TreeWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job's own; the commit moves their files to their places, and what other attempts left goes with the folder."""

    def __init__(self, root: str, schema: T.StructType, overwrite: bool):
        if schema.names != ["name", "content"]:
            raise ValueError("file trees take the columns name and content")
        self.root, self.overwrite = root, overwrite
        self.job = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = place(self.root)
        task = TaskContext.get()
        folder = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        done = Staged(folder)
        for b in iterator:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not name or content is None:
                    raise ValueError("a file without a name or content")
                if ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"a file outside its root: {name}")
                path = f"{folder}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content.encode() if isinstance(content, str) else content)
                done.names.append(name)
        return done

    def commit(self, messages: list) -> None:
        system, root = place(self.root)

        def rename(move: tuple[str, str]) -> None:
            if self.overwrite or not there(system, move[1]):
                system.move(*move)

        moves = {name: (f"{m.folder}/{name}", f"{root}/{name}") for m in messages if m is not None for name in m.names}
        for folder in {to.rsplit("/", 1)[0] for _, to in moves.values()}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(rename, moves.values()))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, root = place(self.root)
        if there(system, f"{root}/{self.job}"):
            system.delete_dir(f"{root}/{self.job}")


class FileTree(DataSource):
    """Format "file_tree", for writing rows (name, content) as files below a path. Mode append leaves files that are there, overwrite replaces them."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL("name string, content binary")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TreeWriter(self.options["path"], schema, overwrite)


def write_tree(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Rows (name, content) as files below root, all of them or, if a task fails for good, none. Files that are there stay unless overwrite.

    Of several rows of one name one is written.
    """
    rows.sparkSession.dataSource.register(FileTree)
    rows.select("name", "content").write.format("file_tree").mode("overwrite" if overwrite else "append").save(root)


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name, bytes) of the files below root; those in folders that begin with _ or . don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = place(root)[1]
    return files.select(F.substring("path", F.locate(f"{base}/", F.col("path")) + len(base) + 1, F.length("path")).alias("name"), F.col("length").alias("bytes"))


def _act(how: str, source: str, target: str) -> str:
    """written, exists, missing, or error: and why. A copy appears under its name only when it is whole."""
    try:
        system, to = place(target)
        if there(system, to) or os.path.islink(to):
            return "exists"
        old, at = place(source)
        if not there(old, at):
            return "missing"
        system.create_dir(to.rsplit("/", 1)[0], recursive=True)
        if how == "link":
            if not isinstance(system, fs.LocalFileSystem):
                return "error: this file system has no links"
            try:
                os.symlink(at, to)
            except FileExistsError:  # another task's, just now
                return "exists"
        elif how == "move" and old.equals(system):
            system.move(at, to)
        else:
            part = f"{to.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
            fs.copy_files(at, part, source_filesystem=old, destination_filesystem=system)
            system.move(part, to)
            if how == "move":
                old.delete_file(at)
    except OSError as e:
        return f"error: {e}"
    return "written"


def file_actions(actions: DataFrame, how: str = "copy") -> DataFrame:
    """(source, target, status) of actions (source, target), each done once, before this returns, by the tasks that hold them.

    how is copy, move or link. status is written, exists (the target was there, or is that of an earlier row: the least source comes first),
    missing (no such source; a null one too) or error and why. So a second run finds all that the first one wrote; a task that runs again after
    an executor was lost says exists of what it had done.
    """
    if how not in HOW:
        raise ValueError(f"files can be acted on by {', '.join(HOW)}")
    nth = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    rows = actions.select("source", "target").withColumn("nth", nth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = ["exists" if n > 1 else "missing" if not s or not t else _act(how, s, t) for s, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], names=["source", "target", "status"])

    return stored(rows.mapInArrow(run, "source string, target string, status string"))


def copy_wanted(wanted: DataFrame, local: DataFrame, root: str, how: str = "copy") -> DataFrame:
    """(md5, status) of the wanted md5: their local files (md5, path), if any, go to root/<first digit>/<md5>.mid."""
    from strophe.operators.corpus import hex_shard

    target = F.concat_ws("/", F.lit(root.rstrip("/")), hex_shard(F.col("md5")), F.concat("md5", F.lit(".mid")))
    rows = wanted.select("md5").distinct().join(local.select("md5", "path"), "md5", "left").select(F.col("path").alias("source"), target.alias("target"))
    return file_actions(rows, how).select(F.regexp_extract("target", "([^/]+)[.]mid$", 1).alias("md5"), "status")


def restructure(files: DataFrame, root: str, how: str = "link") -> DataFrame:
    """(md5, status): files (md5, path) go to root/<split>/<first digit>/<md5>.mid."""
    from strophe.operators.corpus import hash_split, hex_shard

    md5 = F.col("md5")
    target = F.concat_ws("/", F.lit(root.rstrip("/")), hash_split(md5), hex_shard(md5), F.concat(md5, F.lit(".mid")))
    return file_actions(files.select(F.col("path").alias("source"), target.alias("target")), how).select(F.regexp_extract("target", "([^/]+)[.]mid$", 1).alias("md5"), "status")


def mirror_sample(files: DataFrame, source: str, root: str, fraction: float, seed: int = 42) -> DataFrame:
    """(name, status): of the files (name, ...) below source a share of each hex digit's, one at least, is copied to the same place below root."""
    from strophe.operators.corpus import hex_shard, stratified_sample

    key = F.regexp_extract("name", "([^/]+)$", 1)
    some = stratified_sample(files.select("name", hex_shard(key).alias("hex"), key.alias("key")), "hex", "key", fraction, seed)
    rows = some.select(*[F.concat_ws("/", F.lit(r.rstrip("/")), "name").alias(c) for r, c in ((source, "source"), (root, "target"))])
    return file_actions(rows).select(F.substring("target", len(root.rstrip("/")) + 2, 10_000).alias("name"), "status")


def concatenate(parts: DataFrame) -> DataFrame:
    """(target, bytes, md5) of files made of others, end to end: rows (source, target), in the order of source. Done once, before this returns.

    Each target is written by one task, which streams the bytes of its parts through a buffer, and appears when it is whole, in place of one that is there.
    """
    wanted = parts.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources")).repartition("target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            sizes, digests = [], []
            for target, sources in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, to = place(target)
                system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                part, size, digest = f"{to.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}", 0, hashlib.md5()
                with system.open_output_stream(part) as out:
                    for source in sources:
                        old, at = place(source)
                        with old.open_input_stream(at) as f:
                            while block := f.read(BUFFER):
                                out.write(block)
                                digest.update(block)
                                size += len(block)
                system.move(part, to)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["target", "bytes", "md5"])

    return stored(wanted.mapInArrow(run, "target string, bytes long, md5 string"))
