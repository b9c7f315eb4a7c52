"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs the running tasks only. Where the setting is absent a local session (as in tests) gets a private
folder; on a cluster that is an error, as executors don't share local folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one if a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="strophe-"))


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts may be very long.

    Spark reads these settings when a plan runs, and operators return plans, so they stay lowered for the session.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        found = spark.conf.get(key)
        if not found.rstrip("bB").isdigit() or int(found.rstrip("bB")) not in range(1, most + 1):
            spark.conf.set(key, str(most))


class Workspace:
    """Named tables of one operator call: ``save`` writes and rereads, ``drop`` and ``only`` free disk.

    What the operator's result reads stays until ``clear``, which the caller of the result may use when done with it.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, compression: str = "uncompressed") -> DataFrame:
        """Hashes and ids don't shrink, and a codec's buffers outside the heap add up over many small tables; name a codec for texts and runs."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = df.schema
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(schema).parquet(path)
        self._tables[path] = out
        return out

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for path in [p for p, t in self._tables.items() if any(t is x for x in tables)]:
            del self._tables[path]
            self._delete(path)

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*(t for t in self._tables.values() if not any(t is x for x in tables)))

    def clear(self) -> None:
        self._tables.clear()
        self._delete(self.root)
