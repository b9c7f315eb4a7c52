"""Text sources and sinks of token rows and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators.corpus import hex_shard
from strophe.plans.scan import scan
from strophe.sources.files import concatenate, write_tree


def read_token_lines(spark: SparkSession, path: str, min_tokens: int = 0, max_length: int | None = None) -> DataFrame:
    """(tokens) of lines of white-space-separated integers with more than min_tokens, cut at max_length."""
    rows = spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int")).alias("tokens"))
    rows = rows.where(F.size("tokens") > min_tokens)
    return rows.withColumn("tokens", F.slice("tokens", 1, max_length)) if max_length else rows


def write_token_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def every_line(spark: SparkSession, path: str, every: int = 10) -> DataFrame:
    """(line, value): each `every`-th line of the text files under path, the first one included; lines count from 0, file after file by name.

    Lines are numbered by running sums that many tasks share.
    """
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = spark.read.text(path).select("value", place.alias("place"), F.lit(0).alias("all"))
    numbered = scan(rows, "all", "place", sums={"line": F.lit(1)})
    return numbered.where(F.col("line") % every == 0).select(F.col("line").cast("long").alias("line"), "value")


def read_compound(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, time, dur, pitch, instr, velocity) of whole files of 5-tuples."""
    values = F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), lambda x: x.try_cast("long"))
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), values.alias("v"))
    rows = rows.select("path", "v", F.posexplode(F.slice(F.sequence(F.lit(0), F.floor(F.size("v") / 5).cast("int")), F.lit(1), F.floor(F.size("v") / 5).cast("int"))).alias("pos", "i"))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), *[F.get("v", F.col("i") * 5 + k).alias(c) for k, c in enumerate(("time", "dur", "pitch", "instr", "velocity"))])


def write_compound(notes: DataFrame, path: str) -> None:
    """A file of 5-tuples for each track (track, pos, time, dur, pitch, instr, velocity): <hex digit>/<md5 of the track>.compound.txt, all or none.

    A track's row count is bounded by the gate that corpora pass, so a track is one line.
    """
    cell = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("time", "dur", "pitch", "instr", "velocity")])
    lines = notes.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("pos", cell.alias("t")))).alias("x"))
    md5 = F.md5(F.col("track").cast("string"))
    name = F.concat_ws("/", hex_shard(md5), F.concat(md5, F.lit(".compound.txt")))
    content = F.encode(F.array_join(F.transform("x", lambda x: x["t"]), " "), "UTF-8")
    write_tree(lines.select(name.alias("name"), content.alias("content")), path)


def compound_of_files(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(5-tuple rows, unreadable files) of decoded message rows; velocity is that of the note's on."""
    from strophe.operators import codec

    notes = codec.midi_notes(messages.where("type <> 'bad'"))
    ons = messages.where("type = 'note' and on").select(F.col("path").alias("track"), F.col("pos").alias("at"), F.col("velocity").cast("long").alias("velocity"))
    ons = ons.withColumn("pos", (F.row_number().over(Window.partitionBy("track").orderBy("at")) - 1).cast("long"))
    return notes.join(ons, ["track", "pos"]).select("track", "pos", "time", "dur", "pitch", "instr", "velocity"), messages.where("type = 'bad'").select("path")


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line: records, or the one row of a report."""
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header: indexes of clips, losses by step."""
    rows.write.mode("overwrite").csv(path, header=True)


def read_index(spark: SparkSession, path: str, offset: int = 0, count: int | None = None) -> DataFrame:
    """Rows of an index whose idx is in [offset, offset + count)."""
    rows = spark.read.csv(path, header=True).withColumn("idx", F.col("idx").cast("long")).where(F.col("idx") >= offset)
    return rows if count is None else rows.where(F.col("idx") < offset + count)


def index_files(index: DataFrame, files: DataFrame, column: str = "original") -> DataFrame:
    """Index rows with the files (name, ...) that a column of theirs names; rows whose file is missing go."""
    return index.join(files, index[column] == files["name"])


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """(split, bytes, md5) of the files <split>.txt below path, made of rows (md5, value): a line each, in the order of md5, so one hex shard after the other.

    The lines are sorted and written by many tasks, as parts; a split's parts are then put together as bytes.
    """
    from strophe.operators.corpus import hash_split

    spark, parts = rows.sparkSession, f"{path.rstrip('/')}/_parts"
    lines = rows.select(hash_split(F.col("md5")).alias("split"), F.lower("md5").alias("md5"), "value")
    lines.repartitionByRange("split", "md5").sortWithinPartitions("split", "md5").select("split", "value").write.mode("overwrite").partitionBy("split").text(parts)
    made = spark.read.format("binaryFile").load(f"{parts}/*/*.txt").select("path", F.regexp_extract("path", "split=([^/]+)/", 1).alias("split"))
    done = concatenate(made.select(F.col("path").alias("source"), F.concat(F.lit(f"{path.rstrip('/')}/"), "split", F.lit(".txt")).alias("target")))
    return done.select(F.regexp_extract("target", "([^/]+)[.]txt$", 1).alias("split"), "bytes", "md5")


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All rows of a hex-sharded table, of one split if named, in hex order."""
    rows = spark.read.parquet(path)
    return (rows if split is None else rows.where(F.col("split") == split)).orderBy("hex")


def existing_md5(spark: SparkSession, path: str) -> DataFrame:
    """The md5 that a hex-sharded table has already; none if there is no table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "md5 string")
    return spark.read.parquet(path).select("md5").distinct()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def local_files(spark: SparkSession, folder: str, splits: tuple[str, ...], categories: tuple[str, ...]) -> DataFrame:
    """(md5, path): of every md5 the first file in the order of splits and categories; hidden and resource files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mid").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.mid$", 1)
    rank = lambda names: F.coalesce(*[F.when(F.col("path").contains(f"/{n}/"), i) for i, n in enumerate(names)], F.lit(len(names)))
    kept = files.where(~F.col("path").contains("__MACOSX") & name.rlike("^[0-9a-fA-F]{32}$"))
    return kept.groupBy(F.lower(name).alias("md5")).agg(F.min_by("path", F.struct(rank(splits), rank(categories), "path")).alias("path"))


def write_sharded(df: DataFrame, path: str, existing: DataFrame | None = None, by_split: bool = False) -> None:
    """Rows by md5 into one folder for each hex digit (and split); md5 that are already there are passed over."""
    rows = df if existing is None else df.join(existing.select("md5").distinct(), "md5", "left_anti")
    rows = rows.withColumn("hex", hex_shard(F.col("md5")))
    rows.write.mode("append").partitionBy(*(["split", "hex"] if by_split else ["hex"])).parquet(path)
