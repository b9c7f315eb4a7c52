"""Stand-in views of note tracks, feeds and file metadata over the driver's star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIG = ("STANDARD", "MEDIUM", "PROMO")


#: Rows that a task gets of a table that is dealt by track, where tracks are not longer.
TASK_ROWS = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shares(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> int:
    return -(-sum(read(spark, sf_dir, t).count() for t in tables) // TASK_ROWS)


def parts(spark: SparkSession, sf_dir: str, *tables: str) -> int:
    """Partitions for the rows of tables (line items if none is named), so that a task's share does not grow with them: the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _shares(spark, sf_dir, tables or ("lineitem",)))


def dealt(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table whose rows of one key are one task's. What follows by that key needs no other exchange.

    Tables of more shares than tasks run at a time are dealt by number, as partitions that Spark chooses are put together by their bytes, up to more than a share.
    """
    rows, few = read(spark, sf_dir, table), min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts(spark, sf_dir, table), key) if _shares(spark, sf_dir, (table,)) > few else rows


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as notes: a supplier is a track, days are time, quantity is length."""
    li = dealt(spark, sf_dir, "lineitem", "l_suppkey")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("track"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.lit("event").alias("kind"),
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) * 4).cast("long").alias("time"),
        (F.col("l_quantity") * 25).cast("long").alias("dur"),
        F.when(F.col("l_linenumber") == 7, 128).otherwise((F.col("l_partkey") % 12) * 8).cast("long").alias("instr"),
        (F.col("l_partkey") % 128).cast("long").alias("pitch"),
    )


NOTES = """notes AS (
  SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, 'event' AS kind,
    CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) * 4 AS BIGINT) AS time, CAST(l_quantity * 25 AS BIGINT) AS dur,
    CAST(CASE WHEN l_linenumber = 7 THEN 128 ELSE (l_partkey % 12) * 8 END AS BIGINT) AS instr, CAST(l_partkey % 128 AS BIGINT) AS pitch
  FROM lineitem)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sparse feed: a user is a track, five minutes a tick."""
    ev = dealt(spark, sf_dir, "events", "user_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 300000000)
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return ev.select(
        F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.lit("event").alias("kind"), minutes.cast("long").alias("time"),
        F.get_json_object("props", "$.k").cast("long").alias("dur"), F.array_position(kinds, F.col("event_type")).cast("long").alias("instr"), (F.col("event_id") % 128).cast("long").alias("pitch"),
    )


FEED = """feed AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'event' AS kind,
    CAST((epoch_us(ts) - 1704067200000000) // 300000000 AS BIGINT) AS time, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dur,
    CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS instr, CAST(event_id % 128 AS BIGINT) AS pitch
  FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: line items are their tracks, a returned one is drums without a score."""
    li, part, orders = (read(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    style = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_mktsegment").alias("style"))
    rows = li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    score = F.when(F.col("l_returnflag") == "N", -1).otherwise(F.col("l_quantity").cast("int"))
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", score.alias("s"), F.when(score != -1, F.col("p_type")).alias("g"))
    a = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("total_notes"))
    a = a.join(style, "l_orderkey")
    return a.select(
        F.md5(F.col("l_orderkey").cast("string")).alias("md5"), F.size("c").cast("long").alias("num_tracks"), F.transform("c", lambda x: x["s"]).alias("nomml"),
        F.filter(F.transform("c", lambda x: x["g"]), lambda g: g.isNotNull()).alias("groups"), "total_notes", F.array("style").alias("styles"),
    )


FILES = """files AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS md5, count(*) AS num_tracks,
    list(CASE WHEN l_returnflag = 'N' THEN -1 ELSE CAST(l_quantity AS INT) END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nomml,
    coalesce(list(p_type ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (WHERE l_returnflag <> 'N'), []) AS groups,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_notes, [any_value(c_mktsegment)] AS styles
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_orderkey)"""
