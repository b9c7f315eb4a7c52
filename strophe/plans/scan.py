"""Running sums and carried values over an order that many tasks share.

Rows are dealt by ranges of (group, order). Each range gives one summary of each group, a window over these summaries - as many rows as
ranges and groups - says what comes before a range, and windows within the ranges do the rest. So no task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.plans.scratch import stored


def scan(df: DataFrame, group: str, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with, by group and in ascending order, sums of the rows before each (0 for the first) and the last values so far that aren't null.

    `order` tells a group's rows apart; nulls count nothing. The rows are written once.
    """
    sums, lasts = sums or {}, lasts or {}
    given = df.columns
    values = {f"__v{i}": v for i, v in enumerate([*sums.values(), *lasts.values()])}
    keys = [k for k, _ in zip(values, sums, strict=False)]
    marks = list(values)[len(sums) :]
    ranged = stored(df.withColumns(values).repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    held = ranged.groupBy(group, "__part").agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}s") for k in keys],
        *[F.max_by(k, F.when(F.col(k).isNotNull(), F.col(order))).alias(f"{k}s") for k in marks],
    )
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    back = held.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"),
        *[F.coalesce(F.sum(f"{k}s").over(before), F.lit(0)).alias(f"{k}b") for k in keys],
        *[F.last(f"{k}s", True).over(before).alias(f"{k}b") for k in marks],
    )
    rows = ranged.join(back, ranged[group].eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    own = Window.partitionBy("__p", "__g").orderBy(order)
    earlier, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        *[ranged[c] for c in given],
        *[(F.col(f"{k}b") + F.coalesce(F.sum(k).over(earlier), F.lit(0))).alias(n) for k, n in zip(keys, sums, strict=True)],
        *[F.coalesce(F.last(k, True).over(upto), F.col(f"{k}b")).alias(n) for k, n in zip(marks, lasts, strict=True)],
    )
