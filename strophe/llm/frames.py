"""Tables whose columns may have any names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """Where a column is: one of exactly this name, or else one that differs in case."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name)


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on, which clash with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The numbered columns of df under these names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever the others are called."""
    return numbered(df).select(*[F.col(f"c{place(df, c)}").alias(c) for c in names])


def fresh(name: str, *taken: DataFrame) -> str:
    """name, with underscores behind it until no table has a column of that name in any case."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name
