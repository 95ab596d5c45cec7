"""Ranks within groups, with ties decided by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(group: list[str], *order: Column) -> Column:
    """1-based place in a group, as a long."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark turns the filter into partial and final group limits."""
    return df.withColumn(name, place(group, *order)).filter(F.col(name) <= k)


def average_rank(group: list[str], value: str) -> Column:
    """Descending rank in which ties share the mean of their places."""
    by = Window.partitionBy(*group)
    return F.rank().over(by.orderBy(F.col(value).desc())) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2


def capped_top(df: DataFrame, group: list[str], order: list[Column], per_group: int, n: int) -> DataFrame:
    """At most ``per_group`` rows of each group, then the first n of all."""
    return top_k(df, group, order, per_group, "_p").drop("_p").orderBy(*order).limit(n)


def stable_order(*keys: str, seed: int = 0) -> list[Column]:
    """A fixed pseudo-random order of rows."""
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    return df.orderBy(*stable_order(*keys, seed=seed)).limit(n)


def complete_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n groups chosen by hash; all groups if there are no more."""
    chosen = sample_rows(df.select(group).distinct(), n, group, seed=seed)
    return df.join(chosen, group, "left_semi")


def runs_are_contiguous(df: DataFrame, group: str, position: str) -> bool:
    """Whether each group's rows stand together by ``position``: as many runs as groups.

    Compares a row with the one before it by a self-join on the position, which needs no single sorted task.
    """
    before = df.select((F.col(position) + 1).alias(position), F.col(group).alias("_g"), F.lit(True).alias("_has"))
    row = df.join(before, position, "left").agg(F.sum((F.col("_has").isNull() | ~F.col(group).eqNullSafe(F.col("_g"))).cast("long")).alias("runs"), F.count_distinct(group).alias("groups")).first()
    return (row["runs"] or 0) == row["groups"]
