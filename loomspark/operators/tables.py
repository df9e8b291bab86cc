"""Merges, anti joins and other table operators as functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: an update's values where it has them, else the target's. Both have the same columns; keys are unique in each."""
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in rest])
    return t.join(updates, keys, "full_outer").select(*keys, *[F.coalesce(c, f"_t_{c}").alias(c) for c in rest])


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def latest(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Per key: rows and the fields of its latest row. Ties take the greater fields."""
    best = F.max_by(F.struct(*fields), F.struct(order, *fields))
    return df.groupBy(key).agg(F.count("*").alias("n"), best.alias("_b")).select(key, "n", *[F.col(f"_b.{f}").alias(f) for f in fields])


def histogram(df: DataFrame, column: str | Column, n: int, name: str = "value") -> DataFrame:
    """The n most frequent values; equal counts by value."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(name)).limit(n)


def grouping_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, in one pass: (dimension, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean of each group; partial sums by element combine before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy of a value's shares in each group, over the logarithm of how many values there are; 0 for one value."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return n.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log("p")).alias("e"), F.count("*").alias("k")).select(*keys, F.when(F.col("k") > 1, F.col("e") / F.log("k")).otherwise(0.0).alias("entropy"))


def union_evolved(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
