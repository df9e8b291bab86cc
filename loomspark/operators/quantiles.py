"""Exact quantiles of many groups at once, without a group's values in one task: histograms narrow the range that a quantile's place lies in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.jobs import folder
from .search import small

CELLS = 1024


def _magnitude(c: Column) -> Column:
    """Grows with c as its logarithm does, on both sides of zero; no double has a logarithm under -746."""
    return F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))


def _share(value: str, f: Callable[[Column], Column]) -> Column:
    lo, hi = f(F.col("lo")), f(F.col("hi"))
    return F.when(hi > lo, F.least(F.floor((f(F.col(value)) - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))).otherwise((F.col(value) > F.col("lo")).cast("long"))


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups and a column for each of shares (name: share): the interpolated quantile of value (a number; nulls don't count) in each group, null
    where it has none.

    A place's range is cut into CELLS cells, equal in logarithm while the range is wide; counts tell which cell it lies in, and the least and largest value there are the
    next range, until these are one. What is shuffled is CELLS rows a group, place and task at most. Any finite values take a dozen rounds at most.
    """
    spark = rows.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    data = stored(rows.select(key.alias("_key"), F.col(value).cast("double").alias("v")).where("v is not null"))
    size = stored(data.groupBy("_key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f((F.col("n") - 1) * F.lit(float(p))).cast("long").alias("k")) for name, p in shares.items() for side, f in (("lower", F.floor), ("upper", F.ceil))])
    state = stored(size.select("_key", "lo", "hi", F.explode(places).alias("p")).select("_key", "p.name", "p.side", "p.k", "lo", "hi"))
    while not state.where("lo < hi").isEmpty():
        inside = data.join(small(state.where("lo < hi")), "_key").where("v between lo and hi")
        even = (F.col("lo") * F.signum("hi") > 0) & (F.greatest(F.abs("lo"), F.abs("hi")) / F.least(F.abs("lo"), F.abs("hi")) <= 4)
        cell = F.when(even, _share("v", lambda c: c)).otherwise(_share("v", _magnitude))
        cells = inside.groupBy("_key", "name", "side", "k", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("_key", "name", "side").orderBy("cell")) - F.col("n")
        found = cells.withColumn("before", before).where("k >= before and k < before + n").select("_key", "name", "side", (F.col("k") - F.col("before")).alias("k"), "lo", "hi")
        state = stored(found.unionByName(state.where("lo = hi")))
    at = state.groupBy("_key", "name").agg(F.max(F.when(F.col("side") == "lower", F.col("lo"))).alias("a"), F.max(F.when(F.col("side") == "upper", F.col("lo"))).alias("b"))
    at = at.join(size.select("_key", "n"), "_key")
    share = F.element_at(F.create_map(*[x for name, p in shares.items() for x in (F.lit(name), F.lit(float(p)))]), F.col("name"))
    place = (F.col("n") - 1) * share
    out = at.select("_key", "name", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("q")).groupBy("_key").pivot("name", list(shares)).agg(F.first("q"))
    all_ = rows.select(key.alias("_key"), *groups).distinct() if groups else spark.range(1).select(F.lit("").alias("_key"))
    return all_.join(out, "_key", "left").select(*groups, *shares)
