"""Search in paths by runs of three characters: postings of the runs that normalised paths hold, intersected from the rarest, then compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import once
from .search import small

#: Characters of a run, and the fewest that a term must have to filter anything.
RUN = 3
#: Runs of a term whose postings are intersected before paths are compared.
RAREST = 3


def normalised(path: Column) -> Column:
    """The path's letters a-z and digits, lower-cased, without what stands between."""
    return F.regexp_replace(F.lower(path), "[^a-z0-9]+", "")


def runs(text: Column) -> Column:
    """The distinct runs of RUN characters of a normalised text."""
    n = F.length(text)
    return F.when(n >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (RUN - 1), F.lit(1))), lambda i: F.substring(text, i, RUN)))).otherwise(F.array().cast("array<string>"))


def write_index(paths: DataFrame, path: str) -> None:
    """Writes the postings (gram, path, plain) of distinct paths, sorted by ranges of gram and path, and how many each gram has."""
    spark = paths.sparkSession
    rows = paths.where("path is not null").select("path").distinct().withColumn("plain", normalised(F.col("path")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.select(F.explode(runs(F.col("plain"))).alias("gram"), "path", "plain").repartitionByRange(n, "gram", "path").sortWithinPartitions("gram", "path").write.parquet(f"{path}/postings")
    spark.read.schema("gram string, path string, plain string").parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/grams")


def index_once(paths: DataFrame, name: str, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and counts of the grams of paths, which are made of the files of sources."""
    at, read = once(paths, f"paths-{name}", sources, lambda p: write_index(paths, p)), paths.sparkSession.read
    return read.schema("gram string, path string, plain string").parquet(f"{at}/postings"), read.schema("gram string, n long").parquet(f"{at}/grams")


def candidates(index: tuple[DataFrame, DataFrame], terms: DataFrame) -> DataFrame:
    """term, plain_term, path, plain: the paths that hold each of a term's RAREST rarest runs. Terms (term) shorter than RUN aren't looked up."""
    postings, grams = index
    t = terms.where("term is not null").select("term").distinct().withColumn("plain_term", normalised(F.col("term"))).where(F.length("plain_term") >= RUN)
    each = t.select("term", "plain_term", F.size(runs(F.col("plain_term"))).alias("all_"), F.explode(runs(F.col("plain_term"))).alias("gram")).join(small(grams), "gram")
    rare = each.groupBy("term", "plain_term", "all_").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, RAREST).alias("g"), F.count("*").alias("known"))
    # a run that no path has: no path has the term
    wanted = rare.where("known = all_").select("term", "plain_term", F.size("g").alias("need"), F.explode("g.gram").alias("gram"))
    hits = postings.join(small(wanted), "gram").groupBy("term", "plain_term", "path", "plain", "need").agg(F.count("*").alias("has"))
    return hits.where("has = need").select("term", "plain_term", "path", "plain")


def find_paths(index: tuple[DataFrame, DataFrame], terms: DataFrame) -> DataFrame:
    """term, path: the paths that hold a term, both normalised. Null terms and those under RUN characters, which filter nothing, have no rows: see filters."""
    return candidates(index, terms).where(F.contains("plain", "plain_term")).select("term", "path")


def filters(term: Column) -> Column:
    """Whether a term filters at all."""
    return F.coalesce(F.length(normalised(term)) >= RUN, F.lit(False))
