"""Tables that change: versions of Parquet folders, with upserts, partial updates, deletes, appends and reports.

A change writes a new version beside the old one and never touches it, so readers of the old version go on, a failed write leaves no
trace that counts, and a repeated one is a further version. The newest version with Spark's success mark is the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.jobs import folder


def _list(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _loose(t: T.DataType) -> T.DataType:
    """The type with nulls allowed in arrays and structs."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_loose(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType), True) for f in t])
    return t


class Table:
    """A versioned table with key columns; schema is needed for a table that has no version yet."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | T.StructType):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = _loose(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    @classmethod
    def fresh(cls, df: DataFrame, keys: list[str]) -> Table:
        """A new table in the shared folder that holds df."""
        t = cls(df.sparkSession, folder(df.sparkSession), keys, df.schema)
        t.write(df)
        return t

    def version(self) -> int:
        """The newest complete version; 0 before the first."""
        done = [int(v[2:]) for v in _list(self.spark, self.path) if v.startswith("v=") and "_SUCCESS" in _list(self.spark, f"{self.path}/{v}")]
        return max(done, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> int:
        """df as the next version, with the table's columns; others are left out and missing ones are null."""
        v = self.version() + 1
        cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        df.select(*cols).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/v={v}")
        return v

    def append(self, rows: DataFrame) -> None:
        self.write(self.read().unionByName(rows, allowMissingColumns=True))

    def merge(self, updates: DataFrame, insert: bool = True, keep: tuple[str, ...] = (), fill_only: bool = False) -> dict[str, int]:
        """Upsert by key (unique in updates; keys are never null): an update's values go over the row's where they aren't null, but for columns of keep, which a row that is there keeps. insert=False: rows
        that aren't there are left out. fill_only: only nulls and empty arrays are filled. Gives how many rows were created, updated and kept."""
        t, rest = self.read(), [f for f in self.schema if f.name not in self.keys]
        old = t.select(*self.keys, F.lit(True).alias("_old"), *[F.col(f.name).alias(f"_o_{f.name}") for f in rest])
        new = updates.select(*self.keys, F.lit(True).alias("_new"), *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in updates.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
        j = old.join(new, self.keys, "full_outer" if insert else "left")

        def value(f: T.StructField) -> Column:
            o, n = F.col(f"_o_{f.name}"), F.col(f.name)
            if isinstance(f.dataType, T.ArrayType):
                o = F.when(F.size(o) > 0, o) if fill_only else o
            first, second = (o, n) if fill_only or f.name in keep else (n, o)
            return F.coalesce(first, second).alias(f.name)

        v = self.write(j.select(*self.keys, *map(value, rest)))
        n = j.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old") & F.col("_new")).alias("updated"), F.count_if(F.col("_old") & F.col("_new").isNull()).alias("kept")).first().asDict()
        return n | {"version": v}

    def update(self, where: Column, **values: Column) -> int:
        """Sets columns of the rows where a condition holds (null is no); gives how many."""
        t, hit = self.read(), F.coalesce(where, F.lit(False))
        n = t.where(hit).count()
        self.write(t.select(*[F.when(hit, values[f.name]).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in self.schema]))
        return n

    def delete(self, where: Column) -> int:
        t, hit = self.read(), F.coalesce(where, F.lit(False))
        n = t.where(hit).count()
        self.write(t.where(~hit))
        return n

    def delete_keys(self, keys: DataFrame, on: str) -> int:
        """Deletes the rows whose column is among keys' (one column of that name)."""
        t, gone = self.read(), keys.select(on).where(F.col(on).isNotNull()).distinct()
        n = t.join(gone, on, "left_semi").count()
        self.write(t.join(gone, on, "left_anti"))
        return n


def indexed(rows: DataFrame, table: Table, required: tuple[str, ...]) -> DataFrame:
    """Upserts the rows that have all of required; the others come back with an error each, and nothing is raised."""
    bad = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required])
    table.merge(rows.where(bad.isNull()))
    return rows.where(bad.isNotNull()).select(*table.keys, bad.alias("error"))


def clean_vectors(v: Column, dim: int) -> Column:
    """Values that are no finite numbers become 0; another number of values fails the task."""
    good = F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), F.lit(0.0).cast("float")).otherwise(x))
    return F.when(F.size(v) == dim, good).otherwise(F.raise_error(F.concat(F.lit(f"a vector needs {dim} values, not "), F.size(v).cast("string"))))


def report_csv(df: DataFrame, path: str | None = None) -> str:
    """df as CSV with a header; maps, arrays and structs become JSON. Gives the folder."""
    out = path or f"{folder(df.sparkSession)}/csv"
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*cols).write.option("header", True).option("escape", '"').csv(out)
    return out


def report_json(df: DataFrame, path: str | None = None) -> str:
    out = path or f"{folder(df.sparkSession)}/json"
    df.write.json(out)
    return out


class Cache:
    """Results kept by a key made of settings and what they were made from; rows hold as long as both are the same."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or folder(spark)

    @staticmethod
    def key(settings: dict, n: int, digest: str) -> str:
        import hashlib
        import json

        return hashlib.sha256(f"{json.dumps(settings, sort_keys=True)}:{n}:{digest}".encode()).hexdigest()[:12]

    def get(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{key}") if "_SUCCESS" in _list(self.spark, f"{self.path}/{key}") else None

    def put(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{key}")
        return self.get(key)
