"""What the operators of this subpackage share: the shared folder, batching, word hashing and small graph tools.

Rules that hold for every operator here
---------------------------------------
* A null text is an empty text unless the operator's docstring says otherwise.
* Columns are read by name; other columns of the input, whatever their names, are ignored
  (or passed through untouched where an operator returns its input's columns).
* Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch. The bytes are what bounds a Python worker's memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 16384, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the shared folder; the caller (or the folder's owner) removes it."""
    return f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; timestamps without zone stay as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, if they aren't bounded as much: a batch has to fit beside the JVM. All operators here use the same
    bounds, so it doesn't matter which of them was called last when a plan runs."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def words_of_rows(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of a column of texts, A-Z lower-cased if asked for, and how many each row has. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, at = parts.flatten(), parts.offsets.to_numpy()
    # white space at either end of a text leaves an empty word
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(before[at])


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word. Arrow finds the batch's distinct words, which alone are hashed; nothing is kept from batch to batch."""
    distinct = words.dictionary_encode()
    names = distinct.dictionary.to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh64_intdigest, names.tolist()), np.uint64, len(names))
    return h[distinct.indices.to_numpy(zero_copy_only=False)] if len(names) else h


M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h *= M
        h += words[i : i + n]
    return mixed(h)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does just that to a text of ASCII alone, and much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tables of at most so many rows and bytes, counted and not guessed, are broadcast by small(); beyond it joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its rows and bytes, counted, are few enough."""
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


#: Parts over which the rows of one hot key are dealt.
SALTS = 64


def looked_up(rows: DataFrame, table: DataFrame, key: str, by: Column) -> DataFrame:
    """rows with the other columns of table (one row a key; null where it lacks the key). A key may be on any number of rows: these are dealt
    by `by`, a column that tells a key's rows apart, and the table's row is copied once for each part that a key's rows fill, SALTS at most."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long): rows (u, root), root the smallest vertex; vertices without an edge don't appear.

    Alternating large-star and small-star steps: each round keeps the number of edges within the number
    of vertices and edges, so no hub's neighbours are paired; rounds grow with the logarithm of the
    longest chain. Each round is written to the shared folder. Aggregates combine before the shuffle; their results are stored, so that
    adaptive skew handling can split a hub's join with them.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        small_least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
