"""Nearest vectors by inverted lists: vectors are dealt to the nearest of trained centroids, and what is left of each is kept as a product code of a byte a part.

A search reads the codes of the lists nearest to a question, ranks them by tables of the question's parts, and compares the best again with the
vectors themselves. Centroids and codebooks are fitted on a bounded sample; every vector is indexed. The exact way is search.cosine_hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.jobs import folder, once
from .search import dot, small, unit

#: Vectors, by hash of the id, that centroids and codebooks are fitted on; parts of a code; values of a part; rounds of fitting.
SAMPLE, PARTS, VALUES, ROUNDS = 20_000, 16, 256, 8
#: Questions of a block: their tables are sent to all tasks (16 kB each).
BLOCK = 2_000
#: Vectors, and questions of a list, that are compared at once: what a task holds doesn't grow with the lists or the questions.
NEAR_ROWS, NEAR_QUESTIONS = 512, 128


@dataclass(frozen=True)
class VectorIndex:
    """codes: list, id, code and what was kept beside them; centroids (lists, dimensions) and codebooks (parts, values, dimensions of a part)."""

    codes: DataFrame
    centroids: np.ndarray
    books: np.ndarray


def _fitted(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids of x, or as many as it has distinct rows if these are fewer; the first are rows spread over x."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)].copy() if len(c) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(1)
    return np.concatenate([np.zeros(0, int), *[np.argmin(size - 2 * x[a:a + NEAR_ROWS] @ c.T, axis=1) for a in range(0, len(x), NEAR_ROWS)]])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a column of equally long lists; a null or another length becomes zeros."""
    out = np.zeros((len(column), d))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == d and None not in v:
            out[i] = v
    return out


def write_index(vectors: DataFrame, path: str, keep: tuple[str, ...] = (), lists: int | None = None) -> None:
    """Indexes vectors (id, embedding, keep...) in path. lists: twice the root of their number by default. Vectors are brought to length one; a null one, and one
    of another length than the sample's, is as one without length."""
    spark = vectors.sparkSession
    v = vectors.select("id", unit(F.col("embedding")).alias("v"), *keep)
    sample = v.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    d = max((len(x) for x in sample), default=PARTS)
    d = d + -d % PARTS
    x = np.array([[*s, *[0.0] * (d - len(s))] for s in sample], float).reshape(len(sample), d)
    n = vectors.count()
    centroids = _fitted(x, lists or max(1, int(2 * n**0.5)))
    left = (x - centroids[_nearest(x, centroids)]).reshape(len(x), PARTS, d // PARTS)
    books = np.zeros((PARTS, VALUES, d // PARTS))
    for i in range(PARTS):
        found = _fitted(left[:, i], VALUES)
        books[i, : len(found)] = found
        books[i, len(found) :] = found[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(pa.array([None if r is None else [*r, *[0.0] * (d - len(r))] if len(r) <= d else None for r in b.column(1).to_pylist()], pa.list_(pa.float64())), d)
            at = _nearest(m, centroids)
            rest = (m - centroids[at]).reshape(len(m), PARTS, -1)
            code = np.stack([_nearest(rest[:, i], books[i]) for i in range(PARTS)], axis=1).astype(np.uint8) if len(m) else np.zeros((0, PARTS), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in code], pa.binary()), *[b.column(2 + i) for i in range(len(keep))]], names=["list", "id", "code", *keep])

    kinds = "".join(f", {k} {v.schema[k].dataType.simpleString()}" for k in keep)
    coded = v.mapInArrow(run, f"list int, id {v.schema['id'].dataType.simpleString()}, code binary{kinds}")
    coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "id").sortWithinPartitions("list").write.parquet(f"{path}/codes")
    spark.createDataFrame([("centroids", centroids.tolist()), ("books", books.reshape(PARTS * VALUES, -1).tolist())], "name string, rows array<array<double>>").coalesce(1).write.parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    model = {r["name"]: np.array(r["rows"]) for r in spark.read.schema("name string, rows array<array<double>>").parquet(f"{path}/model").collect()}
    return VectorIndex(spark.read.parquet(f"{path}/codes"), model["centroids"], model["books"].reshape(PARTS, VALUES, -1))


def index_once(vectors: DataFrame, name: str, sources: list[str], keep: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
    return read_index(vectors.sparkSession, once(vectors, f"vectors-{name}", sources, lambda p: write_index(vectors, p, keep, lists)))


def nearest(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, probes: int, refine: int = 10, where: Column | None = None) -> DataFrame:
    """query_id, id, score (cosine), rank: the k vectors (id, embedding) found nearest to each of queries (query_id, q), exact among what the index gives: the
    refine * k best codes of the probes nearest lists. where filters by the columns that were kept beside the codes, before anything is ranked. Questions are taken in blocks."""
    spark, out = vectors.sparkSession, None
    asked = queries.select("query_id", unit(F.col("q")).alias("u")).where("u is not null")
    rows = asked.orderBy("query_id").toLocalIterator()
    block = []
    d, r = index.centroids.shape[1], refine * k

    def searched(block: list) -> DataFrame:
        ids, q = [x["query_id"] for x in block], np.array([[*x["u"], *[0.0] * d][:d] for x in block], float)
        near = q @ index.centroids.T
        lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        tables = np.einsum("qpd,pvd->qpv", q.reshape(len(q), PARTS, -1), index.books)
        by_list: dict[int, list[int]] = {}
        for i, row in enumerate(lists):
            for x in row.tolist():
                by_list.setdefault(x, []).append(i)
        sent = spark.sparkContext.broadcast((by_list, near, tables, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_list, near, tables, ids = sent.value
            names = np.array(ids, np.int64)
            for b in batches:
                at = b.column(0).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, PARTS)
                for x in np.unique(at).tolist():
                    here, all_ = np.flatnonzero(at == x), np.array(by_list.get(x, []), int)
                    for start in range(0, len(all_), NEAR_QUESTIONS):
                        q = all_[start:start + NEAR_QUESTIONS]
                        s = near[q, x][:, None] + sum(tables[q, i][:, code[here, i]] for i in range(PARTS))
                        # a batch's best of a list: r a question
                        best = np.argpartition(-s, min(r, s.shape[1]) - 1, axis=1)[:, :r]
                        row = pa.array(here[best].ravel())
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[q], best.shape[1])), b.column(1).take(row), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "id", "near"])

        codes = index.codes.where(F.col("list").isin(sorted(by_list)))
        codes = (codes if where is None else codes.where(where)).select("list", "id", "code")
        return codes.mapInArrow(run, f"query_id long, id {codes.schema['id'].dataType.simpleString()}, near double")

    for x in rows:
        block.append(x)
        if len(block) == BLOCK:
            out, block = searched(block) if out is None else out.unionByName(searched(block)), []
    if block or out is None:
        found = searched(block) if block else spark.createDataFrame([], f"query_id long, id {vectors.schema['id'].dataType.simpleString()}, near double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    path = folder(spark)
    out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= r).select("query_id", "id").write.parquet(path)
    best = spark.read.schema(out.select("query_id", "id").schema).parquet(path)
    exact = vectors.select("id", unit(F.col("embedding")).alias("v")).join(small(best), "id").join(small(asked), "query_id").select("query_id", "id", dot(F.col("v"), F.col("u")).alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= k)
