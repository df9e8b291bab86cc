"""Importance resampling towards a target by an external sort-count: texts become packed streams of 16-bit buckets with document offsets,
written once; streams are sorted and run-length encoded for counts; gains are gathered by the same streams later.

A text is split into words and hashed once. What is read again, for the corpus's counts and then for the weights, is two bytes a feature. A
task sorts one stream at a time and sums its runs, so that 2^16 numbers a task at most are shuffled, however large the corpus or a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, stored, words_of_rows
from .decontaminate import _SPLIT
from .quality import kth_largest
from .sql import crc32

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 25, 7
#: Features of a stream after which the next document begins a new one (2 MB); a longer document is a stream of its own.
STREAM = 1 << 20
#: Bytes of a word: digits, letters and all beyond ASCII; A-Z is lower-cased and all else becomes a space.
_TABLE = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _TABLE[_a:_b] = np.arange(_a, _b)
_TABLE[65:91] = np.arange(97, 123)
#: A second word of more bytes has its pairs hashed one by one.
SHIFTS = 64


def _shift_tables() -> np.ndarray:
    """tables[k, j, b]: what the byte b at place j of a CRC-32 becomes in the CRC of a text with k more zero bytes. A CRC is linear, so the
    CRC of a || b is the shifted CRC of a, xor the CRC of b."""
    step = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        step[b] = c
    tables = np.zeros((SHIFTS + 1, 4, 256), np.uint32)
    for j in range(4):
        tables[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for k in range(SHIFTS):
        tables[k + 1] = tables[k] >> np.uint32(8) ^ step[tables[k] & np.uint32(255)]
    return tables


_SHIFT = _shift_tables()


def joined_crcs(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each a || b from those of a and of b and b's bytes, of which SHIFTS at most."""
    return _SHIFT[size, 0, a & 255] ^ _SHIFT[size, 1, a >> 8 & 255] ^ _SHIFT[size, 2, a >> 16 & 255] ^ _SHIFT[size, 3, a >> 24] ^ b


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, as bytes, and how many each text has. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _TABLE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    found, n = words_of_rows(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.tobytes())))
    return found, n


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts' features, one text after another, and how many words each has. A word has one feature, and one more with the
    word before it; crc32 modulo BUCKETS is its bucket."""
    found, n = words(texts)
    distinct = found.dictionary_encode()
    names, at = distinct.dictionary.cast(pa.large_binary()).to_pylist(), distinct.indices.to_numpy(zero_copy_only=False)
    if not names:
        return np.zeros(0, np.uint16), n
    crc = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names))
    f, is_feature = np.zeros((len(at), 2), np.uint32), np.ones((len(at), 2), bool)
    f[:, 1] = crc[at]
    second, first = at[1:], at[:-1]
    f[1:, 0] = joined_crcs(spaced[first], crc[second], np.minimum(size[second], SHIFTS))
    for i in np.flatnonzero(size[second] > SHIFTS):
        f[i + 1, 0] = zlib.crc32(names[second[i]], int(spaced[first[i]]))
    is_feature[(np.cumsum(n) - n)[n > 0], 0] = False
    return (f[is_feature] % np.uint32(BUCKETS)).astype(np.uint16), n


def n_features(n_words: np.ndarray) -> np.ndarray:
    return np.maximum(2 * n_words - 1, 0)


def write_streams(docs: DataFrame, name: str) -> DataFrame:
    """Stored rows (doc_ids, words, stream): the documents of a stream in order, their words, and the packed little-endian uint16 buckets of all their
    features; a document's offset is the sum of those before it. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n = buckets(b.column(1))
            ends = np.cumsum(n_features(n))
            ids, first = b.column(0).to_pylist(), 0
            while first < len(n):
                start = ends[first] - n_features(n)[first]
                last = max(first + 1, int(np.searchsorted(ends, start + STREAM, "right")))
                cells = [[ids[first:last]], [n[first:last].tolist()], [f[start : ends[last - 1]].astype("<u2").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.list_(pa.int64())), pa.array(cells[1], pa.list_(pa.int64())), pa.array(cells[2], pa.binary())], names=["doc_ids", "words", "stream"])
                first = last

    return stored(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_ids array<long>, words array<long>, stream binary"), name)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream, ascending, and how often each stands in it: the sorted stream, run-length encoded."""
    s = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.diff(np.concatenate([starts, [len(s)]]))


def counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket stands in all streams. A task adds up its streams' runs; BUCKETS rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                values, n = run_lengths(np.frombuffer(s, "<u2"))
                total[values] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = map_arrow(streams.select("stream"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the corpus."""
    big_s, big_t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + BUCKETS) / ((s + 1) * (big_t + BUCKETS)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: the floored mean of its features' gains, 0 without features."""
    model = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = np.array(n, np.int64)
                f = n_features(n)
                total, full = np.zeros(len(n), np.int64), f > 0
                if full.any():
                    # reduceat has no empty segments, so those documents are left out of it
                    total[full] = np.add.reduceat(model.value[np.frombuffer(s, "<u2")], (np.cumsum(f) - f)[full])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(f), pa.array(total // np.maximum(f, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(streams.select("doc_ids", "words", "stream"), run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """weighed with score: weight plus Gumbel noise in whole thousandths, fixed by seed and doc_id (a null doc_id is an empty text in the noise's key)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with rank, from 1, in a total order: sorted by ranges, counted by part, so that no task holds all rows. The number of parts is what comes
    to the driver's plan. Rows that are equal by the order share its places in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id is the part's number and the row's place in it
    placed = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before, starts = 0, {}
    for part, size in sizes:
        starts[part], before = before, before + size
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(k), int(v)) for k, v in starts.items()], "_part long, _before long")
    return placed.join(F.broadcast(table), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def draw(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text), towards the texts of target (text).

    Of the N rows with least_words words or more the floor(share * N / 100) highest scores are drawn, ties to the smaller doc_id (a null one first);
    rank is their place, null for others. A null text has no words and weighs 0. Rows that share a doc_id share their noise; rows that are equal
    are drawn one by one. An empty docs gives no rows, an empty target gains from counts of 0.
    """
    streams = write_streams(docs, "streams")
    aim = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target")
    scored = stored(with_scores(weights(streams, gains(counts(streams), counts(aim)))), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * share // 100
    least = kth_largest(able, "score", k)
    drawn = F.lit(False) if least is None else (F.col("n_words") >= least_words) & (F.col("score") >= least)
    top = ranked(scored.where(drawn), F.desc("score"), F.asc("doc_id"), F.asc("n_features")).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return top.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op12_target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts and its place in the draw: draw."""
    return draw(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_target_draw": op12_target_draw}
_FEATURES = "unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])))"
SQL = {
    "op12_target_draw": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
df AS (SELECT r, {_FEATURES} AS f FROM d), bf AS (SELECT {_FEATURES} AS f FROM (SELECT {_SPLIT} AS ws FROM benchmark)),
fb AS (SELECT f, {crc32("f")} % {BUCKETS} AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf))),
s AS (SELECT b, count(*) AS n FROM df JOIN fb USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bf JOIN fb USING (f) GROUP BY b),
g AS (SELECT s.b, CAST(floor(CAST(1000 AS DOUBLE) * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM df) + {BUCKETS}) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM bf) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN fb USING (f) JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST(h AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND k <= {SHARE} * n // 100 THEN k END AS rank FROM z""",
}
