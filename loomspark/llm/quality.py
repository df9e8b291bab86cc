"""Quality classifier by importance resampling: documents are weighed by the ratio of two hashed n-gram generative models,
one of target text and one of raw text, and drawn by Gumbel top-k.

Target text is a bounded sample of labelled documents of good quality that aren't toxic; raw text is the whole corpus.
N-grams are words (case and edge punctuation folded) and pairs of neighbouring word shapes with whether the words are
equal. Both models and the weights count an n-gram MOST_TIMES a document at most: one that repeats a line a hundred times says little more than another. A bucket's log
ratio, of either sign, counts where the counts differ by SIGNIFICANCE signed roots of the Poisson deviance and by LEAST_FACTOR or more: else
rare n-grams' noise, and the small lead that all target words have because poor text takes a share of the raw model, would drown the rest. The deviance
of n-grams that the target lacks, such as insults, grows as their expected count does, so an expected count of four is enough to notice them.

The length rule: a document weighs as REFERENCE n-grams of its make-up would, the mean log ratio times REFERENCE, so that long documents aren't
drawn or left for their length. The draw: Gumbel noise of scale 1 is added to the log weights and the k largest are taken, which is sampling
without replacement by weight. Log ratios are whole millionths, so sums don't depend on batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import M, as_bytes, map_arrow, mixed, read_table, stored, words_of_rows

#: Buckets of the hashed models (one array of this length is sent to the executors: 2 MB), and labelled rows used at most.
BUCKETS, MAX_LABELS = 1 << 19, 40_000
SIGNIFICANCE, LEAST_FACTOR, PSEUDO, REFERENCE, MOST_TIMES = 2.5, 2.0, 0.3, 200, 5
#: Share of the labelled rows that sets the size of the draw and is kept from the target model, as 1 in HELD_OUT.
HELD_OUT = 4
#: Held-out rows of a kind that are few: their share counts half in setting the cut.
FEW_ROWS = 20
#: What is stripped from a word's edges before it is folded, and the runs of characters that are one in a word's shape.
EDGE = ".,;:!?\"'()"
_SHAPE = ((r"[a-z\x{80}-\x{10FFFF}]+", "a"), (r"[A-Z]+", "A"), (r"[0-9]+", "0"))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's n-grams, each MOST_TIMES at most, one text after another, and how many each text has: a word has one, and one more with the word before it.
    Words are folded and shaped once for each distinct word of the batch, by Arrow."""
    words, n = words_of_rows(texts)
    distinct = words.dictionary_encode()
    names, at = distinct.dictionary, distinct.indices.to_numpy(zero_copy_only=False)
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    folded = pc.ascii_trim(pc.ascii_lower(names), characters=EDGE).to_numpy(zero_copy_only=False)
    shapes = names
    for pattern, one in _SHAPE:
        shapes = pc.replace_substring_regex(shapes, pattern, one)
    shapes = shapes.dictionary_encode()
    shape = np.array([xxhash.xxh64_intdigest(re.sub(r"(.)\1+", r"\1", x)) for x in shapes.dictionary.to_pylist()], np.uint64)[shapes.indices.to_numpy(zero_copy_only=False)]
    a, b = np.fromiter(map(xxhash.xxh64_intdigest, folded.tolist()), np.uint64, len(names))[at], shape[at]
    f, is_gram = np.zeros((len(a), 2), np.uint64), np.ones((len(a), 2), bool)
    f[1:, 0] = mixed(b[1:] * M + b[:-1] + (a[1:] == a[:-1]))
    f[:, 1] = mixed(a)
    is_gram[(np.cumsum(n) - n)[n > 0], 0] = False
    row = np.repeat(np.arange(len(n)), np.maximum(2 * n - 1, 0))
    both, times = np.unique(row * BUCKETS + (f[is_gram] % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, f = np.divmod(np.repeat(both, np.minimum(times, MOST_TIMES)), BUCKETS)
    return f, np.bincount(row, minlength=len(n))


TARGET, TOXIC, POOR = range(3)
Labels = dict[int, tuple[int, bool]]


def sampled_labels(labels: DataFrame, limit: int = MAX_LABELS) -> Labels:
    """doc_id -> (TARGET, TOXIC or POOR, is held out) of at most limit labelled rows, by hash order. Rows with nulls are left out;
    a document labelled twice counts as its worst label, and one that is both poor and toxic as poor."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return {r["doc_id"]: (POOR if r["q"] != 1 else TARGET if r["t"] == 0 else TOXIC, i % HELD_OUT == 0) for i, r in enumerate(rows)}


def fit(docs: DataFrame, labels: Labels) -> np.ndarray:
    """Log ratio of each bucket in millionths. Counts cover every document; each task sums its own before anything is shuffled."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({k for k, v in labels.items() if v == (TARGET, False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            f, n = features(b.column(1))
            raw += np.bincount(f, minlength=BUCKETS)
            chosen = np.array([k in known.value for k in b.column(0).to_pylist()], bool)
            if chosen.any():
                target += np.bincount(f[np.repeat(chosen, n)], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 15):
            x = at[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(raw[x]), pa.array(target[x])], names=["bucket", "raw", "target"])

    # at most BUCKETS rows, whatever the corpus
    rows = map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    raw[at], target[at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return log_ratios(raw, target)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability in millionths; 0 where it isn't significant or the factor is less than LEAST_FACTOR."""
    expected = target.sum() * raw / max(1.0, raw.sum())
    ratio = np.log((target + PSEUDO) / (expected + PSEUDO))
    deviance = 2 * (target * np.log(np.where(target > 0, target, 1) / np.where(expected > 0, expected, 1)) - (target - expected))
    ratio[(deviance < SIGNIFICANCE**2) | (np.abs(ratio) < np.log(LEAST_FACTOR))] = 0
    return np.round(ratio * 1e6).astype(np.int32)


def _gumbel(keys: list[int | None], texts: list[bytes], seed: int) -> np.ndarray:
    """Standard Gumbel noise fixed by document and text, so that a retried task draws the same."""
    u = np.array([xxhash.xxh64_intdigest(t, seed ^ (k or 0) & 0xFFFFFFFF) for k, t in zip(keys, texts, strict=True)], np.uint64)
    return -np.log(-np.log((u >> np.uint64(11)).astype(float) / 2**53 + 2**-54))


def with_scores(docs: DataFrame, ratio: np.ndarray, seed: int = 7, keep_columns: bool = False) -> DataFrame:
    """doc_id (or all columns) with n_features (n-grams, each MOST_TIMES at most), log_weight (mean log ratio times REFERENCE; 0 without words) and draw (the Gumbel key, in millionths).

    Added columns are named n_features, log_weight and draw, or with a leading underscore each while such a column exists.
    """
    names = {}
    for n in ("n_features", "log_weight", "draw"):
        names[n] = n
        while keep_columns and names[n] in docs.columns:
            names[n] = "_" + names[n]
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    df = docs if keep_columns else docs.selectExpr("cast(doc_id as long) doc_id", "text")
    at = df.columns.index("doc_id"), df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lr = model.value
        for b in batches:
            f, n = features(b.column(at[1]))
            total = np.concatenate([[0], np.cumsum(lr[f], dtype=np.int64)])
            end = np.cumsum(n)
            s = (total[end] - total[end - n]) * (REFERENCE / 1e6) / np.maximum(n, 1)
            draw = np.round((s + _gumbel(b.column(at[0]).to_pylist(), as_bytes(b.column(at[1])), seed)) * 1e6).astype(np.int64)
            cols = b.columns if keep_columns else b.columns[:1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(s), pa.array(draw)], names=[*b.schema.names[: len(cols)], *names.values()])

    fields = list(df.schema.fields) if keep_columns else [df.schema["doc_id"]]
    return map_arrow(df, run, T.StructType([*fields, T.StructField(names["n_features"], T.LongType()), T.StructField(names["log_weight"], T.DoubleType()), T.StructField(names["draw"], T.LongType())]))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: histograms of 4096 cells narrow it down. None where k is 0 or the
    table has fewer rows."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n or n < k:
        return None
    left = k
    while lo < hi:
        cell = max(1, -(-(hi - lo + 1) // 4096))
        rows = df.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - {lo}L) div {cell}").alias("c")).count().collect()
        for c, m in sorted(((r["c"], r["count"]) for r in rows), reverse=True):
            if m >= left:
                lo, hi = lo + c * cell, min(hi, lo + (c + 1) * cell - 1)
                break
            left -= m
    return lo


def cut_of(scored: DataFrame, labels: Labels) -> float | None:
    """The log weight that best parts held-out target rows from toxic and from poor ones: the sum of the three kinds' shares that it places rightly, first
    such from below, so that few toxic rows count as much as many poor ones. The share of n rows counts n / (n + FEW_ROWS). None without target rows or
    without others."""
    held = {k: v[0] for k, v in labels.items() if v[1]}
    if not held:
        return None
    spark = scored.sparkSession
    ids = spark.createDataFrame([(int(k),) for k in held], "doc_id long")
    rows = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w")).collect()
    by_kind = {kind: np.sort([r["w"] for r in rows if held[r["doc_id"]] == kind]) for kind in (TARGET, TOXIC, POOR)}
    good, others = by_kind[TARGET], [x for kind, x in by_kind.items() if kind != TARGET and len(x)]
    if not len(good) or not others:
        return None
    at = np.unique([r["w"] for r in rows])
    gain = (len(good) - np.searchsorted(good, at)) / (len(good) + FEW_ROWS) + sum(np.searchsorted(x, at) / (len(x) + FEW_ROWS) for x in others)
    i = int(np.argmax(gain))
    # half way down to the next lower weight: the cut itself is no document's
    return float((at[i] + at[i - 1]) / 2) if i else float(at[0])


def train(docs: DataFrame, labels: DataFrame, keep_columns: bool = False) -> tuple[DataFrame, int | None]:
    """Stored scores (with_scores) and the draw's least key: k is how many documents weigh at least the cut, and the k
    largest Gumbel keys are drawn; ties at the last place are all drawn. Without labels of both kinds all are drawn (None).
    Texts are read twice, once for the models and once for the weights."""
    known = sampled_labels(labels)
    scored = stored(with_scores(docs, fit(docs, known), keep_columns=keep_columns), "scores")
    weight, draw = scored.columns[-2:]
    plain = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(weight).alias("log_weight"))
    cut = cut_of(plain, known)
    return scored, None if cut is None else kth_largest(scored, draw, plain.where(F.col("log_weight") >= cut).count())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, log_weight, draw, kept: every document with its decision. Null or wordless text weighs 0."""
    scored, least = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.lit(True) if least is None else F.col("draw") >= least)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are drawn, with their columns as they are. A null doc_id or text is a document like others (a null text weighs 0); rows
    that are equal have one key and stay or go together. An empty table gives no rows."""
    scored, least = train(docs, labels, keep_columns=True)
    return (scored if least is None else scored.where(F.col(scored.columns[-1]) >= least)).select(*docs.columns)


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
