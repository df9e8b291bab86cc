"""Substring dedup with a compressed FM-index per shard: backward search over wavelet trees gives matching statistics.

1. Each window of WINDOW words is routed by its minimizer, the least hash of the SEED-word grams in it: equal windows have equal
   minimizers. Minimizers that one document alone holds route nothing further.
2. The stretches of documents under the other minimizers are dealt to shards by minimizer. A shard indexes its distinct
   stretches (Burrows-Wheeler transform over word numbers and the documents in suffix order, each a wavelet matrix of packed bits with block
   counts; the suffix array isn't kept) and streams every stretch through the index by backward search. Windows whose interval holds a
   smaller doc_id, which the documents' wavelet matrix gives without listing the interval, are reported.
3. Each document drops the words that its reported windows cover.
Stretches that repeat word for word are told apart from the first of them while the rows stream by, so that groups of
copies don't grow an index; a minimizer with more distinct stretches than an index takes is searched block by block.

Minimizers and the rows that share a doc_id are told apart by 64-bit hashes; the index compares words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, gram_hashes, map_arrow, read_table, shuffle_partitions, signed, tune, word_hashes, words_of_rows

WINDOW, SEED = 13, 5
#: Words of an index; a shard has as many indexes as it needs, one after the other.
INDEX_WORDS = 150_000

Routes = tuple[np.ndarray, np.ndarray, np.ndarray]


def routes(texts: pa.Array, window: int = WINDOW, seed: int = SEED) -> list[Routes]:
    """Of each text the runs of windows with one minimizer: the minimizers, first windows, numbers of windows."""
    words, size = words_of_rows(texts)
    h = word_hashes(words)
    least = g = gram_hashes(h, seed) if len(h) >= window else np.zeros(0, np.uint64)
    if len(g):
        n = len(h) - window + 1
        least = g[:n].copy()
        for i in range(1, window - seed + 1):
            np.minimum(least, g[i : i + n], out=least)
    out = []
    for a, m in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
        n = m - window + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        mine = least[a : a + n]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out.append((mine[first], first, np.diff(np.append(first, n))))
    return out


class WaveletMatrix:
    """Ranks in a sequence of numbers: one packed bit vector a level, with a count before each 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.levels = len(seq), []
        cur = seq.astype(np.int64)
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((b, packed, before.astype(np.uint32), zeros))
            cur = np.concatenate([cur[~bit], cur[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        k = i >> 6
        return before[k].astype(np.int64) + np.bitwise_count(packed[k] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i, minus where c's block begins at the lowest level: add start(c) of the same kind."""
        for b, packed, before, zeros in self.levels:
            ones = self._ones(packed, before, i)
            i = np.where((c >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest number from lo to hi; no interval is empty."""
        out = np.zeros(len(lo), np.int64)
        for b, packed, before, zeros in self.levels:
            x, y = self._ones(packed, before, lo), self._ones(packed, before, hi)
            small = hi - y > lo - x
            out += np.where(small, 0, 1 << b)
            lo, hi = np.where(small, lo - x, zeros + x), np.where(small, hi - y, zeros + y)
        return out


class FMIndex:
    """Over stretches (lists of word numbers from 1 on, each ended by a 0); owner: each place's document."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int = WINDOW + 1):
        n = len(text)
        rank = text.astype(np.int64)
        k = 1
        # prefix doubling to the depth that searches need; ties beyond it stay in text order, which no such search can tell
        while k < depth:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (int(second.max()) + 1) + second
            sa = np.argsort(key, kind="stable")
            s = key[sa]
            new = np.empty(n, np.int64)
            new[sa] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank, k = new, 2 * k
            if rank.max() == n - 1:
                break
        sigma = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[sa - 1], sigma)
        self.owners, number = np.unique(owner, return_inverse=True)
        self.documents = WaveletMatrix(number[sa], len(self.owners))
        counts = np.bincount(text, minlength=sigma)
        self.c = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.n = n
        symbols = np.arange(sigma)
        self.base = self.wavelet.rank(symbols, np.zeros(sigma, np.int64))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of pattern."""
        shift = self.c[symbol] - self.base[symbol]
        return shift + self.wavelet.rank(symbol, lo), shift + self.wavelet.rank(symbol, hi)

    def matching(self, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics. For each place ends (one past a window's last word): how many words before it, at most longest, stand at two or more places
        of the index together, and the interval there. A search stops as soon as only its own place is left."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for t in range(1, longest + 1):
            a, b = self.step(text[ends[live] - t], lo[live], hi[live])
            ok = b - a >= 2
            live = live[ok]
            if not len(live):
                break
            lo[live], hi[live], length[live] = a[ok], b[ok], t
        return length, lo, hi


def _flags(index: list[tuple[list[bytes], int]], queries: list[tuple[list[bytes], int]], window: int) -> list[np.ndarray]:
    """For each query stretch (words, doc_id): which of its windows stand in the index under a smaller doc_id. Queries that aren't in the index
    are searched in an index that holds them too, under the largest number, so that a search needs two places in either case."""
    numbers: dict[bytes, int] = {}
    both = index if queries is index else index + queries
    ids = [[numbers.setdefault(w, len(numbers) + 1) for w in ws] for ws, _ in both]
    text = np.array([x for i in ids for x in (*i, 0)], np.int64)
    size = np.array([len(i) for i in ids])
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.full(len(text), np.iinfo(np.int64).max)
    for k in range(len(index)):
        owner[at[k] : at[k] + size[k]] = index[k][1]
    fm = FMIndex(text, owner, window + 1)
    asked = range(len(both)) if queries is index else range(len(index), len(both))
    ends = np.concatenate([np.arange(at[k] + window, at[k] + size[k] + 1) for k in asked])
    mine = np.concatenate([np.full(size[k] - window + 1, both[k][1]) for k in asked])
    length, lo, hi = fm.matching(text, ends, window)
    full = np.flatnonzero(length == window)
    out = np.zeros(len(ends), bool)
    if len(full):
        # intervals of equally long patterns are equal or apart
        starts, back = np.unique(lo[full], return_inverse=True)
        past = np.zeros(len(starts), np.int64)
        past[back] = hi[full]
        least = fm.owners[fm.documents.least(starts, past)]
        out[full] = least[back] < mine[full]
    return np.split(out, np.cumsum([size[k] - window + 1 for k in asked])[:-1])


def _spans(flags: np.ndarray, first: int, window: int) -> list[tuple[int, int]]:
    """Word ranges that flagged windows cover; first: the word where the stretch begins."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [(first + int(x[0]), first + int(x[-1]) + window) for x in np.split(at, cut)]


def _shard(batches: Iterator[pa.RecordBatch], window: int, index_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, stretch, doc_id, h, first) sorted by m, stretch, doc_id. Gives (doc_id, h, start, past), ranges of words."""
    out: list[tuple[int, int, int, int]] = []
    Row = tuple[list[bytes], int, list[tuple[int, int]]]  # a distinct stretch: words, its least doc_id, that document's places (h, first)
    groups: list[Row] = []  # whole minimizer groups that wait for one index
    group: list[Row] = []
    waiting = held = 0

    def report(rows: list[Row], flags: list[np.ndarray]) -> None:
        for (_, d, places), f in zip(rows, flags, strict=True):
            for h, first in places:
                out.extend((d, h, a, b) for a, b in _spans(f, first, window))

    def bare(rows: list[Row]) -> list[tuple[list[bytes], int]]:
        return [(ws, d) for ws, d, _ in rows]

    def search(rows: list[Row]) -> None:
        part = bare(rows)
        report(rows, _flags(part, part, window))

    def blocks(rows: list[Row]) -> None:
        """A group too large for one index: each block is searched by itself and by all other blocks."""
        parts: list[list[Row]] = [[]]
        size = 0
        for r in rows:
            if size > index_words // 2:
                parts.append([])
                size = 0
            parts[-1].append(r)
            size += len(r[0])
        for i, x in enumerate(parts):
            search(x)
            for j, y in enumerate(parts):
                if i != j:
                    report(y, _flags(bare(x), bare(y), window))

    def close() -> None:
        nonlocal groups, waiting
        if len({d for _, d, _ in group}) < 2:
            return
        if held > index_words:
            blocks(group)
            return
        groups += group
        waiting += held
        if waiting > index_words // 2:
            search(groups)
            groups, waiting = [], 0

    def emit() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "h", "start", "past"])
        out.clear()
        return b

    last_m = last_s = None
    for b in batches:
        for m, s, d, h, first in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            if m != last_m:
                close()
                group, held, last_m, last_s = [], 0, m, None
            if s != last_s:
                words = s.split()
                group.append((words, d, [(h, first)]))
                held += len(words)
                last_s = s
            elif d > group[-1][1]:  # word for word the stretch of a smaller doc_id
                out.append((d, h, first, first + len(group[-1][0])))
            else:
                group[-1][2].append((h, first))
        if len(out) > 8192:
            yield emit()
    close()
    if groups:
        search(groups)
    if out:
        yield emit()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (m, doc_id) sorted, the rows (doc_id, m) of minimizers that two documents or more hold. Between batches it keeps the last
    minimizer's document while that is the only one."""
    cur_m = None
    two_already = False
    wait = np.zeros((2, 0), np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        m, d = np.concatenate([wait, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])], axis=1)
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.append(start[1:], len(m)) - 1
        two = d[start] != d[last]
        if two_already and m[0] == cur_m:
            two[0] = True
        pick = np.repeat(two, last - start + 1)
        if pick.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[pick]), pa.array(m[pick])], names=["doc_id", "m"])
        cur_m, two_already = m[-1], bool(two[-1])
        wait = np.zeros((2, 0), np.int64) if two_already else np.array([[m[-1]], [d[-1]]])


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Null and empty texts have no words. Rows with a null doc_id neither remove nor lose words. Rows that share a
    doc_id don't remove each other's words; those with equal texts give equal rows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    n = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    # a key that is never null: else one join would filter nulls, and the two could not share an exchange
    base = base.withColumn("k", F.coalesce("doc_id", "h"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [np.unique(m) for m, _, _ in routes(b.column(1), window, seed)]
            owners = np.repeat(b.column(0).to_numpy(), [len(m) for m in ms])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(ms))), pa.array(owners)], names=["m", "doc_id"])

    routed = map_arrow(base.where("doc_id is not null").select("doc_id", "text"), route, "m long, doc_id long").repartition(n, "m").sortWithinPartitions("m", "doc_id")
    flagged = routed.mapInArrow(_shared, "doc_id long, m long").groupBy("doc_id").agg(F.collect_set("m").alias("ms"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, t, (m, first, count), ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), routes(b.column(2), window, seed), b.column(3), strict=True):
                if d is None:
                    continue
                words = t.split()
                key = signed(m)
                for i in np.flatnonzero(np.isin(key, ms.values.to_numpy())).tolist():
                    a = int(first[i])
                    rows.append((int(key[i]), b" ".join(words[a : a + int(count[i]) + window - 1]), d, h, a))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["m", "stretch", "doc_id", "h", "first"])

    # either join reads the same exchange of texts by doc_id
    with_flags = base.join(flagged.withColumnRenamed("doc_id", "k"), "k").select("doc_id", "h", "text", "ms")
    found = map_arrow(with_flags, stretches, "m long, stretch binary, doc_id long, h long, first long")
    sharded = found.repartition(n, "m").sortWithinPartitions("m", "stretch", "doc_id")
    spans = map_arrow(sharded, lambda batches: _shard(batches, window, index_words), "doc_id long, h long, start long, past long")
    return _removed(base, spans)


def _removed(base: DataFrame, spans: DataFrame) -> DataFrame:
    by_doc = spans.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set(F.struct("h", "start", "past")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, h, t, sp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = t.split()
                gone = np.zeros(len(words), bool)
                for s in sp or ():
                    if s["h"] == h and d is not None:
                        gone[s["start"] : s["past"]] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if sp else words
                rows.append((d, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = base.join(by_doc, "k", "left").select("doc_id", "h", "text", "spans")
    return map_arrow(rows, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a smaller doc_id has: dedup."""
    return dedup(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_fm": op7_substring_fm}
SQL = {
    "op7_substring_fm": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (k) WHERE m < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
