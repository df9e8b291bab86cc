"""N-gram Jaccard join: globally ordered shingle sets in prefix trees, traversed with shared partial overlaps and pruned by bounds.

1. One pass counts shingles in a hashed table per task and reports the buckets that stand out; these order all shingles from
   rare to common (any order gives the same links; this one keeps passages that many documents share out of prefixes). The same pass
   gives each document's set size and digest: documents with one digest are one class.
2. Sets that share 80 % share a shingle among the first n - ceil(0.8 n) + 1 of either. Prefix shingles are dealt by value, each with its
   set's size and its place in the set: of two sets' first common shingle, the shorter rest bounds their overlap. Classes that share one
   and whose sizes and places leave a link possible, directly or by others, are named after the smallest of them, their block's centre.
   Every pair that can link is in one block at least. Members whose counts of shingles in parts of the hash space rule out a link with
   any other member leave the block: the sum of the cells' lesser counts bounds an overlap from above, so no link is lost.
3. Each block is a trie of its sets, common shingles first, so that near copies share paths. A probe goes down with its overlap so
   far and leaves subtrees that can't reach the threshold, or whose sets it is connected with already: only what changes
   connectivity is reported, never all pairs of a group.
4. Blocks above BLOCK_SETS or BLOCK_SHINGLES lose members in the same way, by every two of their chunks; what is left is dealt in chunks that all hold the centre; sets that a chunk did not connect with the
   centre then probe the other chunks.
5. Links between classes give connected components.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, gram_hashes, map_arrow, read_table, shuffle_partitions, signed, small, stored, tune, word_hashes, words_of_rows

SHINGLE, PERCENT = 5, 80
#: Buckets of the table that orders shingles; its reported part goes to the executors (at most 12 bytes a bucket).
ORDER_BUCKETS = 1 << 22
#: Sets of a block's chunk, and shingles (8 bytes each) in all its sets, on average.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 4_000_000
#: Least and largest number of parts of the hash space whose counts (a byte each; 255 or more bounds nothing) bound overlaps; a
#: set has parts for four to eight shingles each.
CELLS = 64, 1 << 16
#: Sets of a shared shingle that are compared one by one, by size and place; of more, only gaps between sizes are looked for.
RUN = 64


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word k-grams, A-Z lower-cased; a text of fewer words is one shingle, one without words none."""
    words, n = words_of_rows(texts, lower=True)
    w = word_hashes(words)
    grams, at, out = gram_hashes(w, k) if len(w) >= k else w, np.cumsum(n) - n, []
    for a, m in zip(at.tolist(), n.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(grams[a : a + m - k + 1]))
        else:
            out.append(gram_hashes(w[a : a + m], m) ^ np.uint64(m) if m else np.zeros(0, np.uint64))
    return out


def cells(s: np.ndarray) -> bytes:
    k = min(max(CELLS[0], 1 << max(0, (len(s) - 1) // 8).bit_length()), CELLS[1])
    return np.minimum(np.bincount((s >> np.uint64(65 - k.bit_length())).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, n, digest), then a row for each bucket that stands out (bucket, count)."""
    counts, waiting, held = np.zeros(ORDER_BUCKETS, np.int64), [], 0
    names = ["doc_id", "n", "d", "cells", "bucket", "c"]
    none = lambda k, t: pa.nulls(k, t)
    for b in batches:
        sets = shingle_sets(b.column(1))
        waiting += sets
        held += sum(map(len, sets))
        if held > 1 << 20:
            counts += np.bincount((np.concatenate(waiting) & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64), minlength=ORDER_BUCKETS)
            waiting, held = [], 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([cells(s) for s in sets], pa.binary()), none(len(sets), pa.int32()), none(len(sets), pa.int64())], names=names)
    if waiting:
        counts += np.bincount((np.concatenate(waiting) & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64), minlength=ORDER_BUCKETS)
    # chance alone gives a bucket its mean and a few roots of it
    at = np.flatnonzero(counts > counts.mean() + 4 * counts.mean() ** 0.5 + 8)
    if len(at):
        yield pa.RecordBatch.from_arrays([none(len(at), pa.int64()), none(len(at), pa.int64()), none(len(at), pa.int64()), none(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=names)


def ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set from rare to common: by the order of magnitude of the bucket's count, then by hash."""
    return s[np.lexsort((s, common[(s & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)]))]


class Trie:
    """Sets over common shingles, as a path-compressed trie: leaves in the order of their sequences, nodes as runs of one path."""

    def __init__(self, sets: list[np.ndarray]):
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((values, -counts))
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.shared = int((counts > 1).sum())  # shingles of one set alone can't overlap: they aren't stored
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        paths = [np.sort(rank[inverse[at[i] : at[i + 1]]]) for i in range(len(sets))]
        paths = [p[p < self.shared] for p in paths]
        self.leaf = sorted(range(len(sets)), key=lambda i: paths[i].tolist())
        self.paths = [paths[i] for i in self.leaf]
        self.size = np.array([len(sets[i]) for i in self.leaf])
        self.length = np.array([len(p) for p in self.paths])
        common = [self._common(a, b) for a, b in zip(self.paths, self.paths[1:])]
        self.common = np.array(common, np.int64)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        d = np.flatnonzero(a[:n] != b[:n])
        return int(d[0]) if len(d) else n

    def links(self, percent: int, probes: set[int] | None = None) -> list[tuple[int, int]]:
        """Pairs (leaf's set, leaf's set) that link, those left out that earlier pairs connect. probes: sets that probe; all by default."""
        m, out = len(self.paths), []
        label = np.arange(m)
        for x in range(m):
            if probes is not None and self.leaf[x] not in probes:
                continue
            mine = np.zeros(self.shared + 1, bool)
            mine[self.paths[x]] = True
            below = np.concatenate([[0], np.cumsum(mine)])  # of x's shingles, how many rank lower
            total, nx = int(below[-1]), int(self.size[x])
            lo0 = x + 1 if probes is None else 0
            stack = [(lo0, m, 0, 0)]
            while stack:
                lo, hi, depth, overlap = stack.pop()
                if lo >= hi or (label[lo:hi] == label[x]).all():
                    continue
                # the node: what all leaves from lo to hi share beyond depth
                end = int(self.length[lo] if hi - lo == 1 else min(self.common[lo : hi - 1].min(), self.length[lo]))
                run = self.paths[lo][depth:end]
                overlap += int(mine[run].sum())
                # x's shingles that rank above the path so far, and the longest rest below this node, bound what is to come
                rest_x = total - int(below[self.paths[lo][end - 1] + 1]) if end else total
                bound = overlap + min(rest_x, int(self.length[lo:hi].max()) - end)
                if (100 + percent) * bound < percent * (nx + int(self.size[lo:hi].min())):
                    continue
                if hi - lo == 1:
                    if label[lo] != label[x] and (100 + percent) * overlap >= percent * (nx + int(self.size[lo])):
                        out.append((self.leaf[x], self.leaf[lo]))
                        a, b = int(label[x]), int(label[lo])
                        label[label == max(a, b)] = min(a, b)
                    continue
                # children: where neighbours part at this depth
                cuts = [lo, *(np.flatnonzero(self.common[lo : hi - 1] == end) + lo + 1).tolist(), hi]
                stack += [(a, b, end, overlap) for a, b in zip(cuts, cuts[1:])][::-1]
        return out


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (centre, chunk): one trie a chunk. Gives (centre, chunk, d, root); root is the smallest digest of d's
    connected set in the chunk."""
    def flush(key: tuple, rows: dict[int, tuple[np.ndarray, bool]]) -> Iterator[tuple]:
        ids = list(rows)
        probes = {i for i, d in enumerate(ids) if rows[d][1]}
        root = {d: d for d in ids}

        def find(d: int) -> int:
            while root[d] != d:
                root[d] = root[root[d]]
                d = root[d]
            return d

        if len(ids) > 1:
            for i, j in Trie([rows[d][0] for d in ids]).links(percent, probes or None):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
        yield from ((*key, d, find(d)) for d in ids)

    def rows_of() -> Iterator[tuple]:
        key, rows = None, {}
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            for i, s in enumerate(shingle_sets(b.column(4))):
                k = (cols[0][i], cols[1][i])
                if k != key:
                    if key is not None:
                        yield from flush(key, rows)
                    key, rows = k, {}
                d = digest(s)
                if d not in rows or cols[3][i]:
                    rows[d] = (s, bool(cols[3][i]))
        if key is not None:
            yield from flush(key, rows)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["center", "chunk", "d", "root"])

    out: list[tuple] = []
    for r in rows_of():
        out.append(r)
        if len(out) >= 8192:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of blocks' rows (center, low, high, d, n, cells, chunks) sorted by the first three, those that the cells' counts don't keep apart from all others with
    these three: (center, d, chunks)."""
    def partners(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        n = np.array([r[4] for r in rows])
        kinds = np.array([len(r[5]) for r in rows])
        counts = [np.frombuffer(r[5], np.uint8) for r in rows]
        free = np.array([c.max() == 255 for c in counts])
        keep = free.copy()
        if free.any():
            keep[:] = True
        for k in np.unique(kinds).tolist():
            # sets of as many cells against them and those of more, whose neighbouring cells are added up
            fine = np.flatnonzero(kinds >= k)
            v = np.stack([counts[i] if len(counts[i]) == k else counts[i].reshape(k, -1).sum(1, dtype=np.uint16) for i in fine])
            for at, i in enumerate(fine.tolist()):
                if kinds[i] != k:
                    continue
                near = np.flatnonzero((100 * n[fine] >= percent * n[i]) & (100 * n[i] >= percent * n[fine]))
                near = near[near != at]
                if len(near):
                    bound = np.minimum(v[at], v[near]).sum(1, dtype=np.int64)
                    ok = (100 + percent) * bound >= percent * (n[fine[near]] + n[i])
                    if ok.any():
                        keep[i] = True
                        keep[fine[near[ok]]] = True
        for i in np.flatnonzero(keep).tolist():
            yield rows[i][0], rows[i][3], rows[i][6]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["center", "d", "chunks"])

    out, rows, key = [], [], None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:3] != key:
                out += partners(rows) if len(rows) > 1 else ()
                rows, key = [], r[:3]
            rows.append(r)
        if len(out) > 8192:
            yield batch(out)
            out = []
    out += partners(rows) if len(rows) > 1 else ()
    if out:
        yield batch(out)


def largest_partner(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that can link with one of n shingles whose first shared shingle is its place-th (from 0): all they share is in what is left."""
    return (100 + percent) * (n - place) // percent - n


def _centres(token: np.ndarray, d: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (token, n, d), d distinct for a token: each row's centre (a row's number), and whether it can link with another row of its token.
    Rows i and j of a token can, where n[j] <= most[i] and n[i] <= most[j]. Tokens of more than RUN rows aren't looked at closely."""
    at = np.arange(len(token))
    first = np.concatenate([[True], token[1:] != token[:-1]])
    start = np.maximum.accumulate(np.where(first, at, 0))
    size = np.diff(np.append(np.flatnonzero(first), len(token)))[np.cumsum(first) - 1]
    centre, keep = at.copy(), size > RUN
    centre[keep] = start[keep]
    rows = np.flatnonzero((size > 1) & ~keep)
    us, vs = [], []
    for step in range(1, min(RUN, int(size[rows].max(initial=1)))):
        rows = rows[rows + step < len(token)]
        rows = rows[start[rows + step] == start[rows]]
        pair = rows[(n[rows + step] <= most[rows]) & (n[rows] <= most[rows + step])]
        us.append(pair)
        vs.append(pair + step)
    u, v = (np.concatenate(x) if x else np.zeros(0, int) for x in (us, vs))
    keep[u] = keep[v] = True
    while (centre[u] != centre[v]).any():
        least = np.minimum(centre[u], centre[v])
        np.minimum.at(centre, u, least)
        np.minimum.at(centre, v, least)
    return centre, keep


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(center, d) of rows (token, d, n, most) sorted by (token, n, d): the classes of a shingle that can link, directly or by others, with their centre. Holds a
    batch at a time, and the last shingle's centre; a shingle that goes beyond a batch is cut only where a size is beyond what any smaller set can link with."""
    token = centre = last = None
    top = 0
    for b in batches:
        t, d, n, most = (c.to_numpy() for c in b.columns)
        if not len(t):
            continue
        fresh = np.concatenate([[t[0] != token or d[0] != last], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
        # of rows of one class and shingle, which are equal, the first one counts
        t, d, n, most = t[fresh], d[fresh], n[fresh].astype(np.int64), most[fresh].astype(np.int64)
        if not len(t):
            continue
        # what any row so far of the shingle can link with; shingles are kept apart by their number
        first = np.concatenate([[t[0] != token], t[1:] != t[:-1]])
        number = np.cumsum(first)
        reach = np.where(np.arange(len(t)) == 0, np.maximum(most, 0 if first[0] else top), np.maximum(most, 0)) + (number << 40)
        reach = np.maximum.accumulate(reach) - (number << 40)
        begins = first.copy()
        begins[1:] |= n[1:] > reach[:-1]
        if not first[0]:
            begins[0] = n[0] > top
        run = np.cumsum(begins)
        # a run that other batches hold a part of goes as it is
        open_ = (number == number[-1]) | ((number == number[0]) & (not first[0]))
        c, keep = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        inner = np.flatnonzero(~open_)
        if len(inner):
            at, ok = _centres(run[inner], d[inner], n[inner], most[inner])
            c[inner], keep[inner] = d[inner][at], ok
        start = np.maximum.accumulate(np.where(begins, np.arange(len(t)), -1))
        whole = np.where(start >= 0, d[np.maximum(start, 0)], centre if centre is not None else 0)
        c[open_], keep[open_] = whole[open_], True
        pick = keep & (d != c)
        if pick.any():
            pairs = np.unique(np.stack([c[pick], d[pick]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["center", "d"])
        token, centre, last, top = t[-1], whole[-1], d[-1], int(reach[-1])


def _joined(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """blocks (center, chunk, d, probe, doc_id) with texts, each chunk in one task."""
    n = shuffle_partitions(blocks.sparkSession)
    # most texts are in no block: where the blocks' rows are few enough, only those that are meet a shuffle
    rows = texts.join(small(blocks), "doc_id").select("center", "chunk", "d", "probe", "text")
    dealt = rows.repartition(n, "center", "chunk").sortWithinPartitions("center", "chunk")
    return map_arrow(dealt, lambda batches: _block_links(batches, percent), "center long, chunk int, d long, root long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Null and wordless texts have no shingles and are their own component. Rows that share a doc_id are rows of one vertex: each
    keeps its own n_shingles and the component of its own text's class. A class whose rows all lack a doc_id takes part in no link, and
    its component is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    scan = stored(map_arrow(base, _scan, "doc_id long, n long, d long, cells binary, bucket int, c long"), "sets")
    top = scan.where("bucket is not null").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # at most ORDER_BUCKETS rows
    common = np.zeros(ORDER_BUCKETS, np.int8)
    common[top["bucket"].to_numpy()] = np.log2(np.maximum(1, top["c"].to_numpy())).astype(np.int8)
    sent = spark.sparkContext.broadcast(common)
    sets = scan.where("bucket is null").drop("bucket", "c")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, owners, sizes, most = [], [], [], []
            for s in shingle_sets(b.column(0)):
                if len(s):
                    p = ordered(s, sent.value)[: prefix_size(len(s), percent)]
                    tokens.append(p)
                    owners.append(np.full(len(p), digest(s), np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    most.append(largest_partner(len(s), np.arange(len(p)), percent))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(most).astype(np.int32))], names=["token", "d", "n", "most"])

    n = shuffle_partitions(spark)
    dealt = map_arrow(base.select("text"), prefixes, "token long, d long, n int, most int").repartition(n, "token").sortWithinPartitions("token", "n", "d")

    pairs = dealt.mapInArrow(_blocks_of, "center long, d long").groupBy("center", "d").agg(F.lit(1).alias("one")).drop("one")
    pairs = stored(pairs, "pairs")
    # one document stands for its class
    classes = stored(sets.where("d is not null").groupBy("d").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("cells").alias("cells")), "classes")
    # a block's centre is one of its members; sizes are stored, so that their join is one that Spark splits where a centre is hot
    rows = stored(pairs.unionByName(pairs.select("center", F.col("center").alias("d")).distinct()).join(classes.select("d", "n"), "d"), "members")
    sizes = stored(rows.groupBy("center").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")), "sizes")
    rows = rows.join(sizes, "center")
    chunks = F.greatest(F.ceil(F.col("members") / F.lit(block_sets)), F.ceil(F.col("shingles") / F.lit(block_shingles)), F.lit(1)).cast("int")
    rows = rows.withColumn("chunks", chunks)
    # members that the bound keeps apart from all others leave; the rows of a block of several chunks meet in every two of these, as cells and not as texts
    at, other = F.pmod(F.xxhash64("d"), F.col("chunks")).cast("int"), F.col("other")
    met = rows.select("center", "d", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("center", "d", "chunks", F.least(at, other).alias("low"), F.greatest(at, other).alias("high"))
    met = met.join(classes, "d").select("center", "low", "high", "d", "n", "cells", "chunks").repartition(n, "center", "low", "high").sortWithinPartitions("center", "low", "high")
    left = stored(met.mapInArrow(lambda batches: _possible(batches, percent), "center long, d long, chunks int"), "possible")
    few = left.where("chunks = 1").select("center", "d", "chunks", F.lit(0).alias("chunk"))
    many = left.where("chunks > 1").select("center", "d")
    many = many.unionByName(many.select("center", F.col("center").alias("d"))).distinct()
    smaller = stored(many.join(classes.select("d", "n"), "d").groupBy("center").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")), "sizes")
    many = many.join(smaller.select("center", chunks.alias("chunks")), "center")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    many = many.select("center", "d", "chunks", F.explode(F.when(F.col("d") == F.col("center"), every).otherwise(F.array(at))).alias("chunk"))
    blocks = stored(few.unionByName(many), "blocks")
    stands = classes.select("d", F.col("least").alias("doc_id"))
    first = stored(_joined(blocks.join(stands, "d").select("center", "chunk", "d", F.lit(False).alias("probe"), "doc_id"), base, percent), "links")
    links = first.where("d <> root").select(F.col("d").alias("u"), F.col("root").alias("v"))
    if not blocks.where("chunks > 1").isEmpty():
        big = blocks.where("chunks > 1")
        # in a chunk, those that are not in the centre's component
        roots = first.where("d = center").select("center", "chunk", F.col("root").alias("centre_root"))
        loose = first.join(roots, ["center", "chunk"], "left").where("centre_root is null or root <> centre_root").select("center", "d").join(big.select("center", "chunks").distinct(), "center")
        probes = loose.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("center", "chunk", "d", F.lit(True).alias("probe"))
        hit = probes.select("center", "chunk").distinct()
        again = big.join(hit, ["center", "chunk"]).select("center", "chunk", "d", F.lit(False).alias("probe")).unionByName(probes)
        second = stored(_joined(again.join(stands, "d").select("center", "chunk", "d", "probe", "doc_id"), base, percent), "links2")
        links = links.unionByName(second.where("d <> root").select(F.col("d").alias("u"), F.col("root").alias("v")))
    comp = components(links)
    labelled = stored(classes.join(comp, classes["d"] == comp["u"], "left").select("d", "least", F.coalesce("root", "d").alias("root")), "labelled")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(ids, "root").select("d", "component_id")
    return sets.join(by_class, "d", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_class(rows: DataFrame) -> DataFrame:
    """rows with _class, the digest of the text's shingles; null without shingles."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(s) if len(s) else None for s in sets], pa.int64())], names=[*b.schema.names, "_class"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("_class", T.LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; repeated rows of the kept document stay as they are. Columns stay.

    Rows without a doc_id: those with the shingles of a document that has one go, and one row of each other class stays; those without shingles all
    stay. They have no links beyond their class."""
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"))
    # those that go are far fewer than those that stay, so that texts seldom meet a shuffle
    gone = stored(found.where("not kept").select(F.col("doc_id").alias("_gone_id")), "gone")
    key = docs["doc_id"].cast("long")
    kept = docs.where(key.isNotNull()).join(small(gone), key == F.col("_gone_id"), "left_anti")
    lone = docs.where(key.isNull())
    if lone.isEmpty():
        return kept
    lone = _with_class(lone)
    named = _with_class(docs.where(key.isNotNull()).select("text")).where("_class is not null").select("_class").distinct()
    n = F.row_number().over(Window.partitionBy("_class").orderBy(F.xxhash64("text"), "text"))
    first = lone.where("_class is not null").join(named, "_class", "left_anti").withColumn("_n", n).where("_n = 1")
    return kept.unionByName(first.select(*docs.columns)).unionByName(lone.where("_class is null").select(*docs.columns))


def op5_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: near_duplicates."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_jaccard_trie": op5_jaccard_trie}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = {
    "op5_jaccard_trie": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE u.b > r.c)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
}
