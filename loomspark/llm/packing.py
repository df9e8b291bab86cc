"""Best-fit packing by a grouping genetic algorithm: islands evolve packings of a shard of pieces and send their elites on.

A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates, and best-fits the displaced pieces. Each shard has a bounded number of pieces; its islands are rows of their own,
evolve in tasks of their own, and after each epoch the elite of an island moves to the next island of the ring. The emptiest bins of all
shards are then opened and their pieces packed again together, level by level, until one shard holds them: shards cost next to no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, map_arrow, read_table, shuffle_partitions, stored, tune
from .tokens import TokenIds, grouped, token_file

CAPACITY, END_ID = 2048, 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces a shard holds on average; a shard is one row, so this bounds a row.
SHARD_PIECES = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 4, 6
#: The share of a shard's bins, the emptiest ones, that is packed again with those of other shards, as 1 in LOOSE.
LOOSE = 4


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the bin it fills best; opens bins as needed. Changes bins and room."""
    order = sorted((r, i) for i, r in enumerate(room) if r)
    for it in items:
        s = size[it]
        k = bisect_left(order, (s, -1))
        if k < len(order):
            r, b = order.pop(k)
            bins[b].append(it)
            room[b] = r - s
            if r > s:
                insort(order, (r - s, b))
        else:
            bins.append([it])
            room.append(capacity - s)
            if capacity > s:
                insort(order, (capacity - s, len(bins) - 1))


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among as many, fuller bins beside emptier ones are."""
    return len(room), -sum(((capacity - r) / capacity) ** 2 for r in room) / max(1, len(room))


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    full = [x for x in b if sum(size[i] for i in x) >= 0.98 * capacity]
    take = [full[i] for i in rng.permutation(len(full))[: max(1, len(full) // 4)]] if full else []
    came = {i for x in take for i in x}
    bins, displaced = [list(x) for x in take], []
    for x in a:
        if came.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [i for i in x if i not in came]
    room = [capacity - sum(size[i] for i in x) for x in bins]
    # the emptiest bins go too, so that their pieces may close gaps
    for i in sorted(sorted(range(len(bins)), key=room.__getitem__)[-max(1, len(bins) // 50) :], reverse=True):
        displaced += bins.pop(i)
        room.pop(i)
    best_fit(bins, room, sorted(displaced, key=lambda i: -size[i]), size, capacity)
    return bins, room


def evolve(size: list[int], capacity: int, seed: int, immigrant: list[list[int]] | None = None, own: list[list[int]] | None = None, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing an island finds. Stops where the lower bound (tokens over capacity) is met."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // capacity)
    people: list[tuple[tuple[int, float], list[list[int]]]] = []

    def add(bins: list[list[int]], room: list[int] | None = None) -> None:
        people.append((fitness(room if room is not None else [capacity - sum(size[i] for i in x) for x in bins], capacity), bins))

    for bins in (own, immigrant):
        if bins is not None:
            add(bins)
    order = np.array(size)
    while len(people) < population and not (people and people[0][0][0] <= least):
        # the first is best-fit decreasing; others start from sizes blurred a little
        blur = order + (rng.integers(0, capacity // 8 + 1, len(size)) if people else 0)
        bins, room = [], []
        best_fit(bins, room, np.argsort(-blur, kind="stable").tolist(), size, capacity)
        add(bins, room)
        people.sort(key=lambda p: p[0])
    people.sort(key=lambda p: p[0])
    for _ in range(generations):
        if people[0][0][0] <= least:
            break
        i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        add(*crossover(people[min(i, j)][1], people[max(i, j)][1], size, capacity, rng))
        people.sort(key=lambda p: p[0])
        del people[population:]
    return people[0][1]


def _to_row(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, x in enumerate(bins):
        out[x] = b
    return out


def _to_bins(row: np.ndarray | None) -> list[list[int]] | None:
    if row is None or not len(row):
        return None
    order = np.argsort(row, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(row[order])) + 1)]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids (with the end id), cut so that only the first
    piece is shorter than capacity. Null text is empty: a piece of the end id alone. A null doc_id stays null; repeated rows give equal pieces
    each. An empty table gives no rows."""
    file = file or token_file("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TokenIds.of(file, True)
        for b in grouped(batches):
            rows = []
            ids, at = enc.encode(as_text(b.column(1)), end_id)
            view, at = memoryview(ids).cast("B"), at.tolist()
            for k, lo, hi in zip(b.column(0).to_pylist(), at, at[1:], strict=False):
                n = hi - lo
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(k, p, i, j - i, zlib.crc32(view[4 * (lo + i) : 4 * (lo + j)])) for p, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, PIECE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt to shards at random (by hash), so that each shard has the corpus's mix of lengths. Repeated rows are pieces of their own,
    null doc_ids too. An empty table gives no rows.
    """
    rest, done, level = stored(pieces, "pieces"), [], 0
    while True:
        n = rest.count()
        if not n and done:
            break
        shards = max(1, -(-n // shard_pieces))
        packed = stored(_packed(rest, capacity, shards, level), f"level{level}")
        done.append(packed.where("not loose").drop("loose"))
        if shards == 1:
            break
        rest, level = packed.where("loose").select("doc_id", "piece", "start", "length", "ids_crc32"), level + 1
    return reduce(DataFrame.unionByName, done)


def _lists(column: pa.ListArray, field: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A field of all rows' structs, and where each row's begin and end."""
    at = column.offsets.to_numpy()
    return column.values.field(field).to_numpy(zero_copy_only=False), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _packed(rows: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """rows with sequence_id, offset and loose: whether the piece's bin is one of its shard's emptiest, where there are other shards.

    Each shard is packed by best fit first; islands evolve those that need more sequences than their tokens fill.
    """
    n = shuffle_partitions(rows.sparkSession)
    tune(rows.sparkSession)
    # a row's own number parts repeated rows; reading a stored table numbers them alike each time
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(shards)))
    members = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("m"))
    members = stored(members, "shards")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, spans = _lists(b.column(1), "length")
            own, bins, least = [], [], []
            for i, j in spans:
                size, packed, room = lengths[i:j].tolist(), [], []
                best_fit(packed, room, range(j - i - 1, -1, -1), size, capacity)
                own.append(_to_row(packed, j - i))
                bins.append(len(packed))
                least.append(-(-sum(size) // capacity))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(bins, pa.int32()), pa.array(least, pa.int32())], names=["shard", "own", "bins", "least"])

    best = stored(members.mapInArrow(first, "shard long, own array<int>, bins int, least int"), "first")
    open_ = best.where("bins > least")
    if not open_.isEmpty():
        state = members.join(open_, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("m.length").alias("sizes"), "own", F.lit(None).cast("array<int>").alias("immigrant"))
        for epoch in range(EPOCHS):
            def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
                for f in frames:
                    found, bins = [], []
                    for shard, island, sizes, own, guest in zip(f["shard"], f["island"], f["sizes"], f["own"], f["immigrant"], strict=True):
                        got = evolve([int(x) for x in sizes], capacity, int(shard) * 1009 + int(island) * 31 + epoch, _to_bins(guest), _to_bins(own))
                        found.append(_to_row(got, len(sizes)))
                        bins.append(len(got))
                    yield f[["shard", "island", "sizes"]].assign(own=found, bins=bins)

            evolved = stored(state.repartition(n, "shard", "island").mapInPandas(run, "shard long, island int, sizes array<long>, own array<int>, bins int"), f"epoch{epoch}")
            guests = evolved.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("immigrant"))
            state = evolved.drop("bins").join(guests, ["shard", "island"])
        best = best.where("bins <= least").select("shard", "own").unionByName(evolved.groupBy("shard").agg(F.min_by("own", F.struct("bins", "island")).alias("own")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, spans = _lists(b.column(1), "length")
            sequence, offset, loose = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            for shard, (i, j), own in zip(b.column(0).to_pylist(), spans, b.column(2), strict=True):
                bins = own.values.to_numpy().astype(np.int64)
                order = np.argsort(bins, kind="stable")
                sizes = lengths[i:j][order]
                before = np.cumsum(sizes) - sizes
                first_of = np.concatenate([[True], np.diff(bins[order]) > 0])
                offset[i + order] = before - np.maximum.accumulate(np.where(first_of, before, 0))
                sequence[i:j] = (level << 56) + (shard << 24) + bins
                if shards > 1:
                    fill = np.bincount(bins, weights=lengths[i:j])
                    emptiest = np.argsort(fill, kind="stable")[: max(1, len(fill) // LOOSE)]
                    loose[i:j] = np.isin(bins, emptiest[fill[emptiest] < capacity])
            m = b.column(1).values
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(m.field(x) for x in names), pa.array(sequence), pa.array(offset), pa.array(loose)], names=[*names, "sequence_id", "offset", "loose"])

    return members.join(best.select("shard", "own"), "shard").mapInArrow(placed, PIECE + ", sequence_id long, offset long, loose boolean")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITY tokens: pack of pieces_of."""
    return pack(pieces_of(read_table(spark, sf_dir, "documents")))


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
