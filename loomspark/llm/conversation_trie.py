"""Prefix trie of conversations: turn arrays are range-sorted globally, neighbours' longest common prefixes (LCPs) are taken, and a stack sweep turns the
LCP intervals into nodes; stacks that are open at a part's ends are stitched.

A turn is the MD5 of its role and text, so an array is a string of 32 digits a turn. An array holds the turns that another conversation has at
the same place; what follows a conversation's first turn that no other has there is a chain of nodes of its own, made row by row. So a conversation
of any length is no array, unless another one goes along with it.

Rows of one conversation are numbered by a global sort and found by looked_up, never by a window over the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, map_arrow, read_table, stored
from .sql import crc32
from .target_draw import ranked

#: Conversations of one group share its first conversation's first turns: up to KINDS - 1 of them.
GROUP, KINDS = 20, 4
#: Digits of a turn in an array, and turns of a part of the sorted arrays, in the mean.
WIDTH, PART_TURNS = 32, 500_000
#: Characters of a piece of the conversations that end in one node.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: What a row of the sweep is: a node, a node whose parent is a fragment, a fragment, a part's first and last array, and a piece of a fragment's ends.
NODE, CHILD, FRAGMENT, FIRST, LAST, ENDS = range(6)
_COLUMNS = ("kind", "part", "no", "parent_no", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "words", "is_first", "is_last", "text")
_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of every turn with a conv_id. Null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words")
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, digest, words) of the rebuilt conversations, from pos 0, and every conversation's length; both stored.

    Turns go by turn number (null first), equal ones by digest. The first h (the CRC-32 of the decimal conv_id modulo KINDS) are those of the group's first
    conversation, as far as it has them; the conversation's own follow from its h-th on.
    """
    rows = ranked(turn_rows(conversations), "conv_id", "turn", "digest")
    sizes = stored(rows.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "sizes")
    plan = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % KINDS).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = stored(plan.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "plan")
    placed = stored(looked_up(rows, plan.select("conv_id", "start", "h", "taken"), "conv_id", F.col("rank")).withColumn("at", F.col("rank") - F.col("start")), "placed")
    own = placed.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    heads = placed.where(f"conv_id % {GROUP} = 0 and at < {KINDS - 1}").select(F.col("conv_id").alias("base"), F.col("at").alias("pos"), "digest", "words")
    first = plan.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "digest", "words")
    return stored(own.unionByName(first), "turns"), plan.select("conv_id", "length")


def arrays(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's array (conv_id, key, words, more: its turns that aren't in the array), and the turns behind the first of these (conv_id,
    pos, length). An array ends before the first turn that no other conversation has at its place."""
    alone = turns.groupBy("pos", "digest").agg(F.count("*").alias("n"), F.first("conv_id").alias("conv_id")).where("n = 1").groupBy("conv_id").agg(F.min("pos").alias("cut"))
    cuts = stored(lengths.join(alone, "conv_id", "left").select("conv_id", "length", F.coalesce("cut", "length").alias("shared")), "cuts")
    rows = stored(looked_up(turns, cuts, "conv_id", F.col("pos")), "shared")
    made = rows.where("pos < shared").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("a"))
    full = cuts.join(made.select("conv_id", F.array_join("a.digest", "").alias("key"), F.col("a.words").alias("words")), "conv_id", "left")
    keys = full.select("conv_id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("words", F.array().cast("array<int>")).alias("words"), (F.col("length") - F.col("shared")).alias("more"))
    return stored(keys, "keys"), rows.where("pos > shared").select("conv_id", "pos", "length")


def lcp(a: str, b: str) -> int:
    """Turns that two arrays have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    lo, hi = 0, n // WIDTH  # the first lo turns are equal, the first hi aren't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * WIDTH] == b[: mid * WIDTH] else (lo, mid)
    return lo


class Node:
    """An open node: sums over what it holds so far without its fragments below."""

    __slots__ = ("children", "conv", "convs", "digest", "ends", "first", "leaves", "no", "rows", "saved", "words")

    def __init__(self, no: int, words: int, first: bool):
        self.no, self.words, self.first = no, words, first
        self.conv, self.convs, self.children, self.leaves, self.saved, self.ends, self.digest, self.rows = None, 0, 0, 0, 0, 0, None, []

    def add(self, conv: int | None, convs: int, children: int, leaves: int, saved: int) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def whole(self) -> tuple[int, int]:
        """Leaves and saved tokens of the closed node's subtree."""
        return (self.leaves if self.children else 1), self.saved + (self.convs - 1) * self.words


def swept(part: int, rows: Iterator[tuple[str, int, list[int], int]]) -> Iterator[tuple]:
    """Rows (_COLUMNS) of a part's arrays (key, conv_id, words, more), which come in order.

    A node whose conversations all lie within the part, and don't stand first or last, is whole when the sweep closes it; its children wait for its conv_id.
    Nodes of the first and the last array may go on in other parts, so they come as fragments, without each other's sums.
    """
    stack: list[Node] = []
    no, first_key, key, run, run_no = 0, None, None, [], 0
    n = dict.fromkeys(_COLUMNS)

    def row(**have) -> tuple:
        return tuple((n | {"part": part} | have).values())

    def child(conv, depth, convs, children, leaves, saved, ends) -> dict:
        return {"conv_id": conv, "depth": depth, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "text": ends}

    def place(parent: Node, have: dict) -> Iterator[tuple]:
        """The child's row, at once if its parent is known to be a fragment."""
        if parent.first:
            yield row(kind=CHILD, parent_no=parent.no, **have)
        else:
            parent.rows.append(have)

    def fragment(x: Node, depth: int, is_last: bool) -> Iterator[tuple]:
        for have in x.rows:
            yield row(kind=CHILD, parent_no=x.no, **have)
        yield row(kind=FRAGMENT, no=x.no, conv_id=x.conv, depth=depth, n_convs=x.convs, n_children=x.children, n_leaves=x.leaves, saved_tokens=x.saved, n_ends=x.ends, words=x.words, is_first=x.first, is_last=is_last, text=x.digest.hexdigest() if x.digest else EMPTY)

    def close() -> Iterator[tuple]:
        x, depth = stack.pop(), len(stack)
        if x.first:
            yield from fragment(x, depth, False)
            return
        for have in x.rows:
            yield row(kind=NODE, parent_conv_id=x.conv, **have)
        leaves, saved = x.whole()
        stack[-1].add(x.conv, x.convs, 1, leaves, saved)
        yield from place(stack[-1], child(x.conv, depth, x.convs, x.children, leaves, saved, x.digest.hexdigest() if x.digest else EMPTY))

    def pieces() -> Iterator[tuple]:
        text, at = [], 0
        for i, c in enumerate(run):
            text.append(c)
            at += len(c) + 1
            if at >= PIECE or i == len(run) - 1:
                yield row(kind=ENDS, no=run_no, depth=i, text=",".join(text))
                text, at = [], 0

    for now, conv, words, more in rows:
        common = lcp(key, now) if stack else -1
        if now != key:
            if key is not None and key == first_key:
                yield from pieces()
            run = []
        while len(stack) - 1 > common:
            yield from close()
        for d in range(common + 1, len(now) // WIDTH + 1):
            stack.append(Node(no, words[d - 1] if d else 0, first_key is None))
            no += 1
        top = stack[-1]
        top.add(conv, 1, 0, 0, 0)
        if more:
            top.add(None, 0, 1, 1, 0)
            yield from place(top, child(conv, len(stack), 1, int(more > 1), 1, 0, EMPTY if more > 1 else hashlib.sha256(str(conv).encode()).hexdigest()))
        else:
            top.digest = top.digest or hashlib.sha256()
            top.digest.update((b"," if top.ends else b"") + str(conv).encode())
            top.ends += 1
            run.append(str(conv))
        key, run_no = now, top.no
        first_key = now if first_key is None else first_key
    if stack:
        yield from pieces()
        yield row(kind=FIRST, text=first_key)
        yield row(kind=LAST, text=key)
        for d in range(len(stack) - 1, -1, -1):
            yield from fragment(stack[d], d, True)


def sweep(keys: DataFrame) -> DataFrame:
    """Stored rows (_COLUMNS) of all arrays (conv_id, key, words, more): sorted by ranges of key and conv_id, so that equal arrays may lie in many parts,
    and swept part by part. Parts grow in number with the turns, not in size."""
    spark = keys.sparkSession
    turns = keys.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    placed = keys.select("key", "conv_id", "words", "more").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    kinds = {"text": pa.string(), "is_first": pa.bool_(), "is_last": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = swept(TaskContext.get().partitionId(), (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        out = []
        for r in found:
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(_COLUMNS, zip(*out, strict=True), strict=True)], names=list(_COLUMNS))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(_COLUMNS, zip(*out, strict=True), strict=True)], names=list(_COLUMNS))

    names = {"text": "string", "is_first": "boolean", "is_last": "boolean"}
    return stored(map_arrow(placed, run, ", ".join(f"{c} {names.get(c, 'long')}" for c in _COLUMNS)), "swept")


def stitch(parts: list[tuple[int, str, str, list[dict]]]) -> list[dict]:
    """Whole nodes from the fragments of parts (number, first and last array, fragments), in order: one stack over all parts. A node: depth, node (its sums),
    parent (a node or None), refs (part, no) of its fragments, ends (part, no, digest of those in which conversations end)."""
    stack, done, last = [], [], None

    def opened(depth: int, part: int, f: dict) -> None:
        stack.append({"depth": depth, "node": Node(0, f["words"], False), "parent": stack[-1] if stack else None, "refs": [], "ends": []})
        merge(depth, part, f)

    def merge(depth: int, part: int, f: dict) -> None:
        x = stack[depth]
        x["node"].add(f["conv_id"], f["n_convs"], f["n_children"], f["n_leaves"], f["saved_tokens"])
        x["refs"].append((part, f["no"]))
        if f["n_ends"]:
            x["ends"].append((part, f["no"], f["text"]))

    def close() -> None:
        x = stack.pop()
        done.append(x)
        if stack:
            leaves, saved = x["node"].whole()
            stack[-1]["node"].add(x["node"].conv, x["node"].convs, 1, leaves, saved)

    for part, first_key, last_key, fragments in parts:
        firsts, lasts = ({f["depth"]: f for f in fragments if f[side]} for side in ("is_first", "is_last"))
        common, inner = -1 if last is None else lcp(last, first_key), lcp(first_key, last_key)
        while len(stack) - 1 > common:
            close()
        for d in range(len(first_key) // WIDTH + 1):
            (merge if d <= common else opened)(d, part, firsts[d])
        while len(stack) - 1 > inner:
            close()
        for d in range(inner + 1, len(last_key) // WIDTH + 1):
            opened(d, part, lasts[d])
        last = last_key
    while stack:
        close()
    return done


def long_ends(rows: DataFrame, nodes: list[dict]) -> dict[int, str]:
    """SHA-256 of the ends of nodes whose ends lie in several parts, by the node's place in nodes: a node's pieces are read in order by one task, as a stream
    of PIECE characters at a time."""
    refs = [(i, part, no) for i, x in enumerate(nodes) if len(x["ends"]) > 1 for part, no, _ in x["ends"]]
    if not refs:
        return {}
    table = rows.sparkSession.createDataFrame(refs, "node long, part long, no long")
    pieces = rows.where(F.col("kind") == ENDS).join(F.broadcast(table), ["part", "no"]).select("node", "part", F.col("depth").alias("at"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, out = None, None, []
        for b in batches:
            for x, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = x, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if node is not None:
            out.append((node, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["node", "ends"])

    return {r["node"]: r["ends"] for r in map_arrow(pieces.repartition("node").sortWithinPartitions("node", "part", "at"), run, "node long, ends string").collect()}


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Rows without a conv_id belong to no conversation. Turns of equal number and text are two turns. A conversation that is left without turns is a
    member of the root alone. An empty table has no nodes. To the driver come the fragments: two paths of each part.
    """
    turns, lengths = rebuilt(conversations)
    keys, tails = arrays(turns, lengths)
    rows = sweep(keys)
    spark, by_part = rows.sparkSession, {}
    for r in rows.where(F.col("kind").isin(FRAGMENT, FIRST, LAST)).toLocalIterator():
        x = by_part.setdefault(r["part"], {"fragments": []})
        if r["kind"] == FRAGMENT:
            x["fragments"].append(r.asDict())
        else:
            x[r["kind"]] = r["text"]
    nodes = stitch([(p, x[FIRST], x[LAST], x["fragments"]) for p, x in sorted(by_part.items())])
    ends = long_ends(rows, nodes)
    found = []
    for i, x in enumerate(nodes):
        node, (leaves, saved) = x["node"], x["node"].whole()
        found.append((node.conv, x["depth"], x["parent"]["node"].conv if x["parent"] else None, node.convs, node.children, leaves, saved, ends.get(i) or (x["ends"][0][2] if x["ends"] else EMPTY)))
    spanning = spark.createDataFrame(found, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    refs = spark.createDataFrame([(part, no, x["node"].conv) for x in nodes for part, no in x["refs"]], "part long, parent_no long, parent_conv_id long")
    whole = rows.where(F.col("kind") == NODE).withColumnRenamed("text", "ends_sha256").select(*_RESULT)
    below = rows.where(F.col("kind") == CHILD).drop("parent_conv_id").join(F.broadcast(refs), ["part", "parent_no"]).withColumnRenamed("text", "ends_sha256").select(*_RESULT)
    one, last = F.lit(1).cast("long"), F.col("pos") + 1 == F.col("length")
    chain = tails.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"))
    return whole.unionByName(below).unionByName(spanning).unionByName(chain)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie: trie."""
    return trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
SQL = {
    "op13_conversation_trie": f"""
WITH r AS (SELECT conv_id AS c, turn, md5(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS dg, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS nw FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dg) - 1 AS p, dg, nw FROM r),
n AS (SELECT c, n, {crc32("CAST(c AS VARCHAR)")} % {KINDS} AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
b AS (SELECT n.*, least(n.h, coalesce(o.n, 0)) AS taken FROM n LEFT JOIN n o ON o.c = n.c - n.c % {GROUP}),
s AS (SELECT c, p - h + taken AS p, dg, nw FROM t JOIN b USING (c) WHERE p >= h UNION ALL SELECT b.c, t.p, dg, nw FROM b JOIN t ON t.c = b.c - b.c % {GROUP} AND t.p < b.h),
l AS (SELECT b.c, coalesce(list(dg ORDER BY p) FILTER (p IS NOT NULL), []) AS ds, coalesce(list(nw ORDER BY p) FILTER (p IS NOT NULL), []) AS ws FROM b LEFT JOIN s USING (c) GROUP BY b.c),
m AS (SELECT c, d, array_to_string(list_slice(ds, 1, d), '') AS k, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ds) AS e FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM l)),
v AS (SELECT k, d, CASE WHEN d > 0 THEN substr(k, 1, {WIDTH} * (d - 1)) END AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '') AS ends FROM m GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
whole AS (SELECT v.*, coalesce(n, 0) AS n_children FROM v LEFT JOIN kids ON kids.up = v.k),
below AS (SELECT substr(k, 1, {WIDTH} * i) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM whole) GROUP BY 1)
SELECT w.conv_id, d AS depth, o.conv_id AS parent_conv_id, w.n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN below USING (k) LEFT JOIN (SELECT k, conv_id FROM v) o ON o.k = w.up""",
}
