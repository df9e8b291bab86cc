"""The conversation trie against a plain version; its sweep and stitching over parts of any size."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import conversation_trie as ct

SF = os.environ.get("LOOM_TEST_DIR", "/root/testdata/sf0.001")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def nodes_of(seqs):
    """conv_id -> tuple of (turn, words): rows of all nodes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (k[-1][1] if k else 0)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))))
    return sorted(out, key=repr)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, ((role, text), len(re.findall(r"[^\x20\x09-\x0D]+", text)))))
    own = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    seqs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + x[h:])
    return nodes_of(seqs)


def got(df):
    return sorted((tuple(r) for r in df.select(*ct._RESULT).collect()), key=repr)


def test_trie(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(ct.trie(df.repartition(3))) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


SCHEMA = "conv_id long, turn long, role string, text string, key string, words string, rank string, depth string"


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_of_odd_rows(spark, parts):
    r = random.Random(parts)
    rows = [(None, 1, "user", "nobody's"), (3, None, None, None), (3, None, "", ""), (3, 1, "user", ""), (7, 1, "u", "a"), (7, 1, "u", "a"), (7, 1, "ua", "")]
    # a hot first turn, groups of copies, one very long conversation and a copy of its first half
    for c in range(100, 190):
        rows += [(c, 0, "system", "one two  three")] + [(c, 1 + i, "user", r.choice(["x y", "z", "  w"])) for i in range(r.randrange(4))]
    for c in range(200, 240):
        rows += [(c, i, "user", f"copy {i}") for i in range(5)]
    rows += [(301, i, "user", f"long {i}") for i in range(400)] + [(302, i, "user", f"long {i}") for i in range(200)]
    for c in range(400, 430):
        rows += [(c, i, None, f"{c} {i}") for i in range(r.randrange(1, 4))]
    df = spark.createDataFrame([(*x, "k", "w", "r", "d") for x in rows], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(ct.trie(df)) == plain(rows)
        assert got(ct.trie(df.limit(0))) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class FakeRows:
    """Pieces of ends as long_ends would read them, without Spark."""

    def __init__(self, rows):
        self.rows = rows

    def ends(self, nodes):
        out = {}
        for i, x in enumerate(nodes):
            if len(x["ends"]) > 1:
                want = {(p, n) for p, n, _ in x["ends"]}
                found = sorted((r["part"], r["depth"], r["text"]) for r in self.rows if r["kind"] == ct.ENDS and (r["part"], r["no"]) in want)
                out[i] = sha(",".join(t for *_, t in found))
        return out


TURNS = [(hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=4), min_size=1, max_size=14), st.lists(st.integers(0, 14), max_size=5), st.integers(3, 40))
def test_sweep_and_stitch_over_any_parts(seqs, cuts, piece):
    old, ct.PIECE = ct.PIECE, piece
    try:
        by_conv = {c: tuple(TURNS[t] for t in s) for c, s in enumerate(seqs)}
        # every third conversation ends in a chain of its own
        more = {c: c % 3 for c in by_conv}
        rows = sorted(("".join(t[0] for t in s), c, [t[1] for t in s], more[c]) for c, s in by_conv.items())
        edges = sorted({0, len(rows), *(min(c, len(rows)) for c in cuts)})
        out = [dict(zip(ct._COLUMNS, x, strict=True)) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for x in ct.swept(p, iter(rows[a:b]))]
        parts = defaultdict(lambda: [None, None, None, []])
        for x in out:
            y = parts[x["part"]]
            y[0] = x["part"]
            if x["kind"] == ct.FRAGMENT:
                y[3].append(x)
            elif x["kind"] in (ct.FIRST, ct.LAST):
                y[1 if x["kind"] == ct.FIRST else 2] = x["text"]
        nodes = ct.stitch([tuple(y) for _, y in sorted(parts.items())])
        ends, refs, found = FakeRows(out).ends(nodes), {}, []
        for i, x in enumerate(nodes):
            node, (leaves, saved) = x["node"], x["node"].whole()
            refs |= dict.fromkeys(x["refs"], node.conv)
            found.append((node.conv, x["depth"], x["parent"]["node"].conv if x["parent"] else None, node.convs, node.children, leaves, saved, ends.get(i) or (x["ends"][0][2] if x["ends"] else ct.EMPTY)))
        for x in out:
            if x["kind"] in (ct.NODE, ct.CHILD):
                parent = x["parent_conv_id"] if x["kind"] == ct.NODE else refs[x["part"], x["parent_no"]]
                found.append((x["conv_id"], x["depth"], parent, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["text"]))
        whole = nodes_of({c: s + tuple((("own", c, i), 0) for i in range(more[c])) for c, s in by_conv.items()})
        # chains come from the rows behind an array, but for their first node
        want = [n for n in whole if not any(c == n[0] and n[1] > len(by_conv[c]) + 1 for c in by_conv)]
        assert sorted(found, key=repr) == want
    finally:
        ct.PIECE = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2)), st.lists(st.integers(0, 2)))
def test_lcp(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert ct.lcp("".join(TURNS[x][0] for x in a), "".join(TURNS[x][0] for x in b)) == want
