"""Findings of the fourth round of the training-data operators."""

import random

import numpy as np
import pytest

from loomspark.llm import jaccard_trie as jt
from loomspark.llm import media_gif


def _counted(monkeypatch):
    rows, stored = {}, jt.stored

    def counting(df, name):
        out = stored(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jt, "stored", counting)
    return rows


def test_a_shared_passage_brings_no_text_into_a_block(spark, monkeypatch):
    rnd = random.Random(7)
    words = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    # the passage is nearly all that a prefix can hold, so that it is in many of them, and the block has several chunks
    texts = [f"{words(20)} one two three four five {words(20)}" for _ in range(300)]
    texts += [t + " more" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = _counted(monkeypatch)
    got = {r.doc_id: r.component_id for r in jt.near_duplicates(docs, block_sets=20).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(305)}
    # five pairs; before, all of the passage's documents went on as texts
    assert rows["blocks"] <= 20 and rows["links"] <= 20


@pytest.mark.parametrize("block_sets", [3, 1500])
def test_sizes_and_places_lose_no_link(spark, block_sets):
    rnd = random.Random(block_sets)
    base = [[f"v{rnd.randrange(60)}" for _ in range(rnd.randrange(6, 40))] for _ in range(40)]
    texts = []
    for words in base:
        for _ in range(4):
            w = list(words)
            for _ in range(rnd.randrange(3)):
                at = rnd.choice([0, len(w) - 1, rnd.randrange(len(w))])
                w[at:at + rnd.randrange(2)] = [f"x{rnd.randrange(5)}"]
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jt.near_duplicates(docs, block_sets=block_sets).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(sets))}
    assert len(set(got.values())) < len(got)


@pytest.mark.parametrize("batch", [1, 2, 5, 1000])
def test_blocks_of_hold_every_possible_pair_over_any_batches(batch):
    import pyarrow as pa

    rng = np.random.default_rng(batch)
    rows = []
    for token in range(40):
        for _ in range(int(rng.integers(1, 9))):
            n = int(rng.integers(5, 60))
            rows += [(token, int(rng.integers(-1000, 1000)) * 100 + n, n, int(jt.largest_partner(n, int(rng.integers(0, jt.prefix_size(n))), 80)))] * int(rng.integers(1, 3))
    rows = sorted({r[:2]: r for r in rows}.values(), key=lambda r: (r[0], r[2], r[1]))
    rows = [r for r in rows for _ in range(1 + r[1] % 2)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    batches = (pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + batch]], t) for i, t in enumerate(kinds)], names=["token", "d", "n", "most"]) for a in range(0, len(rows), batch))
    blocks = {}
    for b in jt._blocks_of(batches):
        for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blocks.setdefault(c, {c}).add(d)
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and b[2] <= a[3] and a[2] <= b[3]:
                assert any(a[1] in m and b[1] in m for m in blocks.values())


def test_what_is_kept_of_near_duplicates_is_not_shuffled(spark):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven twelve", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jt.keep_one(docs)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_stored_by_a_growing_dictionary(spark):
    text = "the same words again and " * 400
    row = media_gif.media_of_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.payload_bytes >= row.n_bytes == len(text)
    # literal codes take nine eighths of the payload
    assert row.media_bytes < row.payload_bytes / 2


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 257, 766, 767, 768, 1791, 1792, 3838, 3839, 3840, 3841, 20_000])
def test_widths_and_clears_fit_the_dictionary(n):
    rng = np.random.default_rng(n)
    for top in (2, 256):
        px = rng.integers(0, top, n).astype(np.uint8)
        data = media_gif.lzw_compress(px)
        assert media_gif.lzw_decode(data, 8, n).tolist() == px.tolist()
