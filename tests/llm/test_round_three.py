"""Archives, the target draw and the conversation trie against plain versions, and on odd rows."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import decontaminate, pii, target_draw, url_filter, warc

SF = os.environ.get("LOOM_TEST_DIR", "/root/testdata/sf0.001")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- archives ---

ODD = ["", None, "x\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\n", "é" * 5000, "\r\n\r\nWARC/1.1\r", "\r", "x\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\nz"]


def plain_archive(rows):
    """(page_id, html) -> Counter-like list of result rows; rows that are equal and largest: one is the response."""
    groups = defaultdict(list)
    for p, h in rows:
        groups[h or ""].append(p)
    out = []
    for h, pages in groups.items():
        pages.sort(key=lambda p: (p is not None, p or 0))
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out += [(p, len(raw), digest, "revisit", pages[-1]) for p in pages[:-1]] + [(pages[-1], len(raw), digest, "response", None)]
    return sorted(out, key=repr)


def archived(spark, rows, tmp, **more):
    df = spark.createDataFrame([(p, None if i % 7 == 3 else f"http://a.b/{i} \r\nX: y", h, "c") for i, (p, h) in enumerate(rows)], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(df, str(tmp), **more)
    records = warc.read_archives(spark, str(tmp)).cache()
    return records, sorted((tuple(r) for r in warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_archives_of_odd_payloads(spark, tmp_path):
    rows = [(i, h) for i, h in enumerate(ODD * 2)] + [(None, "only null"), (None, "x\r\n"), (5, ODD[5]), (50, "same row"), (50, "same row"), (50, "same row")] + [(1000 + i, "hot") for i in range(200)]
    records, got = archived(spark, rows, tmp_path / "w")
    assert got == plain_archive(rows)
    assert records.count() == len(rows) == records.select("record_id").distinct().count()
    # the files' payloads are the pages', each once
    files = b"".join(gzip.open(f).read() for f in Path(tmp_path / "w").glob("*.gz"))
    assert files.count(b"\r\nhot") == 1 and files.count(b"WARC-Refers-To: ") == sum(r[3] == "revisit" for r in got)
    whole = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).where("type = 'response'")
    assert sorted(bytes(r["payload"]) for r in whole.collect()) == sorted({(h or "").encode() for _, h in rows})


def test_archives_of_nothing_small_payloads_and_lost_originals(spark, tmp_path):
    assert archived(spark, [], tmp_path / "none")[1] == []
    records, got = archived(spark, [(1, "abc"), (2, "abc"), (3, "abcdef"), (4, "abcdef")], tmp_path / "least", least_bytes=4)
    assert sorted((p, kind, to) for p, _, _, kind, to in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    alone = warc.resolved(records.where("type = 'revisit'")).collect()
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in alone] == [(3, None, base64.b32encode(hashlib.sha1(b"abcdef").digest()).decode())]


def test_archive_with_a_wrong_digest_is_an_error(spark, tmp_path):
    archived(spark, [(1, "abc")], tmp_path / "w")
    f = next(x for x in Path(tmp_path / "w").glob("*.gz") if b"abc" in gzip.open(x).read())
    raw = gzip.open(f).read().replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    (tmp_path / "bad").mkdir()
    with gzip.open(tmp_path / "bad" / "x.gz", "wb") as out:
        out.write(raw)
    with pytest.raises(Exception, match="digest differ"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\r", "\n", "\r\n\r\n", "WARC/1.1\r\n", "x", "Content-Length: 1\r\n"]), max_size=8).map("".join), max_size=6))
def test_records_end_where_their_length_says(blocks):
    whole = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n".encode() for b in blocks)
    pieces = whole.split(b"\r\n\r\nWARC/1.1\r\n")
    assert [b.decode() for _, b in warc._records(("f", p) for p in pieces)] == blocks


# --- the target draw ---


def plain_draw(docs, target, share=25, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        f = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in f]

    a, b = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = (np.bincount([x for _, f in side for x in f], minlength=10000) for side in (a, b))
    S, T = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (S + 10000) / ((s[i] + 1) * (T + 10000)))) for i in range(10000)]
    out = []
    for (d, _), (n, f) in zip(docs, a):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * share // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert drawn(target_draw.draw(docs.repartition(5), target)) == want


def test_draw_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(target_draw, "STREAM", 50)
    r = random.Random(5)
    vocab = ["a", "B", "ÉÀ", "x_y", "1-2", "w" * 63, "v" * 64, "u" * 65, "t" * 300, "日本", "\x00", " "]
    rows = [(1, None), (2, ""), (3, " .,"), (None, "z " * 40), (4, "one"), (4, "one two " * 30), (4, "one two " * 30), (9, "word " * 20000)] + [(10 + i, " ".join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(60)]
    schema = "doc_id long, text string, weight string, rank string, stream string"
    docs = spark.createDataFrame([(d, t, "w", "r", "s") for d, t in rows], schema).repartition(4)
    target = spark.createDataFrame([("a ÉÀ " * 30,), (None,), ("t" * 300 + " one",)], "text string")
    assert drawn(target_draw.draw(docs, target)) == plain_draw(rows, ["a ÉÀ " * 30, None, "t" * 300 + " one"])
    assert drawn(target_draw.draw(docs, target.limit(0), share=100)) == plain_draw(rows, [], share=100)
    assert drawn(target_draw.draw(docs.limit(0), target)) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=64)), min_size=1, max_size=20))
def test_joined_crcs(pairs):
    a, b = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    assert target_draw.joined_crcs(a, b, np.array([len(y) for _, y in pairs])).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_run_lengths_and_sliced_columns():
    values, n = target_draw.run_lengths(np.array([5, 1, 5, 5, 9], np.uint16))
    assert (values.tolist(), n.tolist()) == ([1, 5, 9], [1, 3, 1])
    texts = pa.array(["skipped words", "Aé b", None, "c"]).slice(1)
    found, n = target_draw.words(texts)
    assert (found.to_pylist(), n.tolist()) == (["aé", "b", "c"], [2, 0, 1])


# --- what earlier operators owed ---


def test_contamination_of_rows_without_a_doc_id(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item), (None, item), (None, "clean text"), (0, "x " + item + " y"), (None, None), (0, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 10, True), (None, 10, True), (None, 0, False), (0, 10, True), (None, 0, False), (0, 0, False)], key=repr)
    # without a doc_id the text alone decides; rows that share a doc_id go together
    assert sorted((tuple(r) for r in decontaminate.clean(docs, bench).collect()), key=repr) == [(None, "clean text"), (None, None)]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        i = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:i].translate(LOW), rest[i:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for verdict, text in rules:
        h, slash, p = text.partition("/")
        h = h.translate(LOW)
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(h + slash + p), len(h), h + slash + p, verdict))
    return (max(fits)[2], max(fits)[3]) if fits else (None, "allow")


def test_urls_by_both_ways_on_random_rules(spark):
    r = random.Random(9)
    labels = ["a", "B", "a\x01", "\x01", "\x02", "\x02s", "ÄÖ", "org", "x-y", ""]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: "".join(r.choice(["/", "/a", "b", "\x01", "é"]) for _ in range(r.randrange(4)))
    rules = list({t: (r.choice(["allow", "block"]), t) for t in (host().translate(LOW) + "/" + path() for _ in range(120))}.values()) + [("block", "/"), ("allow", "org\x01evil/")]
    rules = list({t: (v, t) for v, t in rules}.values())
    urls = [f"http://{host()}/{path()}" for _ in range(400)] + ["http://org\x01evil/x", "http://evil\x01org/x", None, "no host", "://", "http:///x"] + ["http://hot.org/a/b"] * 100
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    want = {i: judged(u, rules) for i, u in enumerate(urls)}
    table = spark.createDataFrame(rules, "verdict string, text string")
    for got in (url_filter.judge(df, [url_filter.rule(*x) for x in rules]), url_filter.judge_in_ranges(df, table), url_filter.judge_in_ranges(df, table, partitions=1)):
        assert {x["page_id"]: (x["rule"], x["verdict"]) for x in got.collect()} == want


def test_pii_precision_on_documents(spark):
    """Cards that the field adds pass the checksum; odd spellings planted in clean documents are found, and nothing else is added there."""
    weights = dict(pii.trained())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    planted = [("jane.doe @ example.com", 0), ("10[.]20[.]30[.]41", 1), ("4111.1111.1111.1111", 2), ("(212) 555-0187", 3)]
    right = added = wanted = 0
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        new = set(pii.all_spans(t, base, weights)) - set(base)
        assert all(pii.luhn(re.sub("[^0-9]", "", t[a:b])) for a, k, b in new if k == 2)
        if not re.search("[0-9@]", t) and len(t) > 40:
            x, k = planted[i % 4]
            at = t.find(" ", 20) + 1 or len(t)
            text = f"{t[:at]}{x} {t[at:]}"
            base = pii.base_spans(text)
            got = set(pii.all_spans(text, base, weights)) - set(base)
            want = {(at, k, at + len(x))}
            right, added, wanted = right + len(got & want), added + len(got), wanted + 1
    assert wanted > 100 and right / added >= 0.95 and right / wanted >= 0.9, (right, added, wanted)
