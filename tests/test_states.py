"""Stateful streams against plain replays, in several batches and over a restart."""

import random

from loomspark.streaming import states


def append(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


SCANS = "path string, seen_s long, checksum string"


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_files_come_change_go_and_come_again(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    append(spark, [("/a", 1000, "x"), ("/b", 1000, "y"), ("/c", 1000, None), (None, 1000, "n")], SCANS, at)
    first = states.file_changes(stream(spark, SCANS, at), out, 1500)
    assert sorted((r["path"], r["change"]) for r in first.collect()) == [("/a", "new"), ("/b", "new"), ("/c", "new")]
    # restarts: /b is seen no more for a while, and /a has changed
    append(spark, [("/a", 2000, "z"), ("/c", 2000, None)], SCANS, at)
    states.file_changes(stream(spark, SCANS, at), out, 1500)
    append(spark, [("/a", 3000, "z")], SCANS, at)
    append(spark, [("/a", 4000, "z"), ("/b", 4000, "y")], SCANS, at)
    rows = sorted((r["path"], r["at_s"], r["change"], r["checksum"], r["first_s"]) for r in states.file_changes(stream(spark, SCANS, at), out, 1500).where("change <> 'new'").collect() if r["checksum"])
    assert rows == [("/a", 2000, "changed", "z", 1000), ("/b", 2500, "missing", "y", 1000), ("/b", 4000, "back", "y", 1000)]
    last = {r["path"]: r["change"] for r in sorted(states._read(spark, out, "path string, at_s long, change string, checksum string, first_s long").collect(), key=lambda r: r["at_s"])}
    assert last["/c"] == "missing"


def test_contents_under_other_paths(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    append(spark, [("/b", 10, "x"), ("/a", 10, "x"), ("/c", 10, "y"), ("/d", 10, None)], SCANS, at)
    append(spark, [("/b", 20, "x"), ("/e", 20, "x"), ("/f", 20, "y")], SCANS, at)
    states.content_actions(stream(spark, SCANS, at), out)
    append(spark, [("/e", 30, "x"), ("/g", 30, "w"), ("/g", 30, "w"), ("/b", 30, "y")], SCANS, at)
    rows = sorted(tuple(r)[:4] for r in states.content_actions(stream(spark, SCANS, at), out).collect())
    assert rows == [("w", "/g", 30, "ingest"), ("x", "/a", 10, "ingest"), ("x", "/b", 10, "alias"), ("x", "/e", 20, "alias"), ("y", "/b", 30, "alias"), ("y", "/c", 10, "ingest"), ("y", "/f", 20, "alias")]


def test_cache_entries_expire_by_their_time(spark, tmp_path):
    at, out, r = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(3)
    times = sorted(r.randrange(0, 5000) for _ in range(300))
    asked = [(f"k{r.randrange(5)}", t) for t in times]
    for part in (asked[:100], asked[100:101], asked[101:]):
        append(spark, part, "key string, asked_s long", at)
        got = states.cache_entries(stream(spark, "key string, asked_s long", at), out, 700)
    want, open_ = [], {}
    for k, t in asked:
        e = open_.get(k)
        if e is None or t >= e[1] + 700:
            open_[k] = e = [k, t, -1, t]
            want.append(e)
        e[2], e[3] = e[2] + 1, t
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in want)
