"""Stateful streams: files that scans see come, change, go and come again; contents that are known under another path; a cache whose entries expire.

State lives in the state store under the stream's checkpoint, so a restart goes on where the last batch ended. Each job runs over what is there (availableNow).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FileStates(StatefulProcessor):
    """Key: path. Rows seen (seen_s, checksum) in order of time; a file that isn't seen for gap_s is missing: a timer says so, or the next sighting if it comes first."""

    def __init__(self, gap_s: int):
        self.gap_s = gap_s

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.file = handle.getValueState("file", "first_s long, last_s long, checksum string, exists boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        # a scan sees a path once, so a path's rows of a batch are as many as the scans in it
        seen = sorted(((int(f["seen_s"]), f["checksum"]) for f in rows), key=lambda x: (x[0], x[1] or ""))
        state = self.file.get()
        first, last, checksum, exists = state if state else (None, None, None, False)
        out = []
        for t, c in seen:
            if exists and t >= last + self.gap_s:
                out.append((last + self.gap_s, "missing", checksum))
                exists = False
            if first is None:
                out.append((t, "new", c))
                first = t
            elif not exists:
                out.append((t, "back", c))
            elif c != checksum:
                out.append((t, "changed", c))
            last, checksum, exists = max(t, last or t), c, True
        # a path that wasn't known has no timer
        for timer in list(self.handle.listTimers()) if state else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.gap_s) * 1000)
        self.file.update((first, last, checksum, exists))
        for t, kind, c in out:
            yield Row(path=key[0], at_s=t, change=kind, checksum=c, first_s=first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        first, last, checksum, _ = self.file.get()
        self.file.update((first, last, checksum, False))
        yield Row(path=key[0], at_s=last + self.gap_s, change="missing", checksum=checksum, first_s=first)

    def close(self) -> None:
        pass


class ContentStates(StatefulProcessor):
    """Key: checksum. The first path of a content is read in, each other path is an alias, and what is known is skipped."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.paths = handle.getMapState("paths", "path string", "first_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new: dict[str, int] = {}
        for f in rows:
            for path, t in zip(f["path"], f["seen_s"], strict=True):
                if path in new:
                    new[path] = min(new[path], int(t))
                elif not self.paths.containsKey((path,)):
                    new[path] = int(t)
        first = not self.paths.exists()
        order = sorted(new.items(), key=lambda x: (x[1], x[0]))
        for path, t in order:
            self.paths.updateValue((path,), (t,))
        yield pd.DataFrame([(key[0], p, t, "ingest" if first and i == 0 else "alias") for i, (p, t) in enumerate(order)], columns=["checksum", "path", "seen_s", "action"])

    def close(self) -> None:
        pass


class CacheStates(StatefulProcessor):
    """Key: what is asked. A request without an entry, or one whose entry is TTL_S old, stores a new one; others hit it."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle) -> None:  # noqa: ANN001
        self.entry = handle.getValueState("entry", "stored_s long, hits long, last_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times = pd.concat([f["asked_s"] for f in rows]).to_numpy(dtype="int64")
        times.sort()
        stored, hits, last = self.entry.get() if self.entry.exists() else (None, 0, None)
        ended = []
        for t in times.tolist():
            if stored is None or t >= stored + self.ttl_s:
                if stored is not None:
                    ended.append((stored, hits, last))
                stored, hits, last = t, 0, t
            else:
                hits, last = hits + 1, max(t, last)
        self.entry.update((stored, hits, last))
        yield pd.DataFrame([(key[0], *x) for x in (*ended, (stored, hits, last))], columns=["key", "stored_s", "hit_count", "last_access_s"])

    def close(self) -> None:
        pass


def _run(df: DataFrame, out: str) -> None:
    """Runs a stream over what is there, its rows appended to out/rows with the number of their batch."""
    spark = df.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _STORE)
    try:
        # a batch that is written again after a failure goes over what it wrote
        df.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/rows/batch={i}")).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def _read(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def file_changes(scans: DataFrame, out: str, gap_s: int) -> DataFrame:
    """path, at_s, change (new, changed, missing, back), checksum, first_s, batch: what a stream of sightings (path, seen_s, checksum) tells. A file is
    missing when the newest sighting of any file is gap_s later than its last one, so gap_s is longer than the time between two scans. Call it again with the same out to go on with more sightings."""
    timed = scans.where("path is not null and seen_s is not null").withColumn("ts", F.timestamp_seconds("seen_s")).withWatermark("ts", "0 seconds")
    changes = timed.groupBy("path").transformWithState(FileStates(gap_s), "path string, at_s long, change string, checksum string, first_s long", "Update", "EventTime")
    _run(changes, out)
    return _read(scans.sparkSession, out, "path string, at_s long, change string, checksum string, first_s long")


def content_actions(scans: DataFrame, out: str) -> DataFrame:
    """checksum, path, seen_s, action (ingest or alias), batch: a row for each path of a content that isn't known yet. Paths of a batch are told apart by time, then name."""
    actions = scans.where("checksum is not null and path is not null").groupBy("checksum").transformWithStateInPandas(ContentStates(), "checksum string, path string, seen_s long, action string", "Update", "None")
    _run(actions, out)
    return _read(scans.sparkSession, out, "checksum string, path string, seen_s long, action string")


def cache_entries(requests: DataFrame, out: str, ttl_s: int) -> DataFrame:
    """key, stored_s, hit_count, last_access_s: every entry that requests (key, asked_s) made, as they last left it. An entry serves requests of less than ttl_s
    after its storing, by the requests' own times; a batch's requests of a key go in order of time."""
    entries = requests.where("key is not null and asked_s is not null").groupBy("key").transformWithStateInPandas(CacheStates(ttl_s), "key string, stored_s long, hit_count long, last_access_s long", "Update", "None")
    _run(entries, out)
    rows = _read(requests.sparkSession, out, "key string, stored_s long, hit_count long, last_access_s long")
    return rows.groupBy("key", "stored_s").agg(F.max_by(F.struct("hit_count", "last_access_s"), "batch").alias("e")).select("key", "stored_s", "e.hit_count", "e.last_access_s")
