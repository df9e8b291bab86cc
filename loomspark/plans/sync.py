"""Reconciliation of disk and index, and incremental queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..streaming import jobs, states
from .registry import query

FT = fx.FULLTEXT
#: Roots that a scan got through; what is missing elsewhere says nothing.
ROOTS = ("/corpus/src0", "/corpus/src1", "/corpus/src2", "/corpus/src3")
_IN = " OR ".join(f"starts_with(p, '{r}/')" for r in ROOTS)
RESYNC = f"""dk0 AS (SELECT CASE WHEN doc_id % 17 = 2 THEN path || '.moved' ELSE path END AS path, CASE WHEN doc_id % 31 = 5 THEN sha256(text || '!') ELSE checksum END AS checksum FROM {FT} WHERE doc_id % 9 <> 0), dk AS (SELECT checksum, list_sort(list(path)) AS paths FROM dk0 GROUP BY checksum),
ix AS (SELECT checksum, all_[1] AS canonical, all_[2:] AS aliases, all_, dup FROM (SELECT checksum, list_sort(list(path)) AS all_, bool_or(doc_id % 50 = 7) AS dup FROM {FT} WHERE doc_id % 8 <> 0 GROUP BY checksum)),
j AS (SELECT coalesce(ix.checksum, dk.checksum) AS checksum, ix.checksum IS NULL AS fresh, dup, canonical, aliases, all_, coalesce(paths, []) AS disk FROM ix FULL JOIN dk ON ix.checksum = dk.checksum),
k AS (SELECT *, list_filter(all_, lambda p: NOT list_contains(disk, p) AND ({_IN})) AS gone, list_filter(disk, lambda p: NOT list_contains(all_, p)) AS extra, len(list_filter(all_, lambda p: {_IN})) = len(all_) AS scanned FROM j),
m AS (SELECT *, list_contains(gone, canonical) AS lost, list_filter(gone, lambda p: p <> canonical) AS dropped, EXISTS (SELECT 1 FROM dk0 d WHERE d.path = k.canonical AND d.checksum <> k.checksum) AS replaced FROM k),
r0 AS (SELECT *, list_filter([CASE WHEN len(extra) > 0 THEN 'ADD_ALIAS' END, CASE WHEN lost AND len(disk) > 1 THEN 'CANONICAL_AMBIGUOUS' END, CASE WHEN len(disk) = 0 AND len(gone) > 0 AND scanned THEN 'ORPHANED_INDEX_CONTENT' END, CASE WHEN len(dropped) > 0 THEN 'REMOVE_ALIAS' END, CASE WHEN lost AND len(disk) = 1 THEN 'SET_CANONICAL' END], lambda x: x IS NOT NULL) AS rs FROM m),
plan AS (SELECT * FROM (SELECT checksum, CASE WHEN fresh THEN 'INFO' WHEN dup THEN 'BLOCKED' WHEN replaced OR list_contains(rs, 'CANONICAL_AMBIGUOUS') OR list_contains(rs, 'ORPHANED_INDEX_CONTENT') THEN 'REVIEW' ELSE 'SAFE' END AS bucket, CASE WHEN fresh THEN 'NOT_INDEXED' WHEN dup THEN 'DUPLICATE_INDEX_DOCS' WHEN replaced THEN 'PATH_REPLACED' ELSE array_to_string(rs, ';') END AS reasons,
 CASE WHEN lost AND len(disk) = 1 THEN disk[1] END AS new_canonical, CASE WHEN fresh THEN disk ELSE extra END AS adds, coalesce(dropped, []) AS removes FROM r0) WHERE reasons <> '')"""


def index_and_disk(spark, sf) -> tuple[DataFrame, DataFrame]:
    """index: checksum, canonical, aliases, duplicated; disk: path, checksum. Some files moved, some have new contents, and some texts stand twice in the index."""
    ft, d = fx.fulltext(spark, sf), F.col("doc_id")
    disk = ft.where(d % 9 != 0).select(F.when(d % 17 == 2, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), F.when(d % 31 == 5, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("checksum")).alias("checksum"))
    index = ft.where(d % 8 != 0).groupBy("checksum").agg(F.sort_array(F.collect_list("path")).alias("p"), F.bool_or(d % 50 == 7).alias("duplicated"))
    return index.select("checksum", F.get("p", F.lit(0)).alias("canonical"), F.expr("slice(p, 2, size(p))").alias("aliases"), "duplicated"), disk


def _within(path: Column, roots: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | path.startswith(r.rstrip("/") + "/") | (path == r)
    return out


def reconciled(index: DataFrame, disk: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """checksum, bucket, reasons, new_canonical, adds, removes: what has to change so that the index says where each content lies on disk. No row where nothing has to."""
    paths = disk.groupBy("checksum").agg(F.sort_array(F.collect_list("path")).alias("disk"))
    there = disk.select(F.col("path").alias("canonical"), F.col("checksum").alias("now"))
    ix = index.join(there, "canonical", "left").groupBy("checksum", "canonical", "aliases", "duplicated").agg(F.bool_or(F.col("now") != F.col("checksum")).alias("replaced"))
    none = F.array().cast("array<string>")
    j = ix.join(paths, "checksum", "full_outer").withColumn("fresh", F.col("canonical").isNull()).withColumn("disk", F.coalesce("disk", none)).withColumn("all", F.coalesce(F.concat(F.array("canonical"), "aliases"), none))
    j = j.withColumn("gone", F.filter(F.array_except("all", "disk"), lambda p: _within(p, roots))).withColumn("extra", F.array_except("disk", "all"))
    n, lost = F.size("disk"), ~F.col("fresh") & F.array_contains("gone", F.col("canonical"))
    removes = F.filter("gone", lambda p: p != F.col("canonical"))
    scanned = F.size(F.filter("all", lambda p: _within(p, roots))) == F.size("all")
    say = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array_compact(F.array(say(F.size("extra") > 0, "ADD_ALIAS"), say(lost & (n > 1), "CANONICAL_AMBIGUOUS"), say((n == 0) & (F.size("gone") > 0) & scanned, "ORPHANED_INDEX_CONTENT"), say(F.size(removes) > 0, "REMOVE_ALIAS"), say(lost & (n == 1), "SET_CANONICAL")))
    j = j.withColumn("r", reasons).withColumn("review", F.arrays_overlap("r", F.array(F.lit("CANONICAL_AMBIGUOUS"), F.lit("ORPHANED_INDEX_CONTENT"))))
    replaced, twice = F.coalesce("replaced", F.lit(False)), F.coalesce("duplicated", F.lit(False))
    bucket = F.when(F.col("fresh"), "INFO").when(twice, "BLOCKED").when(replaced | F.col("review"), "REVIEW").otherwise("SAFE")
    reason = F.when(F.col("fresh"), "NOT_INDEXED").when(twice, "DUPLICATE_INDEX_DOCS").when(replaced, "PATH_REPLACED").otherwise(F.array_join("r", ";"))
    out = j.select("checksum", bucket.alias("bucket"), reason.alias("reasons"), F.when(lost & (n == 1), F.get("disk", F.lit(0))).alias("new_canonical"), F.when(F.col("fresh"), F.col("disk")).otherwise(F.col("extra")).alias("adds"), F.when(F.col("fresh"), none).otherwise(removes).alias("removes"))
    return out.where("reasons <> ''")


@query("resync_plan", f"WITH {RESYNC} SELECT checksum, bucket, reasons, new_canonical, array_to_string(adds, ',') AS adds, array_to_string(removes, ',') AS removes FROM plan")
def _(spark, sf):
    return reconciled(*index_and_disk(spark, sf)).withColumn("adds", F.array_join("adds", ",")).withColumn("removes", F.array_join("removes", ","))


@query("resync_bucket_counts", f"WITH {RESYNC} SELECT bucket, count(*) AS n, CAST(sum(len(adds)) AS BIGINT) AS adds, CAST(sum(len(removes)) AS BIGINT) AS removes FROM plan GROUP BY bucket")
def _(spark, sf):
    return reconciled(*index_and_disk(spark, sf)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.size("adds").cast("long")).alias("adds"), F.sum(F.size("removes").cast("long")).alias("removes"))


@query("stream_hourly_failures", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    return jobs.hourly_failures(spark, sf)


@query("stream_dedup_ingest", "SELECT sha256(text) AS checksum, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, sf):
    return jobs.dedup_ingest(spark, sf)


DAY, GAP, SCANNED = 86_400, 129_600, 1_710_000_000


def _files(spark, sf):
    return fx.fulltext(spark, sf, jobs.stream_of(spark, sf, "documents"))


@query("stream_rescan", f"""WITH s AS (SELECT path, {SCANNED} + k * {DAY} AS t, CASE WHEN k = 2 AND doc_id % 5 = 0 THEN sha256(text || 'x') ELSE checksum END AS c FROM {fx.FULLTEXT}, range(4) r(k) WHERE doc_id % (k + 3) <> 1),
w AS (SELECT *, lag(t) OVER p AS pt, lag(c) OVER p AS pc, lead(t) OVER p AS nt, first_value(t) OVER p AS f FROM s WINDOW p AS (PARTITION BY path ORDER BY t))
SELECT path, t AS at_s, CASE WHEN pt IS NULL THEN 'new' WHEN t - pt >= {GAP} THEN 'back' ELSE 'changed' END AS change, c AS checksum, f AS first_s FROM w WHERE pt IS NULL OR t - pt >= {GAP} OR c <> pc
UNION ALL SELECT path, t + {GAP}, 'missing', c, f FROM w WHERE nt - t >= {GAP} OR (nt IS NULL AND t + {GAP} < (SELECT max(t) FROM s))""")
def _(spark, sf):
    # four scans, each of which misses some files
    f, k = _files(spark, sf), F.col("k")
    seen = f.withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).where(F.col("doc_id") % (k + 3) != 1)
    checksum = F.when((k == 2) & (F.col("doc_id") % 5 == 0), F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("checksum"))
    return states.file_changes(seen.select("path", (F.lit(SCANNED) + k * DAY).cast("long").alias("seen_s"), checksum.alias("checksum")), jobs.folder(spark), GAP).drop("batch")


@query("stream_content_alias", f"SELECT checksum, path, modified_s AS seen_s, CASE WHEN row_number() OVER (PARTITION BY checksum ORDER BY modified_s, path) = 1 THEN 'ingest' ELSE 'alias' END AS action FROM {fx.FULLTEXT} WHERE checksum IS NOT NULL")
def _(spark, sf):
    return states.content_actions(_files(spark, sf).select("checksum", "path", F.col("modified_s").alias("seen_s")), jobs.folder(spark)).drop("batch")


TTL = 259_200


@query("stream_cache_entries", f"""WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
e AS (SELECT key, n, t, t AS stored FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, r.t, CASE WHEN r.t >= stored + {TTL} THEN r.t ELSE stored END FROM e JOIN r ON r.key = e.key AND r.n = e.n + 1)
SELECT key, stored AS stored_s, count(*) - 1 AS hit_count, max(t) AS last_access_s FROM e GROUP BY key, stored""")
def _(spark, sf):
    # a user's events ask for what was made for the user; it is kept for three days
    e = jobs.stream_of(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("asked_s"))
    return states.cache_entries(e, jobs.folder(spark), TTL)
