"""Queries that change tables: each makes its tables in the shared folder, changes them, and returns what they hold or what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as ru
from ..functions import text as tx
from ..operators import sinks
from ..sources import fixtures as fx
from . import endtoend as e2e
from .documents import KIND, q
from .registry import query
from .sync import RESYNC, index_and_disk, reconciled

FT, INV, CATALOG, CHUNKS = fx.FULLTEXT, fx.INVENTORY, fx.CATALOG, e2e.CHUNKS


def chunk_table(spark, sf) -> sinks.Table:
    return sinks.Table.fresh(e2e.chunks(spark, sf).select("id", "doc_id", "chunk_index", "checksum", "path", F.length("text").cast("long").alias("n_chars")), ["id"])


_CH = f"(SELECT id, doc_id, chunk_index, checksum, path, CAST(length(text) AS BIGINT) AS n_chars FROM {CHUNKS})"


@query("bulk_index", f"SELECT id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, path FROM {_CH} UNION ALL SELECT doc_id + 900000000, NULL, 'late' FROM {FT} WHERE doc_id % 10 = 1 AND doc_id % 20 <> 1")
def _(spark, sf):
    # a partial update of some chunks, new chunks, and rows without a path, which come back as errors
    t = chunk_table(spark, sf)
    some = t.read().where("doc_id % 4 = 0").select("id", (F.col("n_chars") + 1).alias("n_chars"), "path")
    d = fx.fulltext(spark, sf).where("doc_id % 10 = 1").select((F.col("doc_id") + 900_000_000).alias("id"), F.when(F.col("doc_id") % 20 != 1, "late").alias("path"))
    sinks.indexed(some.unionByName(d, allowMissingColumns=True), t, ("id", "path"))
    return t.read().select("id", "n_chars", "path")


@query("bulk_index_errors", f"SELECT doc_id + 900000000 AS id, 'missing path' AS error FROM {FT} WHERE doc_id % 20 = 1")
def _(spark, sf):
    t = chunk_table(spark, sf)
    return sinks.indexed(fx.fulltext(spark, sf).where("doc_id % 10 = 1").select((F.col("doc_id") + 900_000_000).alias("id"), F.when(F.col("doc_id") % 20 != 1, "late").alias("path")), t, ("id", "path"))


@query("fulltext_replace", f"SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE checksum END AS checksum, CASE WHEN doc_id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM {FT}")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).select("path", "checksum", "size_bytes", "text", "doc_id")
    t = sinks.Table.fresh(ft.select("path", "checksum", "size_bytes"), ["path"])
    t.merge(ft.where("doc_id % 5 = 0").select("path", F.sha2(F.concat("text", F.lit("!")), 256).alias("checksum"), (F.col("size_bytes") + 1).alias("size_bytes")))
    return t.read()


@query("vectors_then_chunks", "SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN vec_id % 7 = 0 AND i = 1 THEN 0 ELSE x::DOUBLE END)), 4) AS total FROM embeddings")
def _(spark, sf):
    # vectors are written first, cleaned; a first value that is no number becomes 0
    v = fx.table(spark, sf, "embeddings")
    broken = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(float("nan")).cast("float")).otherwise(x))
    t = sinks.Table.fresh(v.select(F.col("vec_id").alias("id"), sinks.clean_vectors(broken, 64).alias("v")), ["id"])
    return t.read().select("id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("delete_cascade", f"""WITH gone AS (SELECT DISTINCT checksum FROM {FT} WHERE starts_with(path, '/corpus/src1/en/')) SELECT 'fulltext' AS name, count(*) AS deleted FROM {FT} WHERE checksum IN (SELECT checksum FROM gone)
 UNION ALL SELECT 'chunks', count(*) FROM {_CH} WHERE checksum IN (SELECT checksum FROM gone) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM {FT} WHERE checksum IN (SELECT checksum FROM gone)) UNION ALL SELECT 'inventory', count(*) FROM {INV} WHERE starts_with(path, '/corpus/src1/en/')""")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).select("doc_id", "path", "checksum")
    gone = ft.where(F.col("path").startswith("/corpus/src1/en/")).select("checksum").distinct()
    text, inv = sinks.Table.fresh(ft, ["path"]), sinks.Table.fresh(fx.inventory(spark, sf).select("path", "exists_now"), ["path"])
    vec = sinks.Table.fresh(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).join(ft, "doc_id").select("doc_id", "checksum"), ["doc_id"])
    # vectors and chunks go before the texts that name them
    n = {"vectors": vec.delete_keys(gone, "checksum"), "chunks": chunk_table(spark, sf).delete_keys(gone, "checksum"), "fulltext": text.delete_keys(gone, "checksum"), "inventory": inv.delete(F.col("path").startswith("/corpus/src1/en/"))}
    return spark.createDataFrame(list(n.items()), "name string, deleted long")


SCAN = 1_720_000_000


@query("inventory_scan", f"""SELECT path, CASE WHEN doc_id % 10 = 3 THEN {SCAN} ELSE 1700000000 END AS first_seen, CASE WHEN doc_id % 10 >= 2 THEN {SCAN} ELSE 1700000000 END AS last_seen, NOT (doc_id % 10 < 2 AND starts_with(path, '/corpus/src') AND NOT ends_with(path, '.docx')) AS exists_now FROM {FT}""")
def _(spark, sf):
    # files seen before keep the time they were first seen; files of the prefix and suffixes that a scan didn't see are missing
    ft = fx.fulltext(spark, sf)
    t = sinks.Table.fresh(ft.where("doc_id % 10 <> 3").select("path", F.lit(1_700_000_000).cast("long").alias("first_seen"), F.lit(1_700_000_000).cast("long").alias("last_seen"), F.lit(True).alias("exists_now")), ["path"])
    seen = ft.where("doc_id % 10 >= 2").select("path", F.lit(SCAN).cast("long").alias("first_seen"), F.lit(SCAN).cast("long").alias("last_seen"), F.lit(True).alias("exists_now"))
    t.merge(seen, keep=("first_seen",))
    t.update((F.col("last_seen") < SCAN) & F.col("exists_now") & F.col("path").startswith("/corpus/src") & (F.col("path").endswith(".txt") | F.col("path").endswith(".pdf")), exists_now=F.lit(False))
    return t.read()


@query("zero_chunk_mark", f"SELECT path, CASE WHEN size_bytes IS NULL AND last_indexed_s IS NULL THEN {SCAN} ELSE last_indexed_s END AS last_indexed_s FROM {INV}")
def _(spark, sf):
    t = sinks.Table.fresh(fx.inventory(spark, sf).select("path", "size_bytes", "last_indexed_s"), ["path"])
    t.update(F.col("size_bytes").isNull() & F.col("last_indexed_s").isNull(), last_indexed_s=F.lit(SCAN).cast("long"))
    return t.read().select("path", "last_indexed_s")


@query("backfill_modes", f"SELECT mode, i.path, CASE WHEN mode = 'fill' THEN coalesce(i.size_bytes, f.size_bytes + 1) ELSE f.size_bytes + 1 END AS size_bytes FROM {INV} i JOIN {FT} f USING (path), (VALUES ('fill'), ('overwrite')) m(mode)")
def _(spark, sf):
    have = fx.fulltext(spark, sf).select("path", (F.col("size_bytes") + 1).alias("size_bytes"))
    out = []
    for mode in ("fill", "overwrite"):
        t = sinks.Table.fresh(fx.inventory(spark, sf).select("path", "size_bytes"), ["path"])
        t.merge(have, insert=False, fill_only=mode == "fill")
        out.append(t.read().select(F.lit(mode).alias("mode"), "path", "size_bytes"))
    return out[0].unionByName(out[1])


@query("slim_payload", f"SELECT id, checksum, path FROM {_CH}")
def _(spark, sf):
    t = chunk_table(spark, sf)
    slim = sinks.Table.fresh(t.read().select("id", "checksum", "path"), ["id"])
    return slim.read()


_POLICY = "CASE WHEN doc_type IN ('cv', 'cover_letter', 'reference_letter') THEN 'identity' WHEN length(text) <= 3000 THEN 'short' ELSE 'default' END"
SIZES = {"identity": (400, 50), "short": (600, 80), "default": (800, 100)}
_SIZE, _STEP = (f"CASE policy {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in d.items())} END" for d in ({k: a for k, (a, _) in SIZES.items()}, {k: a - b for k, (a, b) in SIZES.items()}))
_TYPED = f"(SELECT doc_id, text, {KIND} AS doc_type FROM {fx.PAPERS} WHERE text IS NOT NULL AND trim(text) <> '')"


def policy(kind, text):
    return F.when(kind.isin("cv", "cover_letter", "reference_letter"), "identity").when(F.length(text) <= 3000, "short").otherwise("default")


@query("rechunk_rewrite", f"""SELECT doc_id, policy, CAST(at_ // step AS BIGINT) AS chunk_index, CAST(length(substring(text, at_ + 1, size)) AS BIGINT) AS n_chars, round(100.0::DOUBLE * (at_ // step) / greatest(greatest(length(text) - 1, 0) // step, 1), 6) AS location_percent FROM
 (SELECT *, unnest(range(0, greatest(length(text) - 1, 0) + 1, step)) AS at_ FROM (SELECT *, {_SIZE} AS size, {_STEP} AS step FROM (SELECT doc_id, text, {_POLICY} AS policy FROM {_TYPED})))""")
def _(spark, sf):
    d = ru.with_doc_type(fx.papers(spark, sf).where("text is not null and trim(text) <> ''")).withColumn("policy", policy(F.col("doc_type"), F.col("text")))
    # papers are classified once, and each is cut by its policy's size
    by_policy = lambda i: F.coalesce(*[F.when(F.col("policy") == name, F.lit(x[i])) for name, x in SIZES.items()])
    d = d.withColumns({"size": by_policy(0), "step": by_policy(0) - by_policy(1)})
    c = tx.fixed_windows(d, F.col("size"), F.col("step"), "policy").select("doc_id", "policy", "chunk_index", F.length("chunk").cast("long").alias("n_chars"), "location_percent")
    t = sinks.Table.fresh(c, ["doc_id", "chunk_index"])
    return t.read()


@query("rechunk_candidates", f"SELECT policy, count(*) AS n FROM (SELECT {_POLICY} AS policy FROM {_TYPED}) GROUP BY policy UNION ALL SELECT 'skipped_empty_text', count(*) FROM {fx.PAPERS} WHERE text IS NULL OR trim(text) = ''")
def _(spark, sf):
    full = F.coalesce(F.trim("text"), F.lit("")) != ""
    p = ru.with_doc_type(fx.papers(spark, sf)).groupBy(F.when(full, policy(F.col("doc_type"), F.col("text"))).otherwise("skipped_empty_text").alias("policy")).agg(F.count("*").alias("n"))
    zero = spark.createDataFrame([("skipped_empty_text", 0)], "policy string, n long")
    return p.unionByName(zero).groupBy("policy").agg(F.sum("n").alias("n"))


@query("audit_append", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id FROM events UNION ALL SELECT 'audit', user_id FROM events WHERE event_type = 'error') GROUP BY event_type")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", "user_id")
    t = sinks.Table.fresh(e, [])
    t.append(e.where("event_type = 'error'").select(F.lit("audit").alias("event_type"), "user_id"))
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_REPORT = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, '{\"max\":' || max(n_chars) || ',\"min\":' || min(n_chars) || '}' AS span FROM documents GROUP BY lang"


def _report(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.struct(F.max("n_chars").alias("max"), F.min("n_chars").alias("min")).alias("span"))


@query("report_csv", _REPORT)
def _(spark, sf):
    return spark.read.option("header", True).option("escape", '"').schema("lang string, n long, chars long, span string").csv(sinks.report_csv(_report(spark, sf)))


@query("report_json", _REPORT)
def _(spark, sf):
    back = spark.read.schema("lang string, n long, chars long, span struct<max: long, min: long>").json(sinks.report_json(_report(spark, sf)))
    return back.withColumn("span", F.to_json("span"))


@query("cluster_cache", "SELECT label, count(*) AS n, 2 AS lookups FROM embeddings GROUP BY label")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    n, digest = e.agg(F.count("*"), F.sha2(F.sum(F.xxhash64("vec_id").cast("decimal(38,0)")).cast("string"), 256)).first()
    cache, key = sinks.Cache(spark), sinks.Cache.key({"least": 5}, n, digest)
    if cache.get(key) is None:
        cache.put(key, e.groupBy("label").agg(F.count("*").alias("n")))
    assert cache.get(sinks.Cache.key({"least": 6}, n, digest)) is None
    return cache.get(key).withColumn("lookups", F.lit(2))


@query("table_ensure", "SELECT 0 AS before, 0 AS rows, count(*) AS after FROM region")
def _(spark, sf):
    # a table is there before anything is written to it
    t = sinks.Table(spark, sinks.folder(spark), ["r_regionkey"], "r_regionkey int, r_name string")
    before, rows = t.version(), t.read().count()
    t.merge(fx.table(spark, sf, "region"))
    return t.read().agg(F.lit(before).alias("before"), F.lit(rows).alias("rows"), F.count("*").alias("after"))


@query("watchlist_changes", "SELECT 'src' || r_regionkey AS prefix, r_regionkey % 2 = 0 OR r_regionkey = 1 AS active, CASE WHEN r_regionkey = 1 THEN 7 ELSE r_regionkey END AS files FROM region UNION ALL SELECT 'new', true, 0")
def _(spark, sf):
    r = fx.table(spark, sf, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("prefix"), F.lit(True).alias("active"), F.col("r_regionkey").cast("int").alias("files"))
    t = sinks.Table.fresh(r, ["prefix"])
    t.update(F.col("files") % 2 == 1, active=F.lit(False))
    t.merge(spark.createDataFrame([("src1", True, 7), ("new", True, 0)], "prefix string, active boolean, files int"))
    return t.read()


@query("resync_apply", f"""WITH {RESYNC}, safe AS (SELECT * FROM plan WHERE bucket = 'SAFE') SELECT i.checksum, coalesce(s.new_canonical, i.canonical) AS path, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_filter(i.aliases, lambda a: NOT list_contains(coalesce(s.removes, []), a)), coalesce(s.adds, []))), lambda a: a <> coalesce(s.new_canonical, i.canonical))), ',') AS aliases
 FROM ix i LEFT JOIN safe s ON i.checksum = s.checksum WHERE i.checksum NOT IN (SELECT checksum FROM plan WHERE contains(reasons, 'ORPHANED_INDEX_CONTENT'))""")
def _(spark, sf):
    # safe items change paths and aliases, orphans are deleted (as an option of the caller)
    index, disk = index_and_disk(spark, sf)
    plan = reconciled(index, disk)
    t = sinks.Table.fresh(index.select("checksum", F.col("canonical").alias("path"), "aliases"), ["checksum"])
    safe = plan.where("bucket = 'SAFE'").join(t.read(), "checksum")
    path = F.coalesce("new_canonical", "path")
    changed = safe.select("checksum", path.alias("path"), F.array_sort(F.array_except(F.array_union(F.array_except("aliases", "removes"), "adds"), F.array(path))).alias("aliases"))
    t.merge(changed, insert=False)
    t.delete_keys(plan.where(F.col("reasons").contains("ORPHANED_INDEX_CONTENT")), "checksum")
    return t.read().select("checksum", "path", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("resync_apply_chunks", f"""WITH {RESYNC} SELECT c.id, coalesce(s.new_canonical, i.canonical) AS path FROM {_CH} c JOIN ix i USING (checksum) LEFT JOIN (SELECT * FROM plan WHERE bucket = 'SAFE') s USING (checksum) WHERE s.new_canonical IS NOT NULL""")
def _(spark, sf):
    # a canonical path that moves takes the paths of its chunks along
    plan = reconciled(*index_and_disk(spark, sf)).where("bucket = 'SAFE' and new_canonical is not null").select("checksum", F.col("new_canonical").alias("path"))
    t = chunk_table(spark, sf)
    moved = t.read().drop("path").join(plan, "checksum").select("id", "path")
    t.merge(moved, insert=False)
    return t.read().join(plan.select("checksum"), "checksum", "left_semi").select("id", "path")
