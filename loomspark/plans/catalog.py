"""Document catalogue, inventory and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tables as ops
from ..operators.quantiles import quantiles
from ..sources import fixtures as fx
from .registry import query

FT, INV = fx.FULLTEXT, fx.INVENTORY
NOW = fx.BASE_S + 400 * 3600


@query("file_list_latest", f"SELECT source, count(*) AS n, arg_max(path, modified_s) AS path, max(modified_s) AS modified_s FROM {FT} GROUP BY source")
def _(spark, sf):
    return ops.latest(fx.fulltext(spark, sf), "source", "modified_s", "path", "modified_s").select("source", "n", "path", "modified_s")


@query("duplicate_groups", f"SELECT checksum, count(*) AS n, min(path) AS canonical_path FROM {FT} GROUP BY checksum HAVING count(*) > 1")
def _(spark, sf):
    return fx.fulltext(spark, sf).groupBy("checksum").agg(F.count("*").alias("n"), F.min("path").alias("canonical_path")).where("n > 1")


@query("files_by_checksum", f"SELECT checksum, path, CASE WHEN path = min(path) OVER (PARTITION BY checksum) THEN 'canonical' ELSE 'alias' END AS location_type FROM {FT}")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).select("checksum", "path")
    first = ft.groupBy("checksum").agg(F.min("path").alias("m"))
    return ft.join(first, "checksum").select("checksum", "path", F.when(F.col("path") == F.col("m"), "canonical").otherwise("alias").alias("location_type"))


@query("missing_fulltext_anti", f"SELECT path FROM {FT} WHERE path NOT IN (SELECT path FROM {FT} WHERE doc_id % 5 = 0)")
def _(spark, sf):
    ft = fx.fulltext(spark, sf)
    return ops.missing(ft.select("path"), ft.where("doc_id % 5 = 0"), ["path"])


@query("facets_filetype", f"SELECT ext AS value, count(*) AS n FROM {FT} GROUP BY ext ORDER BY n DESC, value LIMIT 20")
def _(spark, sf):
    return ops.histogram(fx.fulltext(spark, sf), "ext", 20)


@query("facets_top_paths", f"SELECT value, count(*) AS n FROM (SELECT '/corpus/' || source || '/' || lang AS value FROM {FT}) GROUP BY value ORDER BY n DESC, value LIMIT 10")
def _(spark, sf):
    return ops.histogram(fx.fulltext(spark, sf), F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang"), 10)


@query("inventory_status_counts", f"""SELECT source, count(*) AS total, count(*) FILTER (WHERE last_indexed_s IS NULL) AS remaining, count(*) FILTER (WHERE last_indexed_s IS NULL AND size_bytes <= 2000) AS quick_wins,
 count(*) FILTER (WHERE size_bytes IS NULL) AS missing_size FROM {INV} WHERE exists_now GROUP BY source""")
def _(spark, sf):
    left = F.col("last_indexed_s").isNull()
    return fx.inventory(spark, sf).where("exists_now").groupBy("source").agg(F.count("*").alias("total"), F.count_if(left).alias("remaining"), F.count_if(left & (F.col("size_bytes") <= 2000)).alias("quick_wins"), F.count_if(F.col("size_bytes").isNull()).alias("missing_size"))


@query("inventory_unindexed_topn", f"SELECT path, size_bytes FROM {INV} WHERE exists_now AND last_indexed_s IS NULL ORDER BY size_bytes DESC NULLS LAST, path LIMIT 50")
def _(spark, sf):
    return fx.inventory(spark, sf).where("exists_now and last_indexed_s is null").select("path", "size_bytes").orderBy(F.desc_nulls_last("size_bytes"), "path").limit(50)


@query("inventory_quick_wins", f"SELECT path, size_bytes FROM {INV} WHERE exists_now AND last_indexed_s IS NULL AND size_bytes BETWEEN 1 AND 2000")
def _(spark, sf):
    return fx.inventory(spark, sf).where("exists_now and last_indexed_s is null and size_bytes between 1 and 2000").select("path", "size_bytes")


@query("inventory_needs_reingest", f"SELECT path, modified_s - last_indexed_s AS behind_s FROM {INV} WHERE exists_now AND modified_s > last_indexed_s")
def _(spark, sf):
    return fx.inventory(spark, sf).where("exists_now and modified_s > last_indexed_s").select("path", F.expr("modified_s - last_indexed_s").alias("behind_s"))


@query("watchlist_rollup", f"""SELECT source, total, greatest(0, total - remaining) AS indexed, round(100.0::DOUBLE * greatest(0, total - remaining) / total, 6) AS percent FROM
 (SELECT source, count(*) AS total, count(*) FILTER (WHERE last_indexed_s IS NULL) AS remaining FROM {INV} GROUP BY source)""")
def _(spark, sf):
    t = fx.inventory(spark, sf).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("last_indexed_s").isNull()).alias("remaining"))
    done = F.greatest(F.lit(0), F.col("total") - F.col("remaining"))
    return t.select("source", "total", done.alias("indexed"), F.round(F.try_divide(100.0 * done, "total"), 6).alias("percent"))


@query("search_filtered_paged", f"SELECT path, size_bytes FROM {FT} WHERE lang IN ('en', 'de') AND size_bytes BETWEEN 500 AND 5000 AND starts_with(path, '/corpus/src') ORDER BY modified_s DESC, path LIMIT 25 OFFSET 25")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).where(F.col("lang").isin("en", "de") & F.col("size_bytes").between(500, 5000) & F.col("path").startswith("/corpus/src"))
    return ft.orderBy(F.desc("modified_s"), "path").offset(25).limit(25).select("path", "size_bytes")


@query("path_contains", f"SELECT path FROM {FT} WHERE contains(regexp_replace(lower(path), '[^a-z0-9]+', '', 'g'), 'src1en')")
def _(spark, sf):
    return fx.fulltext(spark, sf).where(F.regexp_replace(F.lower("path"), "[^a-z0-9]+", "").contains("src1en")).select("path")


@query("rechunk_audit_grouping_sets", f"""SELECT dimension, value, count(*) AS n FROM (SELECT unnest([{{'dimension': 'ext', 'value': ext}}, {{'dimension': 'lang', 'value': lang}}, {{'dimension': 'bucket', 'value': bucket}}, {{'dimension': 'profile', 'value': profile}}], recursive := true)
 FROM (SELECT ext, lang, CASE WHEN length(text) <= 3000 THEN 'short' WHEN length(text) <= 20000 THEN 'medium' ELSE 'long' END AS bucket, CASE ext WHEN 'txt' THEN '400/50' WHEN 'pdf' THEN '600/80' ELSE '800/100' END AS profile FROM {FT})) GROUP BY ALL""")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).select("ext", "lang", tx.length_bucket(F.length("text")).alias("bucket"), tx.chunk_profile(F.col("ext")).alias("profile"))
    return ops.grouping_sets(ft, ["ext", "lang", "bucket", "profile"])


@query("chunk_vector_discrepancy", f"""SELECT f.doc_id, n_chunks, coalesce(n_vectors, 0) AS n_vectors FROM (SELECT doc_id, 1 + greatest(length(text) - 1, 0) // 700 AS n_chunks FROM {FT}) f
 LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n_vectors FROM embeddings GROUP BY vec_id) v USING (doc_id) WHERE n_chunks <> coalesce(n_vectors, 0)""")
def _(spark, sf):
    chunks = fx.fulltext(spark, sf).select("doc_id", F.expr("1 + greatest(length(text) - 1, 0) div 700").alias("n_chunks"))
    v = fx.table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("n_vectors"))
    return chunks.join(v, "doc_id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0))).where("n_chunks <> n_vectors")


@query("inventory_upsert_merge", f"""SELECT coalesce(t.path, u.path) AS path, coalesce(u.size_bytes, t.size_bytes) AS size_bytes, coalesce(u.modified_s, t.modified_s) AS modified_s FROM
 (SELECT path, size_bytes, modified_s FROM {INV} WHERE exists_now) t FULL JOIN (SELECT path, size_bytes + 1 AS size_bytes, modified_s + 5 AS modified_s FROM {FT} WHERE doc_id % 6 = 0) u ON t.path = u.path""")
def _(spark, sf):
    target = fx.inventory(spark, sf).where("exists_now").select("path", "size_bytes", "modified_s")
    updates = fx.fulltext(spark, sf).where("doc_id % 6 = 0").selectExpr("path", "size_bytes + 1 size_bytes", "modified_s + 5 modified_s")
    return ops.merge(target, updates, ["path"])


@query("mark_missing", f"SELECT path, exists_now AND path IN (SELECT path FROM {FT} WHERE doc_id % 4 <> 1) AS exists_now FROM {INV}")
def _(spark, sf):
    seen = fx.fulltext(spark, sf).where("doc_id % 4 <> 1").select("path", F.lit(True).alias("seen"))
    return fx.inventory(spark, sf).join(seen, "path", "left").select("path", (F.col("exists_now") & F.coalesce("seen", F.lit(False))).alias("exists_now"))


@query("purge_prefix_counts", f"SELECT 'inventory' AS name, count(*) AS n FROM {INV} WHERE starts_with(path, '/corpus/src1/') UNION ALL SELECT 'fulltext', count(*) FROM {FT} WHERE starts_with(path, '/corpus/src1/')")
def _(spark, sf):
    n = lambda df, name: df.where(F.col("path").startswith("/corpus/src1/")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(fx.inventory(spark, sf), "inventory").unionByName(n(fx.fulltext(spark, sf), "fulltext"))


@query("backfill_fill_missing", f"SELECT i.path, coalesce(i.size_bytes, f.size_bytes) AS size_bytes FROM {INV} i JOIN {FT} f USING (path)")
def _(spark, sf):
    have = fx.fulltext(spark, sf).select("path", F.col("size_bytes").alias("s"))
    return fx.inventory(spark, sf).join(have, "path").select("path", F.coalesce("size_bytes", "s").alias("size_bytes"))


@query("schema_evolve_union", f"SELECT path, lang, CAST(NULL AS BIGINT) AS size_bytes FROM {FT} WHERE doc_id % 2 = 0 UNION ALL SELECT path, NULL, size_bytes FROM {FT} WHERE doc_id % 2 = 1")
def _(spark, sf):
    ft = fx.fulltext(spark, sf)
    return ops.union_evolved(ft.where("doc_id % 2 = 0").select("path", "lang"), ft.where("doc_id % 2 = 1").select("path", "size_bytes"))


@query("ingest_log_search", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value >= 10 ORDER BY ts DESC, event_id LIMIT 100")
def _(spark, sf):
    return fx.table(spark, sf, "events").where("event_type = 'error' and value >= 10").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "value")


@query("failed_tasks_window", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS failed, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    e = fx.table(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("failed"), F.count_distinct("user_id").alias("users"))


@query("stage_timing_p95", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    total = e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return total.join(quantiles(e, ["event_type"], "value", {"p95": 0.95}), "event_type").withColumn("p95", F.round("p95", 6))


@query("ttl_cache_lookup", f"SELECT sha256(text) AS key, count(*) AS hits, max({fx.BASE_S} + conv_id * 86400) AS expires_s FROM conversations WHERE {fx.BASE_S} + conv_id * 86400 > {NOW} GROUP BY 1")
def _(spark, sf):
    c = fx.table(spark, sf, "conversations").withColumn("expires_s", F.lit(fx.BASE_S) + F.col("conv_id") * 86400)
    return c.where(F.col("expires_s") > NOW).groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("hits"), F.max("expires_s").alias("expires_s"))


@query("tree_fingerprint", f"SELECT sha256(string_agg(bucket || digest, '' ORDER BY bucket)) AS fingerprint, count(*) AS buckets FROM (SELECT substring(sha256(path), 1, 4) AS bucket, sha256(string_agg(path || chr(1) || size_bytes || chr(1) || modified_s, chr(2) ORDER BY path)) AS digest FROM {FT} GROUP BY 1)")
def _(spark, sf):
    # files are dealt to 65,536 buckets by a hash of the path; the one row at the end holds the buckets' digests alone
    line = F.concat_ws("\x01", "path", F.col("size_bytes").cast("string"), F.col("modified_s").cast("string"))
    b = fx.fulltext(spark, sf).groupBy(F.substring(F.sha2("path", 256), 1, 4).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("r")))).alias("a"))
    b = b.select("bucket", F.sha2(F.concat_ws("\x02", F.transform("a", lambda x: x["r"])), 256).alias("digest"))
    one = b.agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("a"), F.count("*").alias("buckets"))
    return one.select(F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["bucket"], x["digest"])), ""), 256).alias("fingerprint"), "buckets")


@query("record_merge_duplicates", f"""SELECT counterparty, year, record_type, count(*) AS n, round(sum(amount), 2) AS total, max(confidence) AS confidence, min(amount) AS least_amount FROM {fx.RECORDS} GROUP BY counterparty, year, record_type""")
def _(spark, sf):
    r = fx.records(spark, sf)
    return r.groupBy("counterparty", "year", "record_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max("confidence").alias("confidence"), F.min("amount").alias("least_amount"))


@query("finance_answer_buckets", f"""SELECT counterparty, CASE WHEN record_type <> 'payment' THEN 'other_concept' WHEN year <> 1996 THEN 'mentioned' WHEN confidence >= 0.65 THEN 'clearly_supported' ELSE 'ambiguous' END AS bucket, count(*) AS n FROM {fx.RECORDS} GROUP BY ALL""")
def _(spark, sf):
    b = F.when(F.col("record_type") != "payment", "other_concept").when(F.col("year") != 1996, "mentioned").when(F.col("confidence") >= 0.65, "clearly_supported").otherwise("ambiguous")
    return fx.records(spark, sf).groupBy("counterparty", b.alias("bucket")).agg(F.count("*").alias("n"))


@query("records_for_customers", f"SELECT order_id, line, amount FROM {fx.RECORDS} WHERE counterparty IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING') AND year = 1996")
def _(spark, sf):
    who = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("counterparty"))
    return fx.records(spark, sf).where("year = 1996").join(who, "counterparty", "left_semi").select("order_id", "line", "amount")
