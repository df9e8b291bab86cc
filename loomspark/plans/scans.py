"""Scans and lookups: files, pages of results, points, samples, and tests whether something is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import path_index as pi
from ..operators import search as s
from ..operators import tables as ops
from ..sources import files
from ..sources import fixtures as fx
from ..streaming.jobs import folder
from . import endtoend as e2e
from .registry import query

FT, INV = fx.FULLTEXT, fx.INVENTORY


def tree(spark, sf) -> str:
    """A folder with a text file for each region that holds its nations' names, a line each."""
    out = folder(spark)
    n = fx.table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", F.col("n_name").alias("value"))
    n.repartition(1).sortWithinPartitions("region", "n_nationkey").drop("n_nationkey").write.partitionBy("region").text(out)
    return out


_TREE = "(SELECT n_regionkey AS region, string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey)"


def _region():
    return F.regexp_extract("path", "region=([0-9]+)", 1).cast("int").alias("region")


@query("file_scan", f"SELECT region, strlen(content) AS size, 'txt' AS ext, sha256(content) AS checksum FROM {_TREE} WHERE region <> 4 AND strlen(content) >= 30")
def _(spark, sf):
    return files.listing(spark, tree(spark, sf), least_bytes=30, with_checksum=True, ignored=("region=4",)).select(_region(), "size", "ext", "checksum")


@query("file_scan_limit", f"SELECT region, strlen(content) AS size FROM {_TREE} ORDER BY region LIMIT 3")
def _(spark, sf):
    return files.listing(spark, tree(spark, sf), limit=3).select(_region(), "size")


@query("text_files_read", f"SELECT region, 0 AS page, content AS text FROM {_TREE}")
def _(spark, sf):
    return files.documents(spark, tree(spark, sf)).select(_region(), "page", "text")


@query("loader_outputs", "SELECT doc_id AS id, sha256(coalesce(text, '')) AS text, CASE doc_id % 4 WHEN 3 THEN 'lang=' || lang ELSE 'lang=' || lang || ',source=' || CASE WHEN doc_id % 4 = 0 THEN 'own' ELSE source END END AS metadata FROM documents")
def _(spark, sf):
    # outputs as loaders give them: contents under three names, metadata beside or within
    d, k = fx.table(spark, sf, "documents"), F.col("doc_id") % 4
    raw = d.select(F.col("doc_id").alias("id"), F.when(k == 0, F.col("text")).alias("page_content"), F.when(k == 1, F.col("text")).alias("text"), F.when(k >= 2, F.col("text")).alias("content"),
                   F.when(k == 0, F.create_map(F.lit("source"), F.lit("own"), F.lit("lang"), F.col("lang"))).when(k == 3, F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"), F.when(k != 3, F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("extra"))
    m = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return files.coerced(raw).select("id", F.sha2("text", 256).alias("text"), m.alias("metadata"))


@query("question_file", "SELECT 'v1' AS version, CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 7 = 4 THEN 'control' ELSE 'positive' END AS mode, text AS query FROM benchmark")
def _(spark, sf):
    # one JSON object over many lines, written from the stated question set and read back
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 7 == 4, "control").otherwise("positive").alias("mode"), F.col("text").alias("query"))
    out = folder(spark)
    b.agg(F.to_json(F.struct(F.struct(F.lit("v1").alias("version")).alias("meta"), F.collect_list(F.struct("id", "mode", "query")).alias("queries")), {"pretty": "true"}).alias("value")).coalesce(1).write.text(out)
    return files.question_set(spark, out).select("version", "id", "mode", "query")


# --- pages, points, samples ---

@query("keyset_page", f"SELECT path, modified_s FROM {FT} WHERE (modified_s, path) > ({fx.BASE_S + 100 * 3600}, '/corpus/src1') ORDER BY modified_s, path LIMIT 50")
def _(spark, sf):
    # the page after a key; no offset is counted out
    after, path = fx.BASE_S + 100 * 3600, "/corpus/src1"
    later = (F.col("modified_s") > after) | ((F.col("modified_s") == after) & (F.col("path") > path))
    return fx.fulltext(spark, sf).select("path", "modified_s").where(later).orderBy("modified_s", "path").limit(50)


@query("scan_snapshot", f"SELECT checksum, min(path) AS canonical, count(*) AS n, count(*) > 1 AS duplicated FROM {FT} GROUP BY checksum")
def _(spark, sf):
    return fx.fulltext(spark, sf).select("checksum", "path").groupBy("checksum").agg(F.min("path").alias("canonical"), F.count("*").alias("n")).withColumn("duplicated", F.col("n") > 1)


_ALIASED = f"(SELECT checksum, p[1] AS path, p[2:] AS aliases FROM (SELECT checksum, list_sort(list(path)) AS p FROM {FT} GROUP BY checksum))"


def aliased(spark, sf) -> DataFrame:
    g = fx.fulltext(spark, sf).groupBy("checksum").agg(F.sort_array(F.collect_list("path")).alias("p"))
    return g.select("checksum", F.get("p", F.lit(0)).alias("path"), F.expr("slice(p, 2, size(p))").alias("aliases"))


@query("path_or_alias_lookup", f"SELECT w.path AS asked, a.path, a.path = w.path AS is_canonical FROM (SELECT path FROM {FT} WHERE doc_id % 50 = 0) w JOIN {_ALIASED} a ON a.path = w.path OR list_contains(a.aliases, w.path)")
def _(spark, sf):
    # the stated paths, each found as a canonical path or an alias, by one equi join
    wanted = fx.fulltext(spark, sf).where("doc_id % 50 = 0").select(F.col("path").alias("asked"))
    a = aliased(spark, sf).select("path", F.explode(F.concat(F.array("path"), "aliases")).alias("asked"))
    return a.join(s.small(wanted), "asked").select("asked", "path", (F.col("path") == F.col("asked")).alias("is_canonical"))


@query("multi_get", f"SELECT id, sha256(text) AS text FROM {e2e.CHUNKS} WHERE id IN (SELECT vec_id * {e2e.STRIDE} FROM embeddings WHERE vec_id % 50 = 0)")
def _(spark, sf):
    ids = fx.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select((F.col("vec_id") * e2e.STRIDE).alias("id"))
    return e2e.chunks(spark, sf).join(s.small(ids), "id", "left_semi").select("id", F.sha2("text", 256).alias("text"))


@query("vector_checksums", f"SELECT DISTINCT checksum FROM {FT} JOIN embeddings ON vec_id = doc_id")
def _(spark, sf):
    return fx.fulltext(spark, sf).join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("checksum").distinct()


@query("missing_file_vectors", f"SELECT DISTINCT checksum FROM {FT} WHERE checksum NOT IN (SELECT checksum FROM {FT} JOIN embeddings ON vec_id = doc_id)")
def _(spark, sf):
    ft = fx.fulltext(spark, sf).select("doc_id", "checksum")
    have = ft.join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("checksum")
    return ft.select("checksum").distinct().join(have.distinct(), "checksum", "left_anti")


@query("vector_sample", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings ORDER BY vec_id LIMIT 10")
def _(spark, sf):
    return fx.table(spark, sf, "embeddings").orderBy("vec_id").limit(10).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(s.norm(F.col("embedding")), 6).alias("norm"))


@query("up_to_date", f"SELECT i.path, coalesce(i.last_indexed_s >= i.modified_s, false) AS up_to_date, d.n > 1 AS is_duplicate FROM {INV} i JOIN (SELECT path, count(*) OVER (PARTITION BY checksum) AS n FROM {FT}) d USING (path)")
def _(spark, sf):
    twice = fx.fulltext(spark, sf).groupBy("checksum").agg((F.count("*") > 1).alias("is_duplicate"))
    d = fx.fulltext(spark, sf).select("path", "checksum").join(twice, "checksum")
    return fx.inventory(spark, sf).join(d, "path").select("path", F.coalesce(F.col("last_indexed_s") >= F.col("modified_s"), F.lit(False)).alias("up_to_date"), "is_duplicate")


@query("chunk_counts_by_path", f"SELECT path, count(*) AS n FROM {e2e.CHUNKS} WHERE starts_with(path, '/corpus/src1/') GROUP BY path ORDER BY path LIMIT 100")
def _(spark, sf):
    return e2e.chunks(spark, sf).where(F.col("path").startswith("/corpus/src1/")).groupBy("path").agg(F.count("*").alias("n")).orderBy("path").limit(100)


@query("chunks_with_vectors", f"SELECT c.id, c.checksum, count(v.vec_id) AS vectors FROM {e2e.CHUNKS} c JOIN (SELECT vec_id, checksum, 0 AS chunk_index FROM embeddings JOIN {FT} ON doc_id = vec_id) v ON v.checksum = c.checksum AND v.chunk_index = c.chunk_index GROUP BY c.id, c.checksum")
def _(spark, sf):
    # points by content and place; equal texts share their points
    v = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).join(fx.fulltext(spark, sf).select("doc_id", "checksum"), "doc_id").select("checksum", F.lit(0).cast("long").alias("chunk_index"))
    n = v.groupBy("checksum", "chunk_index").agg(F.count("*").alias("vectors"))
    return e2e.chunks(spark, sf).select("id", "checksum", "chunk_index").join(n, ["checksum", "chunk_index"]).select("id", "checksum", "vectors")


@query("topic_lookups", "SELECT vec_id, coalesce(parent, -1) AS parent FROM embeddings LEFT JOIN (SELECT DISTINCT label, label % 3 AS parent FROM embeddings WHERE label <> 4) USING (label)")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    parents = e.where("label <> 4").select("label", (F.col("label") % 3).alias("parent")).distinct()
    return e.join(s.small(parents), "label", "left").select("vec_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("search_totals", f"SELECT lang, ext, count(*) AS n, (SELECT count(*) FROM {FT} WHERE size_bytes >= 500) AS facet_base FROM {FT} WHERE size_bytes >= 500 AND ext = 'pdf' GROUP BY lang, ext")
def _(spark, sf):
    # facets count before the post-filter, hits after it
    base = fx.fulltext(spark, sf).where("size_bytes >= 500")
    return base.where("ext = 'pdf'").groupBy("lang", "ext").agg(F.count("*").alias("n")).crossJoin(F.broadcast(base.agg(F.count("*").alias("facet_base"))))


@query("bool_should", f"SELECT doc_id FROM {FT} WHERE lang <> 'fr' AND (CAST(ext = 'pdf' AS INT) + CAST(size_bytes < 1000 AS INT) + CAST(contains(path, 'src1') AS INT)) >= 2")
def _(spark, sf):
    # must not, and two at least of three that should hold
    n = sum(c.cast("int") for c in (F.col("ext") == "pdf", F.col("size_bytes") < 1000, F.col("path").contains("src1")))
    return fx.fulltext(spark, sf).where((F.col("lang") != "fr") & (n >= 2)).select("doc_id")


@query("wildcard_paths", f"SELECT path FROM {FT} WHERE regexp_matches(path, '^/corpus/src[0-9]*/.n/doc_1.*\\.pdf$')")
def _(spark, sf):
    # * and ? in a term are live: they become % and _, and what like would read otherwise is escaped
    term = "/corpus/src*/?n/doc_1*.pdf"
    like = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return fx.fulltext(spark, sf).where(F.col("path").like(like)).select("path")


@query("path_query", f"SELECT q, count(*) AS n FROM (VALUES ('src1en'), ('sr'), ('Doc 77'), ('nowhere')) t(q), {FT} WHERE length(regexp_replace(lower(q), '[^a-z0-9]+', '', 'g')) < 3 OR contains(regexp_replace(lower(path), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(q), '[^a-z0-9]+', '', 'g')) GROUP BY q")
def _(spark, sf):
    # a term of fewer than three characters filters nothing
    t = spark.createDataFrame([("src1en",), ("sr",), ("Doc 77",), ("nowhere",)], "q string")
    found = pi.find_paths(path_index(spark, sf), t.select(F.col("q").alias("term"))).groupBy(F.col("term").alias("q")).agg(F.count("*").alias("n"))
    every = fx.fulltext(spark, sf).agg(F.count("path").alias("n"))
    return found.unionByName(t.where(~pi.filters(F.col("q"))).crossJoin(F.broadcast(every)))


def path_index(spark, sf):
    return pi.index_once(fx.fulltext(spark, sf).select("path"), "fulltext", [f"{sf}/documents.parquet"])


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_PATH_TERMS = "CASE item_id % 4 WHEN 0 THEN 'doc ' || item_id WHEN 1 THEN 'SRC' || item_id % 9 || '/En' WHEN 2 THEN item_id || '.PDF' ELSE 'x' || item_id END"


@query("path_ngram_search", f"SELECT item_id, term, path FROM (SELECT item_id, {_PATH_TERMS} AS term FROM benchmark), {FT} WHERE length({_PLAIN.format('term')}) >= 3 AND contains({_PLAIN.format('path')}, {_PLAIN.format('term')})")
def _(spark, sf):
    # a term for each benchmark item
    i = F.col("item_id").cast("string")
    kinds = [F.concat(F.lit("doc "), i), F.concat(F.lit("SRC"), (F.col("item_id") % 9).cast("string"), F.lit("/En")), F.concat(i, F.lit(".PDF")), F.concat(F.lit("x"), i)]
    t = fx.table(spark, sf, "benchmark").select("item_id", F.element_at(F.array(*kinds), (F.col("item_id") % 4 + 1).cast("int")).alias("term"))
    return pi.find_paths(path_index(spark, sf), t).join(s.small(t), "term").select("item_id", "term", "path")


@query("missing_within_roots", f"SELECT path FROM {INV} WHERE NOT exists_now AND (path = '/corpus/src0' OR starts_with(path, '/corpus/src0/') OR starts_with(path, '/corpus/src10/') OR path = '/corpus/src1' OR starts_with(path, '/corpus/src1/'))")
def _(spark, sf):
    from .sync import _within

    return fx.inventory(spark, sf).where(~F.col("exists_now") & _within(F.col("path"), ("/corpus/src0", "/corpus/src10/", "/corpus/src1"))).select("path")


@query("set_algebra", f"WITH a AS (SELECT checksum FROM {FT} WHERE doc_id % 2 = 0), b AS (SELECT checksum FROM {FT} WHERE doc_id % 3 = 0) SELECT 'both' AS kind, count(*) AS n FROM (SELECT checksum FROM a INTERSECT SELECT checksum FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT checksum FROM a EXCEPT ALL SELECT checksum FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT checksum FROM a UNION SELECT checksum FROM b)")
def _(spark, sf):
    ft = fx.fulltext(spark, sf)
    a, b = ft.where("doc_id % 2 = 0").select("checksum"), ft.where("doc_id % 3 = 0").select("checksum")
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "first_only")).unionByName(n(a.union(b).distinct(), "either"))


@query("weighted_average", "SELECT label, round(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE avg(v) END, 6) AS v FROM (SELECT label, (vec_id * 37 % 101) / 100.0::DOUBLE AS v, CASE WHEN label = 3 THEN 0 ELSE vec_id % 7 END AS w FROM embeddings) GROUP BY label")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("label", (F.col("vec_id") * 37 % 101 / 100.0).alias("v"), F.when(F.col("label") == 3, 0).otherwise(F.col("vec_id") % 7).alias("w"))
    return e.groupBy("label").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")), F.avg("v")), 6).alias("v"))


@query("keyword_weights", "WITH t AS (SELECT source, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT source, term, CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 0.4::DOUBLE * n ELSE n END AS weight FROM c WHERE NOT regexp_matches(term, '^[0-9]+$') OR n >= 3) SELECT source, term, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 15")
def _(spark, sf):
    # numbers count less, and rare ones not at all
    t = fx.table(spark, sf, "documents").select("source", F.explode(F.filter(s.tokens(F.col("text")), lambda x: F.length(x) >= 3)).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    number = F.col("term").rlike("^[0-9]+$")
    w = t.where(~number | (F.col("n") >= 3)).withColumn("weight", F.when(number, 0.4 * F.col("n")).otherwise(F.col("n").cast("double")))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "term"))
    return w.withColumn("r", r).where("r <= 15").select("source", "term", F.round("weight", 4).alias("weight"))


@query("parent_probabilities", "SELECT parent, topics, total, round(prob, 6) AS prob, total = max(total) OVER () AS largest FROM (SELECT label % 3 AS parent, count(*) AS topics, CAST(sum(size) AS BIGINT) AS total, sum(size * prob) / sum(size) AS prob FROM (SELECT label, count(*) AS size, avg((vec_id * 37 % 101) / 100.0::DOUBLE) AS prob FROM embeddings GROUP BY label) GROUP BY 1)")
def _(spark, sf):
    by = fx.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.avg(F.col("vec_id") * 37 % 101 / 100.0).alias("prob"))
    p = by.groupBy((F.col("label") % 3).alias("parent")).agg(F.count("*").alias("topics"), F.sum("size").alias("total"), (F.sum(F.col("size") * F.col("prob")) / F.sum("size")).alias("prob"))
    return p.crossJoin(F.broadcast(p.agg(F.max("total").alias("m")))).select("parent", "topics", "total", F.round("prob", 6).alias("prob"), (F.col("total") == F.col("m")).alias("largest"))


@query("hits_with_text", f"WITH {e2e.DENSE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense) SELECT query_id, t.id, rank, sha256(coalesce(c.text, 'payload')) AS text FROM t LEFT JOIN {e2e.CHUNKS} c ON c.id = t.id WHERE rank <= 5")
def _(spark, sf):
    c, v, _, qv = e2e.inputs(spark, sf)
    h = s.top_k(s.cosine_hits(v, qv).withColumn("score", F.round("score", 9)), 5, F.desc("score"), F.asc("id"))
    return c.select("id", "text").join(s.small(h), "id", "right").select("query_id", "id", "rank", F.sha2(F.coalesce("text", F.lit("payload")), 256).alias("text"))


@query("text_pages", "SELECT conv_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS full_text, max(turn) AS last FROM conversations GROUP BY conv_id")
def _(spark, sf):
    # a text is its pages with a blank line between; a conversation's turns stand for pages
    g = fx.table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), F.max("turn").alias("last"))
    return g.select("conv_id", F.trim(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("full_text"), "last")


@query("metadata_merge", f"SELECT path, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'new' END, lang) AS lang, coalesce(CASE WHEN doc_id % 5 = 0 THEN size_bytes + 1 END, size_bytes) AS size_bytes FROM {FT}")
def _(spark, sf):
    # nulls of the newer metadata don't go over what is known
    ft = fx.fulltext(spark, sf)
    new = ft.select("path", F.when(F.col("doc_id") % 3 == 0, "new").alias("lang"), F.when(F.col("doc_id") % 5 == 0, F.col("size_bytes") + 1).alias("size_bytes"))
    return ops.merge(ft.select("path", "lang", "size_bytes"), new, ["path"])
