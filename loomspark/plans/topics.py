"""Topic analytics on vectors with given labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as s
from ..operators import tables as ops
from ..operators.quantiles import quantiles
from ..sources import fixtures as fx
from .registry import query

V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
CENTROIDS = f"(SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {V}) GROUP BY label, i) GROUP BY label)"
PARENT = "label % 3"


def _centroids(spark, sf):
    return ops.mean_vector(fx.table(spark, sf, "embeddings"), ["label"], "embedding", "c")


@query("l2_norms", f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM {V}")
def _(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.round(s.norm(F.col("embedding")), 6).alias("norm"))


@query("centroid_by_label", f"SELECT label, CAST(i - 1 AS INT) AS i, round(c[i], 6) AS x FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS i FROM {CENTROIDS})")
def _(spark, sf):
    return _centroids(spark, sf).select("label", F.posexplode("c").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("representatives_topn", f"SELECT label, vec_id, round(score, 6) AS score, n FROM (SELECT v.label, vec_id, list_cosine_similarity(e, c) AS score, row_number() OVER (PARTITION BY v.label ORDER BY round(list_cosine_similarity(e, c), 9) DESC, vec_id) AS n FROM {V} v JOIN {CENTROIDS} k USING (label)) WHERE n <= 10")
def _(spark, sf):
    h = fx.table(spark, sf, "embeddings").join(_centroids(spark, sf), "label").select("label", "vec_id", s.cosine(F.col("embedding"), F.col("c")).alias("score"))
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.round("score", 9).desc(), "vec_id")).cast("long")
    return h.withColumn("n", n).where("n <= 10").select("label", "vec_id", F.round("score", 6).alias("score"), "n")


@query("embedding_spread", f"SELECT label, round((1 - avg(list_cosine_similarity(e, c))) / 2, 6) AS spread FROM {V} v JOIN {CENTROIDS} k USING (label) GROUP BY label")
def _(spark, sf):
    h = fx.table(spark, sf, "embeddings").join(_centroids(spark, sf), "label")
    return h.groupBy("label").agg(F.round((1 - F.avg(s.cosine(F.col("embedding"), F.col("c")))) / 2, 6).alias("spread"))


@query("parent_summaries", f"SELECT {PARENT} AS parent, count(DISTINCT label) AS topics, count(*) AS size, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM embeddings GROUP BY 1")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    by = e.groupBy(F.expr(PARENT).alias("parent")).agg(F.count_distinct("label").alias("topics"), F.count("*").alias("size"))
    total = e.agg(F.count("*").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("parent", "topics", "size", F.round(F.col("size") / F.col("all"), 6).alias("share"))


@query("extension_entropy", f"SELECT source, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT source, ext, count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE AS p FROM {fx.FULLTEXT} GROUP BY source, ext) GROUP BY source")
def _(spark, sf):
    return ops.entropy(fx.fulltext(spark, sf), ["source"], "ext").select("source", F.round("entropy", 6).alias("entropy"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3)"


@query("keyword_bigrams_topn", f"SELECT lang, term, c AS n FROM (SELECT lang, term, count(*) AS c, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM (SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT lang, {_WORDS} AS w FROM documents)) GROUP BY lang, term) WHERE r <= 20")
def _(spark, sf):
    w = fx.table(spark, sf, "documents").select("lang", F.filter(s.tokens(F.col("text")), lambda x: F.length(x) >= 3).alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    t = w.select("lang", F.explode(F.concat("w", F.filter(pairs, lambda x: x.isNotNull()))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("r <= 20").select("lang", "term", "n")


@query("significant_terms_jlh", f"""WITH t AS (SELECT DISTINCT doc_id, source, unnest({_WORDS}) AS term FROM documents), fg AS (SELECT term, count(*) AS f FROM t WHERE source = 'src0' GROUP BY term), bg AS (SELECT term, count(*) AS b FROM t GROUP BY term), n AS (SELECT count(*) FILTER (WHERE source = 'src0') AS fn, count(*) AS bn FROM documents)
 SELECT term, f, b, round((f / fn::DOUBLE - b / bn::DOUBLE) * ((f / fn::DOUBLE) / (b / bn::DOUBLE)), 6) AS score FROM fg JOIN bg USING (term), n WHERE f / fn::DOUBLE > b / bn::DOUBLE AND f >= 3 ORDER BY round(score, 9) DESC, term LIMIT 30""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents")
    t = d.select("source", F.explode(F.array_distinct(F.filter(s.tokens(F.col("text")), lambda x: F.length(x) >= 3))).alias("term")).groupBy("term").agg(F.count_if(F.col("source") == "src0").alias("f"), F.count("*").alias("b"))
    n = d.agg(F.count_if(F.col("source") == "src0").alias("fn"), F.count("*").alias("bn"))
    p, q = F.col("f") / F.col("fn"), F.col("b") / F.col("bn")
    return t.where("f >= 3").crossJoin(F.broadcast(n)).where(p > q).select("term", "f", "b", F.round((p - q) * (p / q), 6).alias("score")).orderBy(F.desc("score"), "term").limit(30)


@query("review_metrics", "SELECT count(*) AS n, round(avg(CAST(toxic = 1 AS INT)), 6) AS toxic_share, count(*) FILTER (WHERE quality = 0) AS poor, round(quantile_cont(n_chars, 0.5), 6) AS median_chars, round(quantile_cont(n_chars, 0.1), 6) AS p10_chars FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    j = fx.table(spark, sf, "documents").select("doc_id", "n_chars").join(fx.table(spark, sf, "labels"), "doc_id")
    places = F.broadcast(quantiles(j, [], "n_chars", {"median_chars": 0.5, "p10_chars": 0.1}).withColumns({c: F.round(c, 6) for c in ("median_chars", "p10_chars")}))
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("toxic") == 1).cast("int")), 6).alias("toxic_share"), F.count_if(F.col("quality") == 0).alias("poor")).crossJoin(places)


@query("smart_sort_top2", f"""SELECT vec_id, label, round(score, 6) AS score, round(score - next, 6) AS margin FROM (SELECT vec_id, k.label, list_cosine_similarity(e, c) AS score, lead(list_cosine_similarity(e, c)) OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(e, c), 9) DESC, k.label) AS next, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(e, c), 9) DESC, k.label) AS n FROM {V} v, {CENTROIDS} k) WHERE n = 1""")
def _(spark, sf):
    # targets are few: one row a label
    h = fx.table(spark, sf, "embeddings").select("vec_id", "embedding").crossJoin(F.broadcast(_centroids(spark, sf))).select("vec_id", "label", s.cosine(F.col("embedding"), F.col("c")).alias("score"))
    w = Window.partitionBy("vec_id").orderBy(F.round("score", 9).desc(), "label")
    return h.withColumn("next", F.lead("score").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1").select("vec_id", "label", F.round("score", 6).alias("score"), F.round(F.col("score") - F.col("next"), 6).alias("margin"))


_FILE, _LENGTH = "vec_id // 16", "vec_id * 37 % 101"


@query("file_vector_pool", f"""WITH u AS (SELECT file, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT {_FILE} AS file, vec_id, e, row_number() OVER (PARTITION BY {_FILE} ORDER BY {_LENGTH} DESC, vec_id) AS r FROM {V}) WHERE r <= 8),
 m AS (SELECT file, i, avg(x) AS x FROM (SELECT file, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u) GROUP BY file, i) SELECT file, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY file)), 6) AS x FROM m""")
def _(spark, sf):
    # a file's eight longest chunks, each of length one, averaged and brought to length one again
    r = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("length"), "vec_id"))
    e = fx.table(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("file"), F.expr("vec_id * 37 % 101").alias("length"), "vec_id", "embedding").withColumn("r", r).where("r <= 8")
    unit = e.withColumn("norm", s.norm(F.col("embedding"))).select("file", F.posexplode("embedding").alias("i", "x"), "norm")
    mean = unit.groupBy("file", "i").agg(F.avg(F.col("x").cast("double") / F.col("norm")).alias("x"))
    return mean.select("file", "i", F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("file"))), 6).alias("x"))


@query("mixedness", f"""WITH k AS (SELECT label, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END AS entropy FROM (SELECT label, lang, count(*) / sum(count(*)) OVER (PARTITION BY label)::DOUBLE AS p FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label, lang) GROUP BY label),
 d AS (SELECT label, (1 - avg(list_cosine_similarity(e, c))) / 2 AS spread FROM {V} v JOIN {CENTROIDS} k USING (label) GROUP BY label) SELECT label, round(least(1, greatest(0, 0.85::DOUBLE * (0.45::DOUBLE * coalesce(entropy, 0) + 0.35::DOUBLE * spread) / 0.8::DOUBLE)), 6) AS mixedness FROM d LEFT JOIN k USING (label)""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    words = ops.entropy(e.select("vec_id", "label").join(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id"), ["label"], "lang")
    spread = e.join(_centroids(spark, sf), "label").groupBy("label").agg(((1 - F.avg(s.cosine(F.col("embedding"), F.col("c")))) / 2).alias("spread"))
    mixed = 0.85 * (0.45 * F.coalesce("entropy", F.lit(0.0)) + 0.35 * F.col("spread")) / 0.8
    return spread.join(words, "label", "left").select("label", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)), 6).alias("mixedness"))
