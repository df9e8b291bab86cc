"""Topics: density clusters of vectors, macro groups, profiles and names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clusters as cl
from ..functions import fields as fi
from ..operators import search as s
from ..operators import tables as ops
from ..sources import fixtures as fx
from .helpers import _NAME_TOKENS, _TITLE
from .registry import query
from .topics import CENTROIDS, V

#: Vectors that one task clusters, at most: a sample by hash, whose clusters take in the others by their centroids.
FIT, LEAST, NEIGHBOURS = 4000, 8, 4


def density_topics(vectors: DataFrame, least: int = LEAST, neighbours: int = NEIGHBOURS, fit: int = FIT) -> DataFrame:
    """id, topic, prob of vectors (id, v). Up to fit of them, by hash of their id, are clustered in one task, as lines of one length; each other one goes to the topic
    of the nearest centroid, if it is no further from it than the topic's furthest member, else to none (-1)."""
    v = vectors.where("v is not null").select("id", s.unit(F.col("v")).alias("v"))
    sample = v.orderBy(F.xxhash64("id"), "id").limit(fit).withColumn("g", F.lit(0))

    def run(f):  # noqa: ANN001, ANN202
        f = f.sort_values("id")
        x = np.array(f["v"].tolist(), float)
        topic, prob = cl.density_clusters(x, least, neighbours) if len(f) else ([], [])
        return f[["id"]].assign(topic=topic, prob=prob)

    fitted = sample.groupBy("g").applyInPandas(run, "id long, topic long, prob double")
    from ..operators.sinks import Table

    fitted = Table.fresh(fitted, ["id"]).read()
    centroid = ops.mean_vector(v.join(fitted.where("topic >= 0"), "id"), ["topic"], "v", "c").withColumn("c", s.unit(F.col("c")))
    inside = v.join(fitted, "id").join(s.small(centroid), "topic").groupBy("topic").agg(F.min(s.dot(F.col("v"), F.col("c"))).alias("least"))
    topics = centroid.join(inside, "topic")
    rest = v.join(fitted, "id", "left_anti").crossJoin(s.small(topics, 100_000)).withColumn("cos", s.dot(F.col("v"), F.col("c")))
    near = rest.groupBy("id").agg(F.max_by(F.struct("topic", "cos", "least"), F.struct("cos", -F.col("topic"))).alias("b"))
    ok = F.col("b.cos") >= F.col("b.least")
    return fitted.unionByName(near.select("id", F.when(ok, F.col("b.topic")).otherwise(F.lit(-1)).alias("topic"), F.when(ok, F.greatest(F.col("b.cos"), F.lit(0.0))).otherwise(0.0).alias("prob")))


def _vectors(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("topic_clusters")
def _(spark, sf):
    return density_topics(_vectors(spark, sf))


def grouped_topics(topics: DataFrame) -> DataFrame:
    """topic, parent, k, silhouette, largest_share of topics (topic, c, size): topics are few, so one task groups them."""
    def run(f):  # noqa: ANN001, ANN202
        f = f.sort_values("topic")
        c, n = np.array(f["c"].tolist(), float), f["size"].to_numpy(float)
        labels, m = cl.macro_groups(c, n)
        return f[["topic"]].assign(parent=cl.split_largest(labels, c, n), k=m["k"], silhouette=round(m["silhouette"] or 0.0, 6), largest_share=round(m["largest_share"], 6))

    return topics.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "topic long, parent long, k long, silhouette double, largest_share double")


@query("topic_macro_groups")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("topic", F.col("label").cast("long"))
    return grouped_topics(ops.mean_vector(e, ["topic"], "embedding", "c").join(e.groupBy("topic").agg(F.count("*").alias("size")), "topic"))


@query("topics_end_to_end")
def _(spark, sf):
    t = density_topics(_vectors(spark, sf)).join(_vectors(spark, sf), "id")
    sizes = t.where("topic >= 0").groupBy("topic").agg(F.count("*").alias("size"), F.avg("prob").alias("avg_prob"))
    parents = grouped_topics(ops.mean_vector(t.where("topic >= 0"), ["topic"], "v", "c").join(sizes, "topic"))
    return t.select("id", "topic", "prob").join(s.small(parents.select("topic", "parent")), "topic", "left").select("id", "topic", F.coalesce("parent", F.lit(-1)).alias("parent"), F.round("prob", 6).alias("prob"))


@query("representatives_diverse")
def _(spark, sf):
    # the nearest hundred of each label stand for it; of these the diverse ones are taken
    e = fx.table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    c = ops.mean_vector(e, ["label"], "embedding", "c")
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cos"), "vec_id"))
    near = e.join(s.small(c), "label").withColumn("cos", F.round(s.cosine(F.col("embedding"), F.col("c")), 9)).withColumn("n", n).where("n <= 100")

    def run(f):  # noqa: ANN001, ANN202
        f = f.sort_values("n")
        pick = cl.diverse(np.array(f["embedding"].tolist()), np.array(f["c"].iloc[0]), 5)
        return f[["label"]].iloc[pick].assign(vec_id=f["vec_id"].iloc[pick], place=range(1, len(pick) + 1))

    return near.groupBy("label").applyInPandas(run, "label long, vec_id long, place long")


# --- profiles and names ---

WORDS, MIXED, SURE = 5, 0.85, 0.55
_MEMBERS = f"(SELECT label, vec_id, path, {_NAME_TOKENS.format('path')} AS w, regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS ext FROM embeddings JOIN {fx.CATALOG} ON doc_id = vec_id)"
_PROFILES = f"""k AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(w) AS term FROM {_MEMBERS}) GROUP BY ALL), kw AS (SELECT label, string_agg(term, ',' ORDER BY n DESC, term) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS r FROM k) WHERE r <= {WORDS} GROUP BY label),
x AS (SELECT label, string_agg(ext || ':' || n, ',' ORDER BY n DESC, ext) AS extensions FROM (SELECT label, ext, count(*) AS n FROM {_MEMBERS} GROUP BY ALL) GROUP BY label),
sp AS (SELECT label, count(*) AS size, (1 - avg(list_cosine_similarity(e, c))) / 2 AS spread, avg(list_cosine_similarity(e, c)) AS confidence FROM {V} v JOIN {CENTROIDS} k USING (label) GROUP BY label)"""


def profiles(spark, sf) -> DataFrame:
    """label, size, keywords, extensions, spread, confidence of each label."""
    e = fx.table(spark, sf, "embeddings")
    m = e.select("label", F.col("vec_id").alias("doc_id")).join(fx.catalog(spark, sf).select("doc_id", "path"), "doc_id")

    def top(column, k: int, name: str, show) -> DataFrame:
        n = m.select("label", column.alias("x")).groupBy("label", "x").agg(F.count("*").alias("n"))
        r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "x"))
        best = n.withColumn("r", r).where(F.col("r") <= k).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "x", "n"))).alias("a"))
        return best.select("label", F.array_join(F.transform("a", show), ",").alias(name))

    words = top(F.explode(fi.name_tokens(F.col("path"))), WORDS, "keywords", lambda a: a["x"])
    ext = top(fi.extension(F.col("path")), 1000, "extensions", lambda a: F.concat(a["x"], F.lit(":"), a["n"].cast("string")))
    cos = s.cosine(F.col("embedding"), F.col("c"))
    spread = e.join(s.small(ops.mean_vector(e, ["label"], "embedding", "c")), "label").groupBy("label").agg(F.count("*").alias("size"), ((1 - F.avg(cos)) / 2).alias("spread"), F.avg(cos).alias("confidence"))
    return spread.join(words, "label", "left").join(ext, "label", "left")


@query("topic_profiles", f"WITH {_PROFILES} SELECT label, size, keywords, extensions, round(spread, 6) AS spread FROM sp LEFT JOIN kw USING (label) LEFT JOIN x USING (label)")
def _(spark, sf):
    return profiles(spark, sf).select("label", "size", "keywords", "extensions", F.round("spread", 6).alias("spread"))


_BASE = _TITLE.format("array_to_string(list_slice(string_split(keywords, ','), 1, 3), ' ')")
_NAMED = f"""{_PROFILES}, nm AS (SELECT label, label % 3 AS parent, size, spread, confidence, CASE WHEN coalesce(keywords, '') = '' THEN 'Cluster ' || label ELSE {_BASE} END AS base FROM sp LEFT JOIN kw USING (label)),
nn AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY label) AS k FROM nm)"""


@query("topic_names", f"""WITH {_NAMED} SELECT label, CASE WHEN k = 1 THEN base ELSE base || ' (' || k || ')' END AS name, parent, round(confidence, 6) AS confidence, spread / 0.5 >= {MIXED}::DOUBLE AS mixed, confidence < {SURE}::DOUBLE AS low_confidence FROM nn""")
def _(spark, sf):
    # the baseline: the first three keywords; equal names get numbers
    p = profiles(spark, sf).withColumn("base", F.when(F.coalesce("keywords", F.lit("")) == "", F.concat(F.lit("Cluster "), F.col("label").cast("string"))).otherwise(fi.title_case(F.array_join(F.slice(F.split("keywords", ","), 1, 3), " "))))
    k = F.row_number().over(Window.partitionBy("base").orderBy("label"))
    return p.select("label", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), k.cast("string"), F.lit(")"))).alias("name"), (F.col("label") % 3).alias("parent"), F.round("confidence", 6).alias("confidence"), (F.col("spread") / 0.5 >= MIXED).alias("mixed"), (F.col("confidence") < SURE).alias("low_confidence"))


@query("parent_profiles", f"""WITH {_NAMED} SELECT parent, count(*) AS children, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (WHERE spread / 0.5 >= {MIXED}::DOUBLE) AS mixed, count(*) FILTER (WHERE confidence < {SURE}::DOUBLE) AS low_confidence, string_agg(base, ' / ' ORDER BY size DESC, label) AS names FROM nn GROUP BY parent""")
def _(spark, sf):
    p = profiles(spark, sf).withColumn("base", F.when(F.coalesce("keywords", F.lit("")) == "", F.concat(F.lit("Cluster "), F.col("label").cast("string"))).otherwise(fi.title_case(F.array_join(F.slice(F.split("keywords", ","), 1, 3), " "))))
    g = p.groupBy((F.col("label") % 3).alias("parent")).agg(F.count("*").alias("children"), F.sum("size").alias("size"), F.count_if(F.col("spread") / 0.5 >= MIXED).alias("mixed"), F.count_if(F.col("confidence") < SURE).alias("low_confidence"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "label", "base"))).alias("a"))
    return g.select("parent", "children", "size", "mixed", "low_confidence", F.array_join(F.transform("a", lambda x: x["base"]), " / ").alias("names"))


@query("outliers_first", "SELECT label, vec_id, round(prob, 6) AS prob FROM (SELECT label, vec_id, (vec_id * 37 % 101) / 100.0::DOUBLE AS prob, row_number() OVER (PARTITION BY label ORDER BY vec_id * 37 % 101, vec_id) AS n FROM embeddings) WHERE n <= 15")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") * 37 % 101 / 100.0).alias("prob"))
    n = F.row_number().over(Window.partitionBy("label").orderBy("prob", "vec_id"))
    return e.withColumn("n", n).where("n <= 15").select("label", "vec_id", F.round("prob", 6).alias("prob"))
