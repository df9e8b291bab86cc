"""Evaluation of retrieval: expected and supporting documents, rates, residual buckets, wrong winners, likeness of answers, gates and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieve as r
from ..operators import search as s
from ..operators import text_scan as ts
from ..sources import fixtures as fx
from . import endtoend as e2e
from .endtoend import RETRIEVED, TOK, arr
from .registry import query
from .retrieval import FUSED, _hits

CONTROL = fx.LEAD_INS.index("bitcoin price today ")
_MODE = f"CASE WHEN item_id % {len(fx.LEAD_INS)} = {CONTROL} THEN 'control' ELSE 'positive' END"


def items(spark, sf) -> DataFrame:
    mode = F.when(F.col("item_id") % len(fx.LEAD_INS) == CONTROL, "control").otherwise("positive")
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"), mode.alias("mode"))


def holders(spark, sf) -> DataFrame:
    """query_id, doc_id: the documents that hold a benchmark item's whole text."""
    return r.kept(ts.holding(fx.table(spark, sf, "documents"), items(spark, sf)))


def rows(spark, sf) -> DataFrame:
    """A row a question: mode, expected document (the least that holds the item), its rank, the first rank of any supporting document, the first hit's document, the expected's rank among all candidates, and the residual bucket."""
    support = holders(spark, sf)
    expected = support.groupBy("query_id").agg(F.min("doc_id").alias("expected"))
    doc_id = F.expr(f"id div {e2e.STRIDE}").alias("doc_id")
    got = e2e.retrieved(spark, sf).select("query_id", doc_id, "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("modified_s"), "id"))
    pool = e2e.found(spark, sf).select("query_id", doc_id, place.alias("place"))
    per = got.join(support.withColumn("s", F.lit(1)), ["query_id", "doc_id"], "left").join(expected, "query_id", "left")
    per = per.groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("expected"), F.col("rank"))).alias("rank"), F.min(F.when(F.col("s") == 1, F.col("rank"))).alias("support_rank"), F.min(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("top1"))
    near = pool.join(expected, "query_id").where("doc_id = expected").groupBy("query_id").agg(F.min("place").cast("long").alias("pool_rank"))
    x = items(spark, sf).select("query_id", "mode").join(expected, "query_id", "left").join(per, "query_id", "left").join(near, "query_id", "left")
    bucket = F.when(F.col("support_rank") == 1, "hit").when(F.col("support_rank") <= 3, "top3_not_top1").when(F.col("pool_rank") <= 3, "ambiguous").when(F.col("pool_rank").isNotNull(), "retrieved_below_top3").when(F.col("expected").isNull(), "corpus_absence").otherwise("not_retrieved_text_available")
    return x.withColumn("bucket", bucket)


ROWS = f"""{RETRIEVED}, sup AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), ex AS (SELECT query_id, min(doc_id) AS expected FROM sup GROUP BY query_id),
got AS (SELECT query_id, id // {e2e.STRIDE} AS doc_id, rank FROM o4 WHERE query_id NOT IN (SELECT query_id FROM gone)),
per AS (SELECT g.query_id, min(rank) FILTER (WHERE g.doc_id = expected) AS rank, min(rank) FILTER (WHERE s.doc_id IS NOT NULL) AS support_rank, min(g.doc_id) FILTER (WHERE rank = 1) AS top1 FROM got g LEFT JOIN sup s ON s.query_id = g.query_id AND s.doc_id = g.doc_id LEFT JOIN ex ON ex.query_id = g.query_id GROUP BY g.query_id),
pool AS (SELECT query_id, min(place) AS pool_rank FROM (SELECT query_id, id // {e2e.STRIDE} AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, modified_s DESC, id) AS place FROM h1) JOIN ex USING (query_id) WHERE doc_id = expected GROUP BY query_id),
ev AS (SELECT b.item_id AS query_id, {_MODE} AS mode, expected, rank, support_rank, top1, pool_rank, CASE WHEN support_rank = 1 THEN 'hit' WHEN support_rank <= 3 THEN 'top3_not_top1' WHEN pool_rank <= 3 THEN 'ambiguous' WHEN pool_rank IS NOT NULL THEN 'retrieved_below_top3' WHEN expected IS NULL THEN 'corpus_absence' ELSE 'not_retrieved_text_available' END AS bucket
 FROM benchmark b LEFT JOIN ex ON ex.query_id = b.item_id LEFT JOIN per ON per.query_id = b.item_id LEFT JOIN pool ON pool.query_id = b.item_id)"""


@query("eval_rows", f"{ROWS} SELECT * FROM ev")
def _(spark, sf):
    return rows(spark, sf).select("query_id", "mode", "expected", "rank", "support_rank", "top1", "pool_rank", "bucket")


_RATE = "round(count(*) FILTER (WHERE {0}) / count(*)::DOUBLE, 4)"


@query("eval_summary", f"""{ROWS} SELECT mode, count(*) AS total, {_RATE.format('rank <= 1')} AS hit1_rate, {_RATE.format('rank <= 3')} AS hit3_rate, {_RATE.format('support_rank <= 1')} AS support1_rate, {_RATE.format('support_rank <= 3')} AS support3_rate, count(*) FILTER (WHERE top1 IS NOT NULL) AS with_results,
 round(avg(coalesce(1.0::DOUBLE / support_rank, 0)), 4) AS mrr FROM ev GROUP BY mode""")
def _(spark, sf):
    rate = lambda c, k: F.round(F.count_if(F.col(c) <= k) / F.count("*"), 4)
    return rows(spark, sf).groupBy("mode").agg(
        F.count("*").alias("total"), rate("rank", 1).alias("hit1_rate"), rate("rank", 3).alias("hit3_rate"), rate("support_rank", 1).alias("support1_rate"), rate("support_rank", 3).alias("support3_rate"),
        F.count("top1").alias("with_results"), F.round(F.avg(F.coalesce(1.0 / F.col("support_rank"), F.lit(0.0))), 4).alias("mrr"),
    )


@query("residual_split", f"{ROWS} SELECT bucket, count(*) AS n, count(*) = max(count(*)) OVER () AS largest FROM ev WHERE bucket <> 'hit' GROUP BY bucket")
def _(spark, sf):
    n = rows(spark, sf).where("bucket <> 'hit'").groupBy("bucket").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("m")))).select("bucket", "n", (F.col("n") == F.col("m")).alias("largest"))


_FAMILY = "list_filter(regexp_split_to_array(lower(regexp_replace(filename, '\\.[^.]*$', '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains(" + arr(r.GENERIC_TITLE) + ", w))"


def family_key(name):
    """Up to four words of a title that tell documents of one kind; the whole title where it has none."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    words = F.filter(F.split(stem, "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(*r.GENERIC_TITLE))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 4), "_")).otherwise(F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", ""))


@query("wrong_winners", f"""{ROWS}, w AS (SELECT top1, CASE WHEN len(f) > 0 THEN array_to_string(f[1:4], '_') ELSE regexp_replace(regexp_replace(lower(regexp_replace(filename, '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS family FROM (SELECT top1, filename, {_FAMILY} AS f FROM ev JOIN {fx.CATALOG} ON doc_id = top1 WHERE bucket <> 'hit'))
 SELECT 'document' AS kind, CAST(top1 AS VARCHAR) AS name, count(*) AS n, count(*) >= 2 AS repeated FROM w GROUP BY top1 UNION ALL SELECT 'family', family, count(*), count(*) >= 2 FROM w GROUP BY family""")
def _(spark, sf):
    w = s.small(r.kept(rows(spark, sf).where("bucket <> 'hit' and top1 is not null"))).join(fx.catalog(spark, sf).select(F.col("doc_id").alias("top1"), "filename"), "top1")
    each = F.explode(F.array(F.struct(F.lit("document").alias("kind"), F.col("top1").cast("string").alias("name")), F.struct(F.lit("family").alias("kind"), family_key(F.col("filename")).alias("name"))))
    return w.select(each.alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n")).withColumn("repeated", F.col("n") >= 2)


@query("support_expectations", """WITH h AS (SELECT b.item_id AS query_id, list_sort(list(d.doc_id)) AS strict FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)
 SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'merge' ELSE 'replace' END AS mode, array_to_string(CASE query_id % 3 WHEN 0 THEN strict WHEN 1 THEN list_concat(strict, list_filter([query_id, query_id + 1], lambda x: NOT list_contains(strict, x))) ELSE [query_id, query_id + 1] END, ',') AS support, CASE WHEN query_id % 6 = 1 THEN query_id + 1 ELSE strict[1] END AS preferred FROM h""")
def _(spark, sf):
    # labels of two kinds go over the fixture's documents: some are merged, some replace them
    h = holders(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("strict"))
    k, extra = F.col("query_id"), F.array(F.col("query_id"), F.col("query_id") + 1)
    mode = F.when(k % 3 == 0, "none").when(k % 3 == 1, "merge").otherwise("replace")
    support = F.when(k % 3 == 0, F.col("strict")).when(k % 3 == 1, F.concat("strict", F.array_except(extra, "strict"))).otherwise(extra)
    return h.select("query_id", mode.alias("mode"), F.array_join(support.cast("array<string>"), ",").alias("support"), F.when(k % 6 == 1, k + 1).otherwise(F.get("strict", F.lit(0))).alias("preferred"))


# --- likeness ---

# Words that anchor nothing.
COMMON = ("a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "the", "to", "was", "what", "when", "where", "which", "who", "with", "you")
SEGMENTS, SLICE = 80, 8000


def sampled(text, n: int):
    """A long text's start and end."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n // 2), F.lit("\n...\n"), F.right(text, F.lit(n // 2))))


def _sample(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substring({x}, 1, {n // 2}) || chr(10) || '...' || chr(10) || right({x}, {n // 2}) END"


_ANCHORS = f"list_filter(list_distinct({TOK.format('needle')}), lambda x: length(x) >= 3 AND NOT list_contains({arr(COMMON)}, x))"


@query("anchor_slices", f"""WITH h AS (SELECT b.item_id AS query_id, b.text AS needle, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id, b.text), a AS (SELECT query_id, {_ANCHORS} AS anchors, list_slice(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '' AND list_has_any({TOK.format('x')}, {_ANCHORS})), 1, {SEGMENTS}) AS segments FROM h JOIN documents USING (doc_id))
 SELECT query_id, len(segments) AS n, round(len(list_filter(anchors, lambda t: list_contains({TOK.format("array_to_string(segments, ' ')")}, t))) / len(anchors)::DOUBLE, 4) AS coverage, sha256({_sample("array_to_string(segments, ' ')", SLICE)}) AS slice FROM a WHERE len(anchors) > 0""")
def _(spark, sf):
    h = s.small(holders(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).join(items(spark, sf), "query_id")).join(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    anchors = F.filter(F.array_distinct(s.tokens(F.col("needle"))), lambda x: (F.length(x) >= 3) & ~x.isin(*COMMON))
    h = h.withColumn("anchors", anchors).where("size(anchors) > 0")
    parts = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: (x != "") & F.arrays_overlap(s.tokens(x), F.col("anchors")))
    h = h.withColumn("segments", F.slice(parts, 1, SEGMENTS)).withColumn("joined", F.array_join("segments", " "))
    covered = F.size(F.array_intersect("anchors", s.tokens(F.col("joined"))))
    return h.select("query_id", F.size("segments").cast("long").alias("n"), F.round(covered / F.size("anchors"), 4).alias("coverage"), F.sha2(sampled(F.col("joined"), SLICE), 256).alias("slice"))


def _pairs(spark, sf) -> DataFrame:
    """A question's expected document and first hit with their whole texts. Keys may be sent to all tasks; texts are shuffled, those of the pairs alone."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    p = r.kept(rows(spark, sf).where("expected is not null and top1 is not null").select("query_id", "expected", "top1", "rank"))
    text = lambda key, name: s.small(p.select("query_id", F.col(key).alias("doc_id"))).join(d, "doc_id").select("query_id", F.col("text").alias(name))
    return p.join(text("expected", "a"), "query_id").join(text("top1", "b"), "query_id")


def _likeness(p: DataFrame) -> DataFrame:
    x, y = F.array_distinct(s.tokens(F.col("a"))), F.array_distinct(s.tokens(F.col("b")))
    both = F.size(F.array_intersect(x, y))
    return p.withColumn("jaccard", F.round(F.coalesce(F.try_divide(both, F.size(F.array_union(x, y))), F.lit(0.0)), 4)).withColumn("containment", F.round(F.coalesce(F.try_divide(both, F.least(F.size(x), F.size(y))), F.lit(0.0)), 4))


_XY = f"list_distinct({TOK.format('x.text')}) AS s1, list_distinct({TOK.format('y.text')}) AS s2"


@query("near_duplicate_text", f"""{ROWS}, p AS (SELECT query_id, expected, top1, {_XY} FROM ev JOIN documents x ON x.doc_id = expected JOIN documents y ON y.doc_id = top1) SELECT query_id, expected, top1, round(len(list_intersect(s1, s2)) / (len(s1) + len(s2) - len(list_intersect(s1, s2)))::DOUBLE, 4) AS jaccard, round(len(list_intersect(s1, s2)) / least(len(s1), len(s2))::DOUBLE, 4) AS containment FROM p""")
def _(spark, sf):
    return _likeness(_pairs(spark, sf)).select("query_id", "expected", "top1", "jaccard", "containment")


@query("answer_similarity")
def _(spark, sf):
    # the sequence ratio has no SQL: the pairs are few, one a question, but a long one takes long, so they go to tasks by their number and not their size
    def ratios(frames):  # noqa: ANN001, ANN202
        from difflib import SequenceMatcher

        for f in frames:
            r = [0.0 if not x or not y else 1.0 if x == y else round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(f["a"], f["b"], strict=True)]
            yield f.drop(columns=["a", "b"]).assign(ratio=r)

    p = _likeness(_pairs(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "query_id")).select("query_id", "expected", "top1", "rank", "jaccard", "containment", "a", "b").mapInPandas(ratios, "query_id long, expected long, top1 long, rank long, jaccard double, containment double, ratio double")
    same = (F.col("containment") >= 0.95) | (F.col("ratio") >= 0.95) | ((F.col("containment") >= 0.90) & (F.col("jaccard") >= 0.85) & (F.col("ratio") >= 0.85))
    equal = same | ((F.col("containment") >= 0.82) & (F.col("ratio") >= 0.72)) | ((F.col("containment") >= 0.75) & (F.col("jaccard") >= 0.50) & (F.col("ratio") >= 0.65))
    likely = F.when(same, "likely_correct").when(F.col("rank") <= 3, "possibly_correct_top3").when((F.col("rank") <= 10) & (F.col("containment") >= 0.80), "possibly_correct_similar").otherwise("unlikely_or_unknown")
    return p.select("query_id", "expected", "top1", "jaccard", "containment", "ratio", same.alias("near_duplicate"), equal.alias("equivalent"), likely.alias("likelihood"))


# --- gates, runs, timings on the fixed hits ---

_FIVE = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_vector DESC, id) AS n FROM {0})"
_GATED = f"(SELECT * FROM {FUSED} WHERE doc_type <> 'other')"
_SUM = "SELECT count(DISTINCT query_id) FILTER (WHERE doc_type = 'other') AS with_suppressed, count(*) FILTER (WHERE doc_type = 'other') AS suppressed, avg(CAST(doc_type = 'invoice' AS INT)) AS preferred, count(*) FILTER (WHERE generic_title) AS leaked FROM {0} WHERE n <= 5"


@query("finance_gate_verdict", f"""WITH b AS ({_SUM.format(_FIVE.format(FUSED))}), g AS ({_SUM.format(_FIVE.format(_GATED))}) SELECT g.with_suppressed = 0 AS removed, g.suppressed < b.suppressed AS reduced, g.preferred > b.preferred AS preferred_more, g.leaked <= b.leaked AS leakage_not_worse, g.suppressed - b.suppressed AS suppressed_delta, round(g.preferred - b.preferred, 6) AS preferred_delta,
 g.with_suppressed = 0 AND g.suppressed < b.suppressed AND g.preferred > b.preferred AND g.leaked <= b.leaked AS passes FROM b, g""")
def _(spark, sf):
    def run(h: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_vector"), "id"))
        other = F.col("doc_type") == "other"
        return h.withColumn("n", n).where("n <= 5").agg(F.count_distinct(F.when(other, F.col("query_id"))).alias(f"{name}_with"), F.count_if(other).alias(f"{name}_suppressed"), F.avg((F.col("doc_type") == "invoice").cast("int")).alias(f"{name}_preferred"), F.count_if("generic_title").alias(f"{name}_leaked"))

    h = _hits(spark, sf)
    x = run(h, "b").crossJoin(run(h.where("doc_type <> 'other'"), "g"))
    checks = {"removed": "g_with = 0", "reduced": "g_suppressed < b_suppressed", "preferred_more": "g_preferred > b_preferred", "leakage_not_worse": "g_leaked <= b_leaked"}
    return x.select(*[F.expr(e).alias(n) for n, e in checks.items()], F.expr("g_suppressed - b_suppressed").alias("suppressed_delta"), F.round(F.expr("g_preferred - b_preferred"), 6).alias("preferred_delta"), F.expr(" and ".join(checks.values())).alias("passes"))


@query("run_change_lists", f"""WITH a AS (SELECT query_id, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM {FUSED}) WHERE title_overlap = 3 GROUP BY query_id), b AS (SELECT query_id, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_bm25 DESC, id) AS r FROM {FUSED}) WHERE title_overlap = 3 AND query_id % 7 <> 0 GROUP BY query_id),
 c AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.r <= 3, false) AS off_, coalesce(b.r <= 3, false) AS on_ FROM a FULL JOIN b ON a.query_id = b.query_id) SELECT CASE WHEN on_ AND NOT off_ THEN 'improved' WHEN off_ AND NOT on_ THEN 'regressed' WHEN off_ THEN 'kept' ELSE 'missed' END AS change, count(*) AS n, string_agg(query_id, ',' ORDER BY query_id) AS queries FROM c GROUP BY 1""")
def _(spark, sf):
    def run(order: str, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "id"))
        return _hits(spark, sf).withColumn("r", n).where("title_overlap = 3").groupBy("query_id").agg((F.min("r") <= 3).alias(name))

    c = run("score", "off").join(run("score_bm25", "on").where("query_id % 7 <> 0"), "query_id", "full_outer").fillna(False, ["off", "on"])
    change = F.when(F.col("on") & ~F.col("off"), "improved").when(F.col("off") & ~F.col("on"), "regressed").when(F.col("off"), "kept").otherwise("missed")
    return c.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("query_id")).cast("array<string>"), ",").alias("queries"))


@query("stage_timing_dominant", "SELECT event_type AS stage, round(total, 4) AS total, total = max(total) OVER () AS dominant FROM (SELECT event_type, sum(value) AS total FROM events GROUP BY event_type)")
def _(spark, sf):
    t = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("total"))
    return t.crossJoin(F.broadcast(t.agg(F.max("total").alias("m")))).select("stage", F.round("total", 4).alias("total"), (F.col("total") == F.col("m")).alias("dominant"))


@query("request_metrics", "SELECT count(*) AS requests, round(sum(value), 4) AS total_s, round(avg(value), 6) AS avg_s, max(value) AS max_s, count(*) - count(DISTINCT props) AS cache_hits FROM events WHERE event_type IN ('view', 'click')")
def _(spark, sf):
    e = fx.table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total_s"), F.round(F.avg("value"), 6).alias("avg_s"), F.max("value").alias("max_s"), (F.count("*") - F.count_distinct("props")).alias("cache_hits"))


@query("document_indicators", f"""SELECT doc_id, length(text) = 0 AS empty_text, length(text) BETWEEN 1 AND 199 AS very_low_text, v.vec_id IS NULL AS missing_vectors, (1 + greatest(length(text) - 1, 0) // 700) AS chunks FROM documents LEFT JOIN embeddings v ON vec_id = doc_id WHERE text IS NOT NULL""")
def _(spark, sf):
    n = F.length("text")
    d = fx.table(spark, sf, "documents").where("text is not null").join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")), "doc_id", "left")
    return d.select("doc_id", (n == 0).alias("empty_text"), n.between(1, 199).alias("very_low_text"), F.col("has").isNull().alias("missing_vectors"), F.expr("1 + greatest(length(text) - 1, 0) div 700").alias("chunks"))
