"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

The index holds the corpus's postings (term, doc_id, pos) as segments sorted by term: each input partition is a segment, so building it
shuffles nothing. A phrase is looked up from its rarest terms: their lists, moved by the terms' offsets, are intersected pair by pair;
what is left is compared with the words in place. For a stated set of tests, terms are counted over the whole corpus first, and only the
terms that some test is looked up from are posted; build_index without terms posts all.

Rows that share a doc_id are told apart by a 64-bit hash of their texts, and phrases by one of their words. In the index a null doc_id is 0, which makes
no difference to any row, since rows of one doc_id and one text have the same hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, read_table, small, stored

WINDOW = 10
#: Terms of a phrase whose lists are intersected before the words in place are compared.
RAREST = 2
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none of a null text. A gap at either end leaves no empty word."""
    parts = F.split(F.coalesce(ascii_lower(text), F.lit("")), _GAP)
    return F.filter(parts, lambda w: w != "")


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, words: each window of n consecutive words; an item of fewer words, but not none, is one window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n)))
    return w.select("item_id", "w", start.alias("s")).select("item_id", F.expr(f"slice(w, s + 1, {n})").alias("words")).distinct()


def _key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(0))


def build_index(docs: DataFrame, path: str, terms: DataFrame | None = None) -> DataFrame:
    """Writes the postings (term, doc_id, h, pos) of docs, of the given terms (term) alone where these are given, and reads them back. h, a
    hash of the text, tells rows that share a doc_id apart. Null texts have no postings; an empty table gives an empty index."""
    spark = docs.sparkSession
    rows = docs.select(_key().alias("doc_id"), F.xxhash64("text").alias("h"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        rows = rows.join(small(terms.distinct()), "term", "left_semi")
    rows.select("term", "doc_id", "h", "pos").sortWithinPartitions("term").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("term string, doc_id long, h long, pos int").parquet(path)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: how often each of terms (term) stands in all of docs; terms that docs lack are left out."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(small(terms.distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def rarest_terms(phrases: DataFrame, freq: DataFrame, k: int = RAREST) -> DataFrame:
    """phrases (p, words) with anchors: their k rarest (term, offset) by freq (term, df), rarest first. A phrase with a term that freq lacks can't
    occur and is left out."""
    at = phrases.select("p", "words", F.posexplode("words").alias("offset", "term"))
    known = at.join(freq, "term").groupBy("p").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("df", "offset", "term"))).alias("a"))
    return known.where("n = size(words)").select("p", "words", F.transform(F.slice("a", 1, k), lambda a: F.struct(a["term"].alias("term"), a["offset"].alias("offset"))).alias("anchors"))


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def phrase_matches(index: DataFrame, docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """doc_id, h, p, start, n: where each phrase stands in docs, exactly. anchored: rarest_terms of the phrases, stored, as it is read several
    times; the index has to hold its terms."""
    phrases = anchored.select("p", "words")
    longest, k = anchored.agg(F.coalesce(F.max(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("anchors")), F.lit(1))).first()
    spots = None
    for i in range(k):
        # phrases that share an anchor and its offset are looked up once each; a phrase of fewer terms has fewer lists
        a = anchored.where(F.size("anchors") > i).select("p", F.get("anchors", F.lit(i))["term"].alias("term"), F.get("anchors", F.lit(i))["offset"].alias("offset"))
        moved = index.join(small(a), "term").select("doc_id", "h", "p", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
        if spots is None:
            spots = moved
        else:
            both, short = spots.join(moved, ["doc_id", "h", "p", "start"], "left_semi"), anchored.where(F.size("anchors") <= i).select("p")
            # phrases without an i-th anchor pass
            spots = both if short.isEmpty() else both.unionByName(spots.join(small(short), "p", "left_semi"))
    # one row a document: the spots of its phrases are bounded by its own length
    by_doc = spots.groupBy("doc_id", "h").agg(F.collect_list(F.struct("p", "start")).alias("spots")).withColumnRenamed("doc_id", "d_").withColumnRenamed("h", "h_")
    texts = docs.select(_key().alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    cand = texts.join(by_doc, (F.col("doc_id") == F.col("d_")) & (F.col("h") == F.col("h_"))).select("doc_id", "h", words_of(F.col("text")).alias("w"), "spots")
    flat = cand.select("doc_id", "h", F.expr("inline(transform(spots, s -> named_struct('p', s.p, 'start', s.start, 'here', slice(w, s.start + 1, %d))))" % longest))
    return flat.join(small(phrases), "p").where("slice(here, 1, size(words)) = words").select("doc_id", "h", "p", "start", F.size("words").alias("n")).distinct()


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """doc_id, h, p, at: where all terms of a phrase stand within span words of its rarest term, in any order. Each occurrence of the
    rarest term is one row at most; other terms' postings are looked up in the same and the neighbouring stretches of span words."""
    first = stored(rarest_terms(phrases, frequencies(index), 1).select("p", F.get("anchors", F.lit(0))["term"].alias("term")), "anchors")
    centre = index.join(small(first), "term").select("doc_id", "h", "p", F.col("pos").alias("at"))
    near = centre.select("*", F.explode(F.array(*[F.floor(F.col("at") / span) + i for i in (-1, 0, 1)])).alias("cell"))
    need = phrases.select("p", F.explode(F.array_distinct("words")).alias("term"))
    there = index.join(small(need), "term").select("doc_id", "h", "p", "term", "pos", F.floor(F.col("pos") / span).alias("cell"))
    hits = near.join(there, ["doc_id", "h", "p", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
    full = phrases.select("p", F.size(F.array_distinct("words")).alias("want"))
    return hits.groupBy("doc_id", "h", "p", "at").agg(F.count_distinct("term").alias("got")).join(full, "p").where("got = want").select("doc_id", "h", "p", "at")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text).

    Null texts have no words; items without words or item_id have no windows. Rows that share a doc_id are told apart by their texts, and rows that are equal
    give equal rows. A null doc_id is a document like others. Empty tables give no rows, or rows without hits.
    """
    return _marked(docs, benchmark, window).drop("h")


def _marked(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """contamination with h, the hash of the row's text."""
    spark = docs.sparkSession
    wins = windows_of(benchmark, window)
    # windows of several items are searched once
    found = wins.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("p", F.xxhash64(F.array_join("words", " ")))
    path = new_path(spark, "phrases")
    found.write.parquet(path)
    found = spark.read.schema("words array<string>, items array<string>, p long").parquet(path)
    counts = stored(term_counts(docs, found.select(F.explode("words").alias("term"))), "counts")
    anchored = stored(rarest_terms(found.select("p", "words"), counts), "anchors")
    index = build_index(docs, new_path(spark, "postings"), anchored.select(F.explode("anchors.term").alias("term")))
    hits = phrase_matches(index, docs, anchored)
    # a document's hits and items are bounded by its own length and by the benchmark
    per = hits.join(small(found.select("p", "items")), "p").groupBy("doc_id", "h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.expr("start + n - 1")))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).withColumnsRenamed({"doc_id": "d_", "h": "h_"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), _count(F.col("text")).alias("n_words"))
    joined = rows.join(per, (_key() == F.col("d_")) & (F.col("h") == F.col("h_")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "h", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _count(text: Column) -> Column:
    """Words of a text, counted without a change of case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")
    return F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; columns stay. Of rows that share a doc_id all go when one's text is contaminated; of those without a doc_id
    the ones with a contaminated text."""
    row = lambda doc_id, h: F.coalesce(doc_id.cast("long").cast("string"), F.concat(F.lit("text "), h.cast("string")))
    bad = _marked(docs, benchmark, window).where("contaminated").select(row(F.col("doc_id"), F.col("h")).alias("_bad_row")).distinct()
    return docs.join(bad, row(docs["doc_id"], F.xxhash64(docs["text"])) == bad["_bad_row"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document: contamination."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
_SPLIT = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = {
    "op10_decontaminate": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS s, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
dw AS (SELECT doc_id, s, i, array_to_string(list_slice(ws, i, i + s - 1), ' ') AS k FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM bw) WHERE len(ws) >= s)),
m AS (SELECT doc_id, s, i, item FROM dw JOIN bw USING (s, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
