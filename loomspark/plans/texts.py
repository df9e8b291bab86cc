"""Text rules: classification, extraction, chunking, line statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import fixtures as fx
from .registry import query

FT = fx.FULLTEXT

@query("years_extract", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b((?:19|20)[0-9]{2})\\b', 1))), ',') AS years FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(tx.years(F.col("text")).cast("array<string>"), ",").alias("years"))


@query("chunk_fixed_window", """SELECT doc_id, i // 700 AS chunk_index, substring(text, i + 1, 800) AS chunk, round(100.0::DOUBLE * (i // 700) / greatest(greatest(length(text) - 1, 0) // 700, 1), 6) AS location_percent FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 700)) AS i FROM documents)""")
def _(spark, sf):
    return tx.fixed_windows(fx.table(spark, sf, "documents"))


@query("chunk_recursive")
def _(spark, sf):
    return tx.recursive_chunks(fx.table(spark, sf, "documents"))


@query("header_footer_lines", """SELECT source, line, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, source, unnest([list_extract(l, 1), list_extract(l, -1)]) AS line FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)) WHERE line IS NOT NULL GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3""")
def _(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    ends = F.array(F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1))
    d = fx.table(spark, sf, "documents").select("doc_id", "source", F.explode(ends).alias("line")).where("line is not null")
    return d.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("n")).where("n >= 3")


@query("highlight_terms")
def _(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.where(F.lower("text").rlike("license|version")).select("doc_id", tx.highlighted(F.col("text"), ["license", "version"]).alias("fragment"))


@query("page_cleanup")
def _(spark, sf):
    from ..functions.pages import with_clean_pages

    # a conversation's turns are its pages, each with the same head and a number at its foot
    page = F.concat(F.lit("Conversation record\n"), F.coalesce("text", F.lit("")), F.lit("\n\nPage "), F.col("turn").cast("string"))
    c = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))).alias("a"))
    return with_clean_pages(c.select("conv_id", F.transform("a", lambda x: x["p"]).alias("pages")), "conv_id").select("conv_id", F.array_join("pages", "\n\n").alias("text"))
