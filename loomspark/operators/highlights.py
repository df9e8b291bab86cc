"""Fragments of texts that show why they were found: sentences cut to a size, the best by a question's words, escaped and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a fragment, and fragments of a text.
SIZE, MOST = 200, 3
#: A sentence with what ends it; and the words of a fragment apart from what stands between them.
SENTENCE, PIECE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", r"[A-Za-z0-9]+|[^A-Za-z0-9]+"
#: What is written for characters that mean something in HTML. The first is replaced first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def fragments(text: Column) -> Column:
    """The text's sentences, each cut after every SIZE characters, without white space at their ends and without empty ones."""
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), 0)
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / SIZE).cast("int")), lambda i: F.trim(F.regexp_replace(F.substring(s, i * SIZE + 1, SIZE), r"\s", " ")))))
    return F.filter(cut, lambda x: x != "")


def escaped(text: Column) -> Column:
    for character, name in ESCAPES:
        text = F.replace(text, F.lit(character), F.lit(name))
    return text


def marked(fragment: Column, terms: Column) -> Column:
    """The fragment with its words that are terms between marks. Words hold no character that is escaped, so escaping moves no mark."""
    pieces = F.regexp_extract_all(fragment, F.lit(PIECE), 0)
    return F.array_join(F.transform(pieces, lambda x: F.when(F.array_contains(terms, F.lower(x)), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(escaped(x))), "")


def highlighted(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, fragments of hits (query_id, doc_id): of each text (docs: doc_id, text) the MOST best fragments for the question's terms (queries: query_id,
    terms), by how many distinct terms a fragment has, then by all its occurrences, then by place. A text without any has its first SIZE characters; a null or
    empty text has none."""
    h = hits.select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "terms"), "query_id")

    def weighed(x: Column, i: Column) -> Column:
        words = F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), 0), lambda w: F.lower(w))
        found = F.filter(words, lambda w: F.array_contains("terms", w))
        return F.struct((-F.size(F.array_distinct(found))).alias("distinct"), (-F.size(found)).alias("all_"), i.alias("i"), x.alias("x"))

    best = F.slice(F.array_sort(F.filter(F.transform(fragments(F.col("text")), weighed), lambda f: f["distinct"] < 0)), 1, MOST)
    lead = escaped(F.trim(F.regexp_replace(F.substring("text", 1, SIZE), r"\s", " ")))
    h = h.select("query_id", "doc_id", "terms", best.alias("best"), lead.alias("lead"))
    shown = F.when(F.size("best") > 0, F.transform("best", lambda f: marked(f["x"], F.col("terms")))).when(F.col("lead") != "", F.array("lead")).otherwise(F.array().cast("array<string>"))
    return h.select("query_id", "doc_id", shown.alias("fragments"))
