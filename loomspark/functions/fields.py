"""Small rules on names, paths, sizes, times and answers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
NAME_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with")
HASH_LIKE = "^[a-z0-9]{21,}$"
GERMAN = ("als", "aber", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "da", "das", "dass", "dem", "den", "der", "des", "die", "doch", "ein", "eine", "einem", "einen", "einer", "für", "hat", "im", "in", "ins", "ist", "mit", "nach", "nicht", "noch", "nur", "oder", "sich", "sein", "sind", "und", "von", "vom")
NO_ANSWER = ("", "i don't know.", "no relevant context found to answer the question.", "❌ retrieval failed.", "❌ llm call failed.")
SCORE_BUCKETS = ((0.75, "strong"), (0.45, "medium"), (0.15, "light"))
EMAIL, LONG_NUMBER, LONG_TOKEN = r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", r"\b\d{6,}\b", r"\b[A-Za-z0-9_-]{24,}\b"
GENERIC_NAME = r"^(misc|other|documents|files|review)(\b|\s|-)"
REVIEW_REASONS = ("llm_timeout", "llm_invalid_json", "llm_unreachable", "llm_model_not_loaded", "cache_hit_baseline")


def file_size(n: Column) -> Column:
    """Bytes as people write them; null is 0 B."""
    size = F.coalesce(n.cast("double"), F.lit(0.0))
    out = F.concat(F.bround(size / 1024 ** (len(UNITS) - 1), 1).cast("string"), F.lit(f" {UNITS[-1]}"))
    for i in range(len(UNITS) - 2, 0, -1):
        out = F.when(size < 1024 ** (i + 1), F.concat(F.bround(size / 1024**i, 1).cast("string"), F.lit(f" {UNITS[i]}"))).otherwise(out)
    return F.when(size < 1024, F.concat(F.floor(size).cast("string"), F.lit(" B"))).otherwise(out)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)


def name_tokens(name: Column) -> Column:
    """Words of a file's or folder's name without its extension; stop words, numbers and hashes are left out."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.filter(F.split(F.lower(stem), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*NAME_STOPWORDS) & ~w.rlike("^[0-9]+$") & ~w.rlike(HASH_LIKE))


def path_segments(path: Column, root: str, depth: int) -> Column:
    """Words of the last depth parts of a path below root."""
    below = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)
    parts = F.filter(F.split(below, "/"), lambda x: x != "")
    return F.flatten(F.transform(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), F.lit(depth)), name_tokens))


def scrubbed(text: Column) -> Column:
    """Without mail addresses, long numbers and long tokens; white space folded."""
    t = text
    for p in (EMAIL, LONG_NUMBER, LONG_TOKEN):
        t = F.regexp_replace(t, p, " ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


def snippets(text: Column) -> Column:
    """A text's lines; of a text of one line, its sentences."""
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    full = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    lines = full(F.split(text, "\n"))
    return F.when(F.size(lines) > 1, lines).otherwise(full(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\x0B\f\r]+", "$1\n"), "\n")))


def alias_rows(lines: DataFrame) -> DataFrame:
    """target, keyword, weight of lines (n, line) such as 'Taxes|tax:2,invoice'. Comments, lines without a bar, a target or keywords say nothing; a weight that is no number is 1; a later line of a target takes
    the earlier one's place, and so does a later mention of a keyword."""
    line = F.trim("line")
    rows = lines.where((line != "") & ~line.startswith("#") & line.contains("|")).select("n", F.lower(F.trim(F.split_part(line, F.lit("|"), F.lit(1)))).alias("target"), F.expr("substring(trim(line), locate('|', trim(line)) + 1)").alias("rest")).where("target <> ''")
    kw = rows.select("n", "target", F.posexplode(F.transform(F.split("rest", ","), lambda x: F.lower(F.trim(x)))).alias("i", "item")).where("item <> ''")
    has = F.col("item").contains(":")
    kw = kw.select("n", "i", "target", F.when(has, F.trim(F.split_part("item", F.lit(":"), F.lit(1)))).otherwise(F.col("item")).alias("keyword"), F.when(has, F.coalesce(F.expr("try_cast(trim(substring(item, locate(':', item) + 1)) as double)"), F.lit(1.0))).otherwise(F.lit(1.0)).alias("weight"))
    last = kw.groupBy("target").agg(F.max("n").alias("last"))
    return kw.join(last, "target").where("n = last").groupBy("target", "keyword").agg(F.max_by("weight", "i").alias("weight"))


def keyword_score(tokens: Column, keywords: Column) -> Column:
    """The share of the weights of keywords (array of struct(keyword, weight)) that tokens have; 0 without weights."""
    total = F.aggregate(keywords, F.lit(0.0), lambda a, k: a + k["weight"])
    hits = F.aggregate(keywords, F.lit(0.0), lambda a, k: a + F.when(F.array_contains(tokens, k["keyword"]), k["weight"]).otherwise(0.0))
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def label_match(answer: Column, labels: tuple[str, ...]) -> Column:
    """The label that an answer is, without regard to case and quotes; else the first one in it; else empty."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.trim(answer), '^"+|"+$', ""), "^'+|'+$", ""))
    exact, within = [F.when(clean == x.lower(), F.lit(x)) for x in labels], [F.when(clean.contains(x.lower()), F.lit(x)) for x in labels]
    return F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(F.coalesce(*exact, *within, F.lit("")))


def reason_value(reason: Column, key: str) -> Column:
    """The number that a reason such as 'meta=0.61; keywords=0.5' gives a key; null without one."""
    return F.regexp_extract(reason, rf"(?:^|;)\s*{key}\s*=\s*([^;]*?)\s*(?:;|$)", 1).try_cast("double")


def score_bucket(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= v, F.lit(n)) for v, n in SCORE_BUCKETS], F.lit("none"))


def mapped_paths(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, mapped: the longest source prefix (pairs: source, target) of a path, without regard to case, gives way to its target. Pairs are settings, a few rows."""
    p = paths.select("path", F.regexp_replace("path", r"\\", "/").alias("_p"))
    clean = pairs.select(F.lower(F.regexp_replace("source", r"[/\\]+$", "")).alias("_s"), F.regexp_replace("target", r"[/\\]+$", "").alias("_t"))
    hit = p.join(F.broadcast(clean), F.startswith(F.lower("_p"), F.col("_s")), "left").groupBy("path", "_p").agg(F.max_by(F.struct("_s", "_t"), F.length("_s")).alias("b"))
    return hit.select("path", F.when(F.col("b._s").isNotNull(), F.concat("b._t", F.substr("_p", F.length("b._s") + 1))).otherwise(F.col("_p")).alias("mapped"))


def answer_status(answer: Column) -> Column:
    a = F.trim(F.coalesce(answer, F.lit("")))
    low = F.lower(a)
    return F.when(low.isin(*NO_ANSWER) | low.startswith("**clarify**"), "fallback").when(a.startswith("[LLM Error:") | a.startswith("❌"), "error").otherwise("answer")


def epoch_text(value: Column) -> Column:
    """Seconds or milliseconds since 1970 as UTC; values above a trillion are milliseconds. 0 and null are empty."""
    s = F.when(value > 10**12, value / 1000.0).otherwise(value.cast("double"))
    return F.when(value.isNull() | (value == 0), "").otherwise(F.date_format(F.timestamp_seconds(F.floor(s)), "yyyy-MM-dd HH:mm:ss"))


def ampm(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd "), F.date_format(ts, "h:mm a"))


def title_case(text: Column) -> Column:
    """Each run of letters begins with a capital and goes on in small ones, whatever stands before it."""
    parts = F.split(text, "(?<=[^A-Za-z])|(?=[^A-Za-z])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def processed_name(name: Column, words: int = 6, chars: int = 60) -> Column:
    """A proposed name in title case, cut to some words and characters; Untitled where it says nothing."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    plain = F.lower(F.trim(F.regexp_replace(clean, "[^A-Za-z0-9]+", " ")))
    cut = F.rtrim(F.substring(title_case(F.array_join(F.slice(F.split(clean, " "), 1, words), " ")), 1, chars))
    return F.when((plain == "") | plain.isin("untitled", "misc", "miscellaneous"), "Untitled").otherwise(cut)


def is_english(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9 .,&()\-']+$") & ~F.arrays_overlap(F.split(F.lower(name), "[^a-z0-9]+"), F.array(*map(F.lit, GERMAN)))


def disambiguated(names: DataFrame) -> DataFrame:
    """n, name of rows (n, name, differentiator): the first of equal names stays; each later one takes, in brackets, the differentiator of the one before it, the first's for the second and so on, if no
    other has it; else a number."""
    w = Window.partitionBy("name").orderBy("n")
    diff = F.regexp_replace(F.trim("differentiator"), r"^\.(?=.)", "")
    d = F.when(F.coalesce(diff, F.lit("")) == "", None).otherwise(processed_name(diff))
    rows = names.withColumn("_k", F.row_number().over(w)).withColumn("_d", F.lag(F.when(d != "Untitled", d)).over(w))
    first = F.row_number().over(Window.partitionBy("name", "_d").orderBy("n")) == 1
    rows = rows.withColumn("_use", (F.col("_k") > 1) & F.col("_d").isNotNull() & first)
    count = F.count_if((F.col("_k") > 1) & ~F.col("_use")).over(w)
    return rows.select("n", F.when(F.col("_k") == 1, F.col("name")).when(F.col("_use"), F.concat("name", F.lit(" ("), "_d", F.lit(")"))).otherwise(F.concat("name", F.lit(" ("), (count + 1).cast("string"), F.lit(")"))).alias("name"))
