"""Queries of small rules: names, paths, sizes, times, settings, answers, reviews and sorting into folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as fi
from ..functions import rules as ru
from ..operators import search as s
from ..operators import tables as ops
from ..operators.quantiles import quantiles
from ..sources import fixtures as fx
from .documents import ascii_sql, q
from .endtoend import TOK, arr
from .registry import query
from .topics import CENTROIDS, V

PAPERS, FT, CATALOG = fx.PAPERS, fx.FULLTEXT, fx.CATALOG
SPACE = r"[ \t\n\x0B\f\r]"


@query("file_sizes", f"SELECT doc_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0::DOUBLE) ELSE printf('%.1f MB', size_bytes / 1048576.0::DOUBLE) END AS size FROM {FT}")
def _(spark, sf):
    return fx.fulltext(spark, sf).select("doc_id", fi.file_size(F.col("size_bytes")).alias("size"))


_NAME_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(map(q, fi.NAME_STOPWORDS)) + ") AND NOT regexp_matches(w, '^[0-9]+$') AND NOT regexp_matches(w, '^[a-z0-9]{{21,}}$'))"
ROOT, DEPTH = "/corpus", 3


@query("path_features", f"""SELECT doc_id, regexp_extract(path, '[^/]*$') AS filename, regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS ext, array_to_string({_NAME_TOKENS.format('path')}, ' ') AS tokens,
 array_to_string(flatten(list_transform(list_slice(parts, greatest(len(parts) - {DEPTH - 1}, 1), len(parts)), lambda p: {_NAME_TOKENS.format('p')})), ' ') AS segments
 FROM (SELECT *, list_filter(string_split(CASE WHEN starts_with(path, '{ROOT}/') THEN substring(path, {len(ROOT) + 2}) ELSE path END, '/'), lambda x: x <> '') AS parts FROM {PAPERS})""")
def _(spark, sf):
    p = F.col("path")
    return fx.papers(spark, sf).select("doc_id", ru.filename(p).alias("filename"), fi.extension(p).alias("ext"), F.array_join(fi.name_tokens(p), " ").alias("tokens"), F.array_join(fi.path_segments(p, ROOT, DEPTH), " ").alias("segments"))


_PLAIN = ascii_sql("coalesce(text, '')")
_SCRUB = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, {q(fi.EMAIL)}, ' ', 'g'), {q(fi.LONG_NUMBER)}, ' ', 'g'), {q(fi.LONG_TOKEN)}, ' ', 'g'), '{SPACE}+', ' ', 'g'))"


@query("scrub_text", f"SELECT doc_id, sha256({_SCRUB}) AS scrubbed, length({_SCRUB}) AS n FROM (SELECT doc_id, {_PLAIN} AS x FROM {PAPERS})")
def _(spark, sf):
    # letters beyond ASCII are written as z, for one kind of word boundary on any engine
    t = fi.scrubbed(ru.ascii_words(F.coalesce("text", F.lit(""))))
    return fx.papers(spark, sf).select("doc_id", F.sha2(t, 256).alias("scrubbed"), F.length(t).cast("long").alias("n"))


_STRIP = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$', '', 'g')), lambda x: x <> '')"
_LINES, _SENTENCES = _STRIP.format("string_split(text, chr(10))"), _STRIP.format(f"string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(10), 'g'), chr(10))")


@query("snippet_split", f"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, CASE WHEN len({_LINES}) > 1 THEN {_LINES} ELSE {_SENTENCES} END AS s FROM (SELECT doc_id, coalesce(text, '') AS text FROM {PAPERS}))")
def _(spark, sf):
    t = fi.snippets(F.coalesce("text", F.lit("")))
    return fx.papers(spark, sf).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, "\x01"), 256).alias("digest"))


# --- settings: targets with keywords, path prefixes ---

ALIASES = ("# folders", "Reports|report:2, overview , summary:1.5", "Contracts | contract:3,Invoice", "", "|nobody", "Empty| , ", "Persons|cv:x,course:0.5,cv:2", "Lists|list:1,file:1,inventory:2", "reports|report:1,paper:2,summary")
_ALIAS_ROWS = "(SELECT unnest(range(0, {})) AS n, unnest({}) AS line)".format(len(ALIASES), arr(ALIASES))
ALIAS_SQL = f"""(WITH l AS (SELECT n, trim(line) AS line FROM {_ALIAS_ROWS}), r AS (SELECT n, lower(trim(split_part(line, '|', 1))) AS target, substring(line, strpos(line, '|') + 1) AS rest FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '|')),
 k AS (SELECT n, target, unnest(string_split(rest, ',')) AS item, generate_subscripts(string_split(rest, ','), 1) AS i FROM r WHERE target <> ''), m AS (SELECT n, target, i, lower(trim(item)) AS item FROM k WHERE trim(item) <> ''),
 w AS (SELECT n, target, i, CASE WHEN contains(item, ':') THEN trim(split_part(item, ':', 1)) ELSE item END AS keyword, CASE WHEN contains(item, ':') THEN coalesce(TRY_CAST(trim(substring(item, strpos(item, ':') + 1)) AS DOUBLE), 1) ELSE 1 END AS weight FROM m)
 SELECT target, keyword, arg_max(weight, i)::DOUBLE AS weight FROM w WHERE n = (SELECT max(n) FROM w w2 WHERE w2.target = w.target) GROUP BY target, keyword)"""


def alias_table(spark) -> DataFrame:
    return fi.alias_rows(spark.createDataFrame(list(enumerate(ALIASES)), "n int, line string"))


@query("alias_map", f"SELECT * FROM {ALIAS_SQL}")
def _(spark, sf):
    return alias_table(spark)


@query("keyword_scores", f"""SELECT doc_id, target, round(coalesce(sum(weight) FILTER (WHERE list_contains({TOK.format('filename')}, keyword)), 0) / sum(weight), 6) AS score FROM {CATALOG}, {ALIAS_SQL} GROUP BY doc_id, target""")
def _(spark, sf):
    targets = alias_table(spark).groupBy("target").agg(F.collect_list(F.struct("keyword", "weight")).alias("k"))
    return fx.catalog(spark, sf).crossJoin(F.broadcast(targets)).select("doc_id", "target", F.round(fi.keyword_score(s.tokens(F.col("filename")), F.col("k")), 6).alias("score"))


PAIRS = (("C:/", "/host-c"), ("C:/Docs/Old/", "/old"), ("c:\\Docs", "/docs"), ("G:/", "/host-g"))
_PAIRS = "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in PAIRS) + ") p(source, target)"
_HOSTED = f"(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C:\\Docs\\Old\\' WHEN 1 THEN 'c:/docs/' WHEN 2 THEN 'G:\\' WHEN 3 THEN 'C:/x/' ELSE '/srv/' END || doc_id || '.txt' AS path FROM {FT})"


@query("host_paths", f"""SELECT path, coalesce(arg_max(t || substring(p2, length(s) + 1), length(s)), any_value(p2)) AS mapped FROM (SELECT path, replace(path, '\\', '/') AS p2 FROM {_HOSTED}) LEFT JOIN (SELECT lower(regexp_replace(source, '[/\\\\]+$', '')) AS s, target AS t FROM {_PAIRS}) ON starts_with(lower(p2), s) GROUP BY path""")
def _(spark, sf):
    d = F.col("doc_id")
    head = F.when(d % 5 == 0, "C:\\Docs\\Old\\").when(d % 5 == 1, "c:/docs/").when(d % 5 == 2, "G:\\").when(d % 5 == 3, "C:/x/").otherwise("/srv/")
    return fi.mapped_paths(fx.fulltext(spark, sf).select(F.concat(head, d.cast("string"), F.lit(".txt")).alias("path")), spark.createDataFrame(PAIRS, "source string, target string"))


# --- answers ---

LABELS = ("Report", "Invoice", "CV", "Course")
_REPLY = "CASE doc_id % 6 WHEN 0 THEN '\"report\"' WHEN 1 THEN 'The folder is invoice or CV' WHEN 2 THEN '''cv''' WHEN 3 THEN '' WHEN 4 THEN 'none' ELSE 'Course ' || doc_id END"
_CLEAN = "lower(trim(trim(trim(reply), '\"'), ''''))"


@query("label_match", f"SELECT doc_id, CASE WHEN reply = '' THEN '' {' '.join(f'WHEN c = {q(x.lower())} THEN {q(x)}' for x in LABELS)} {' '.join(f'WHEN contains(c, {q(x.lower())}) THEN {q(x)}' for x in LABELS)} ELSE '' END AS label FROM (SELECT doc_id, reply, {_CLEAN} AS c FROM (SELECT doc_id, {_REPLY} AS reply FROM {FT}))")
def _(spark, sf):
    d = F.col("doc_id")
    reply = F.when(d % 6 == 0, '"report"').when(d % 6 == 1, "The folder is invoice or CV").when(d % 6 == 2, "'cv'").when(d % 6 == 3, "").when(d % 6 == 4, "none").otherwise(F.concat(F.lit("Course "), d.cast("string")))
    return fx.fulltext(spark, sf).select("doc_id", fi.label_match(reply, LABELS).alias("label"))


_ANSWER = "CASE (conv_id + turn) % 6 WHEN 0 THEN '[LLM Error: timeout] ' || text WHEN 1 THEN ' I don''t know. ' WHEN 2 THEN '❌ Retrieval failed.' WHEN 3 THEN '**Clarify** ' || text WHEN 4 THEN '❌ ' || text ELSE text END"


@query("answer_status", f"""SELECT conv_id, turn, CASE WHEN lower(trim(a)) IN ({', '.join(map(q, fi.NO_ANSWER))}) OR starts_with(lower(trim(a)), '**clarify**') THEN 'fallback' WHEN starts_with(trim(a), '[LLM Error:') OR starts_with(trim(a), '❌') THEN 'error' ELSE 'answer' END AS status FROM (SELECT conv_id, turn, coalesce({_ANSWER}, '') AS a FROM conversations)""")
def _(spark, sf):
    k, t = (F.col("conv_id") + F.col("turn")) % 6, F.col("text")
    a = F.when(k == 0, F.concat(F.lit("[LLM Error: timeout] "), t)).when(k == 1, " I don't know. ").when(k == 2, "❌ Retrieval failed.").when(k == 3, F.concat(F.lit("**Clarify** "), t)).when(k == 4, F.concat(F.lit("❌ "), t)).otherwise(t)
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", fi.answer_status(a).alias("status"))


@query("json_salvage", """SELECT event_id, TRY_CAST(json_extract_string(regexp_extract('Sure: ' || props || ' done', '(?s)\\{.*\\}'), '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    found = F.regexp_extract(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")), r"(?s)\{.*\}", 0)
    return fx.table(spark, sf, "events").select("event_id", F.from_json(found, "k long")["k"].alias("k"))


# --- times ---

@query("time_formats", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, strftime(ts, '%Y-%m-%d ') || ltrim(strftime(ts, '%I:%M %p'), '0') AS ampm, strftime(ts, '%d %B %Y') AS day,
 CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS eta FROM events""")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    # a task's time comes as seconds, as milliseconds, or not at all
    value = F.when(F.col("event_id") % 7 == 0, F.lit(0)).when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)
    return fx.table(spark, sf, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("plain"), fi.ampm(ts).alias("ampm"), F.date_format(ts, "dd MMMM yyyy").alias("day"), fi.epoch_text(value).alias("eta"))


@query("task_rows", "SELECT event_id, event_type, substring(props, 1, 5) AS short, strftime(ts, '%Y-%m-%d %H:%M:%S') AS eta FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts, event_id LIMIT 200")
def _(spark, sf):
    e = fx.table(spark, sf, "events").where(F.col("event_type").isin("error", "signup")).orderBy("ts", "event_id").limit(200)
    return e.select("event_id", "event_type", F.substring("props", 1, 5).alias("short"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("eta"))


# --- names ---

_N = "CASE vec_id % 8 WHEN 0 THEN 'tax  papers' WHEN 1 THEN 'misc' WHEN 2 THEN '--' WHEN 3 THEN 'o''neil 3d notes of the long and very long year' WHEN 4 THEN 'die rechnung' WHEN 5 THEN 'Über uns' ELSE 'topic ' || label END"
_CLEANED, _PLAINED = r"trim(regexp_replace(name, '\s+', ' ', 'g'))", "lower(trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')))"
_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"
_CUT = f"array_to_string(list_slice(string_split({_CLEANED}, ' '), 1, 6), ' ')"


@query("processed_names", f"""SELECT vec_id, CASE WHEN {_PLAINED} IN ('', 'untitled', 'misc', 'miscellaneous') THEN 'Untitled' ELSE rtrim(substring({_TITLE.format(_CUT)}, 1, 60)) END AS name,
 regexp_matches(name, '^[A-Za-z0-9 .,&()\\-'']+$') AND NOT list_has_any(regexp_split_to_array(lower(name), '[^a-z0-9]+'), {arr(fi.GERMAN)}) AS english FROM (SELECT vec_id, {_N} AS name FROM embeddings)""")
def _(spark, sf):
    v = F.col("vec_id") % 8
    name = F.when(v == 0, "tax  papers").when(v == 1, "misc").when(v == 2, "--").when(v == 3, "o'neil 3d notes of the long and very long year").when(v == 4, "die rechnung").when(v == 5, "Über uns").otherwise(F.concat(F.lit("topic "), F.col("label").cast("string")))
    return fx.table(spark, sf, "embeddings").select("vec_id", fi.processed_name(name).alias("name"), fi.is_english(name).alias("english"))


_DUP = "(SELECT vec_id AS n, 'topic ' || label AS name, CASE vec_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN 'finance ' || (vec_id % 6) WHEN 2 THEN NULL ELSE 'misc' END AS d FROM embeddings)"
_DIFF = f"CASE WHEN coalesce(diff, '') = '' OR lower(diff) = 'misc' THEN NULL ELSE {_TITLE.format('diff')} END"


@query("name_disambiguate", f"""WITH a AS (SELECT n, name, regexp_replace(trim(d), '^\\.', '') AS diff FROM {_DUP}), b AS (SELECT n, name, row_number() OVER w AS k, lag({_DIFF}) OVER w AS d FROM a WINDOW w AS (PARTITION BY name ORDER BY n)),
 c AS (SELECT *, k > 1 AND d IS NOT NULL AND row_number() OVER (PARTITION BY name, d ORDER BY n) = 1 AS use FROM b), e AS (SELECT *, count(*) FILTER (WHERE k > 1 AND NOT use) OVER (PARTITION BY name ORDER BY n) AS c FROM c)
 SELECT n, CASE WHEN k = 1 THEN name WHEN use THEN name || ' (' || d || ')' ELSE name || ' (' || (c + 1) || ')' END AS name FROM e""")
def _(spark, sf):
    v = F.col("vec_id")
    d = F.when(v % 4 == 0, ".pdf").when(v % 4 == 1, F.concat(F.lit("finance "), (v % 6).cast("string"))).when(v % 4 == 2, None).otherwise("misc")
    return fi.disambiguated(fx.table(spark, sf, "embeddings").select(v.alias("n"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("name"), d.alias("differentiator")))


# --- reviews ---

def reviews(spark, sf) -> DataFrame:
    v = F.col("vec_id")
    return fx.table(spark, sf, "embeddings").select(
        v.alias("id"), F.when(v % 2 == 0, "child").otherwise("parent").alias("level"), F.when(v % 9 == 0, "Misc files").otherwise(F.concat(F.lit("Topic "), F.col("label").cast("string"))).alias("proposed_name"),
        F.when(v % 13 != 0, v * 37 % 101 / 100.0).alias("confidence"), F.when(v % 11 != 0, v * 53 % 97 / 96.0).alias("mixedness"), F.when(v % 6 == 0, "mixed content").otherwise("").alias("warnings"),
        (v % 3 == 0).alias("llm_used"), (v % 4 == 0).alias("cache_hit"), F.when(v % 5 == 0, "llm_timeout").alias("fallback_reason"),
    ).withColumn("status", F.when(F.col("llm_used"), "LLM").when(F.col("cache_hit"), "Cache").otherwise("Baseline"))


REVIEWS = """(SELECT *, CASE WHEN llm_used THEN 'LLM' WHEN cache_hit THEN 'Cache' ELSE 'Baseline' END AS status FROM (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'child' ELSE 'parent' END AS level, CASE WHEN vec_id % 9 = 0 THEN 'Misc files' ELSE 'Topic ' || label END AS proposed_name,
 CASE WHEN vec_id % 13 <> 0 THEN (vec_id * 37 % 101) / 100.0::DOUBLE END AS confidence, CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 53 % 97) / 96.0::DOUBLE END AS mixedness, CASE WHEN vec_id % 6 = 0 THEN 'mixed content' ELSE '' END AS warnings,
 vec_id % 3 = 0 AS llm_used, vec_id % 4 = 0 AS cache_hit, CASE WHEN vec_id % 5 = 0 THEN 'llm_timeout' END AS fallback_reason FROM embeddings))"""
MIXED, UNSURE = 0.85, 0.55


def in_range(name: str, lo: float, hi: float):
    """A closed range; the whole range from 0 to 1 is no filter and keeps nulls, any other drops them."""
    return F.lit(True) if (lo, hi) == (0.0, 1.0) else F.coalesce(F.col(name).between(lo, hi), F.lit(False))


def needs_review():
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(F.col("mixedness") >= MIXED) | flag(F.col("confidence") <= UNSURE) | F.lower("warnings").rlike("review|mixed") | F.lower("proposed_name").rlike(fi.GENERIC_NAME) | flag(F.col("fallback_reason").isin(*fi.REVIEW_REASONS))


_NEEDS = f"coalesce(mixedness >= {MIXED}::DOUBLE, false) OR coalesce(confidence <= {UNSURE}::DOUBLE, false) OR regexp_matches(lower(warnings), 'review|mixed') OR regexp_matches(lower(proposed_name), {q(fi.GENERIC_NAME)}) OR coalesce(fallback_reason IN ({', '.join(map(q, fi.REVIEW_REASONS))}), false)"


@query("review_filters", f"SELECT id, level, status, {_NEEDS} AS needs_review FROM {REVIEWS} WHERE level IN ('child') AND status IN ('LLM', 'Baseline') AND confidence BETWEEN 0.2::DOUBLE AND 0.9::DOUBLE AND contains(lower(proposed_name), 'topic')")
def _(spark, sf):
    r = reviews(spark, sf).where(F.col("level").isin("child") & F.col("status").isin("LLM", "Baseline") & in_range("mixedness", 0.0, 1.0) & in_range("confidence", 0.2, 0.9) & F.lower("proposed_name").contains("topic"))
    return r.select("id", "level", "status", needs_review().alias("needs_review"))


@query("review_flag_metrics", f"""SELECT status, count(*) AS n, round(100 * avg(CAST(llm_used AS INT)), 4) AS llm_pct, round(100 * avg(CAST(cache_hit AS INT)), 4) AS cache_pct, round(100 * avg(CAST((NOT llm_used AND NOT cache_hit) OR coalesce(fallback_reason, '') <> '' AS INT)), 4) AS baseline_pct,
 count(*) FILTER (WHERE {_NEEDS}) AS reviews, round(median(confidence), 6) AS median_confidence, round(quantile_cont(mixedness, 0.1), 6) AS p10_mixedness FROM {REVIEWS} GROUP BY status""")
def _(spark, sf):
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 4)
    base = (~F.col("llm_used") & ~F.col("cache_hit")) | (F.coalesce("fallback_reason", F.lit("")) != "")
    places = quantiles(reviews(spark, sf), ["status"], "confidence", {"median_confidence": 0.5}).join(quantiles(reviews(spark, sf), ["status"], "mixedness", {"p10_mixedness": 0.1}), "status").withColumns({c: F.round(c, 6) for c in ("median_confidence", "p10_mixedness")})
    return reviews(spark, sf).groupBy("status").agg(F.count("*").alias("n"), pct(F.col("llm_used")).alias("llm_pct"), pct(F.col("cache_hit")).alias("cache_pct"), pct(base).alias("baseline_pct"), F.count_if(needs_review()).alias("reviews")).join(places, "status")


@query("label_coalesce", "SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'child' WHEN 1 THEN 'parent' ELSE 'n/a' END AS level, 'topic ' || label AS name FROM embeddings")
def _(spark, sf):
    # labels as three writers keep them, under names of their own
    e = fx.table(spark, sf, "embeddings").withColumn("t", F.concat(F.lit("topic "), F.col("label").cast("string")))
    a = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.lit("child").alias("level"), F.col("t").alias("proposed_name"))
    b = e.where("vec_id % 3 = 1").select(F.col("vec_id").alias("cluster_id"), F.lit("parent").alias("type"), F.col("t").alias("name"))
    c = e.where("vec_id % 3 = 2").select(F.col("vec_id").alias("parent_id"), F.col("t").alias("topic_name"))
    u = ops.union_evolved(a, b, c)
    return u.select(F.coalesce("id", "cluster_id", "parent_id").alias("id"), F.coalesce("level", "type", F.lit("n/a")).alias("level"), F.coalesce("proposed_name", "name", "topic_name").alias("name"))


# --- sorting into folders ---

WEIGHTS, SURE = (0.55, 0.30, 0.15), 0.5


def sort_plan(spark, sf) -> DataFrame:
    """doc_id, filename, target, confidence, margin, reason: each document's best folder. Folders are the labels, each with the words of its alias line; a folder's vector is its
    label's mean. Likeness of names is the cosine of their sets of words. Folders are a few rows and sent to all tasks."""
    words = alias_table(spark).groupBy("target").agg(F.collect_list(F.struct("keyword", "weight")).alias("k"))
    names = words.select("target", "k", F.array_union(s.tokens(F.col("target")), F.transform("k", lambda x: x["keyword"])).alias("t")).withColumn("label", (F.row_number().over(Window.orderBy("target")) - 1).cast("int"))
    folders = names.join(ops.mean_vector(fx.table(spark, sf, "embeddings"), ["label"], "embedding", "c"), "label")
    files = fx.catalog(spark, sf).select("doc_id", "filename", F.array_distinct(s.tokens(F.col("filename"))).alias("w")).join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    p = files.crossJoin(F.broadcast(folders))
    meta = (1 + F.coalesce(F.try_divide(F.size(F.array_intersect("w", "t")), F.sqrt(F.size("w") * F.size("t"))), F.lit(0.0))) / 2
    p = p.select("doc_id", "filename", "target", meta.alias("meta"), ((1 + s.cosine(F.col("embedding"), F.col("c"))) / 2).alias("content"), fi.keyword_score(F.col("w"), F.col("k")).alias("keywords"))
    total = sum(WEIGHTS)
    conf = F.round(WEIGHTS[0] / total * F.col("meta") + WEIGHTS[1] / total * F.col("content") + WEIGHTS[2] / total * F.col("keywords"), 9)
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "target")
    p = p.withColumn("confidence", conf).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("confidence").over(w)).where("n = 1")
    reason = F.concat(F.lit("meta="), F.format_string("%.2f", F.bround("meta", 4)), F.lit("; content="), F.format_string("%.2f", F.bround("content", 4)), F.lit("; keywords="), F.format_string("%.2f", F.bround("keywords", 4)))
    return p.select("doc_id", "filename", "target", "confidence", (F.col("confidence") - F.col("next")).alias("margin"), "meta", "keywords", reason.alias("reason"))


SORTED = f"""(WITH t AS (SELECT target, list({{'keyword': keyword, 'weight': weight}}) AS k, list_distinct(list_concat({TOK.format('target')}, list(keyword))) AS t, row_number() OVER (ORDER BY target) - 1 AS label FROM {ALIAS_SQL} GROUP BY target), f AS (SELECT t.*, c FROM t JOIN {CENTROIDS} USING (label)),
 d AS (SELECT doc_id, filename, list_distinct({TOK.format('filename')}) AS w, e FROM {CATALOG} JOIN (SELECT vec_id AS doc_id, e FROM {V}) USING (doc_id)),
 p AS (SELECT doc_id, filename, target, (1 + len(list_intersect(w, t)) / sqrt(len(w) * len(t))) / 2 AS meta, (1 + list_cosine_similarity(e, c)) / 2 AS content, list_sum(list_transform(k, lambda x: CASE WHEN list_contains(w, x.keyword) THEN x.weight ELSE 0 END)) / list_sum(list_transform(k, lambda x: x.weight)) AS keywords FROM d, f),
 s AS (SELECT *, round({WEIGHTS[0]}::DOUBLE * meta + {WEIGHTS[1]}::DOUBLE * content + {WEIGHTS[2]}::DOUBLE * keywords, 9) AS confidence FROM p)
 SELECT *, confidence - next AS margin FROM (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY confidence DESC, target)) WHERE n = 1)"""


@query("smart_sort_plan", f"SELECT doc_id, target, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(meta, 6) AS meta, round(keywords, 6) AS keywords FROM {SORTED}")
def _(spark, sf):
    return sort_plan(spark, sf).select("doc_id", "target", *[F.round(c, 6).alias(c) for c in ("confidence", "margin", "meta", "keywords")])


@query("sort_plan_summary", f"SELECT target, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(100 * avg(CAST(confidence >= {SURE}::DOUBLE AS INT)), 4) AS sure_pct FROM {SORTED} GROUP BY target")
def _(spark, sf):
    return sort_plan(spark, sf).groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(100 * F.avg((F.col("confidence") >= SURE).cast("int")), 4).alias("sure_pct"))


@query("sort_reasons", f"SELECT doc_id, round(round(keywords, 2), 2) AS keywords, CASE WHEN confidence >= 0.75::DOUBLE THEN 'strong' WHEN confidence >= 0.45::DOUBLE THEN 'medium' WHEN confidence >= 0.15::DOUBLE THEN 'light' ELSE 'none' END AS bucket, NULL::DOUBLE AS absent FROM {SORTED}")
def _(spark, sf):
    p = sort_plan(spark, sf)
    return p.select("doc_id", F.round(fi.reason_value(F.col("reason"), "keywords"), 2).alias("keywords"), fi.score_bucket(F.col("confidence")).alias("bucket"), fi.reason_value(F.col("reason"), "llm").alias("absent"))


@query("sort_moves", f"""SELECT doc_id, '/sorted/' || target || '/' || stem || CASE WHEN n = 1 THEN '' ELSE ' (' || (n - 1) || ')' END || '.' || ext AS destination, CASE WHEN confidence >= {SURE}::DOUBLE THEN 'moved' ELSE 'skipped' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY target, stem, ext ORDER BY doc_id) AS n FROM (SELECT doc_id, target, confidence, regexp_replace(filename, '_[0-9]+\\.[a-z]+$', '') AS stem, regexp_extract(filename, '\\.([a-z]+)$', 1) AS ext FROM {SORTED}))""")
def _(spark, sf):
    # files of one name in one folder get numbers; a plan only, nothing is moved
    p = sort_plan(spark, sf).select("doc_id", "target", "confidence", F.regexp_replace("filename", r"_[0-9]+\.[a-z]+$", "").alias("stem"), F.regexp_extract("filename", r"\.([a-z]+)$", 1).alias("ext"))
    n = F.row_number().over(Window.partitionBy("target", "stem", "ext").orderBy("doc_id"))
    suffix = F.when(n == 1, "").otherwise(F.concat(F.lit(" ("), (n - 1).cast("string"), F.lit(")")))
    return p.select("doc_id", F.concat(F.lit("/sorted/"), "target", F.lit("/"), "stem", suffix, F.lit("."), "ext").alias("destination"), F.when(F.col("confidence") >= SURE, "moved").otherwise("skipped").alias("status"))
