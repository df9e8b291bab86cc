"""Classification of documents, persons, and financial facts in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as mo
from ..functions import rules as ru
from ..functions import text as tx
from ..operators.paper_records import AROUND, CHUNK, LINKS, STEP, covered, merged, papers, records
from ..operators.retrieve import kept
from ..operators.search import small
from ..sources import fixtures as fx
from .registry import query

ST, PAPERS = fx.STATEMENTS, fx.PAPERS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Sql(str):
    """SQL with @@ in the places of an expression."""

    def of(self, x: str) -> str:
        return self.replace("@@", x)


def ascii_sql(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\x00-\x7F]', 'z', 'g')"


_SIDE = {"path": rf"regexp_replace({ascii_sql('path')}, '[_/\\.\-]+', ' ', 'g')", "text": ascii_sql(f"substring(coalesce(text, ''), 1, {ru.DOC_SAMPLE})")}
_RULES = [f"WHEN regexp_matches({_SIDE[w]}, {q(rf'\b({p})\b')}) THEN " for _, w, p, _c in ru.DOC_RULES]


def _doc_case(values: list[str], other: str) -> str:
    return "CASE " + " ".join(rule + v for rule, v in zip(_RULES, values, strict=True)) + f" ELSE {other} END"


KIND = _doc_case([q(r[0]) for r in ru.DOC_RULES], "'other'")
CONFIDENCE = _doc_case([f"{r[3]}::DOUBLE" for r in ru.DOC_RULES], "0.25::DOUBLE")
AUTHORITY = "CASE doc_type " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in ru.AUTHORITY) + " END"


@query("doc_type_classify", f"SELECT doc_id, doc_type, confidence, CASE WHEN confidence = 0.25::DOUBLE THEN 'fallback' ELSE 'rule' END AS source, {AUTHORITY} AS authority FROM (SELECT doc_id, {KIND} AS doc_type, {CONFIDENCE} AS confidence FROM {PAPERS})")
def _(spark, sf):
    d = ru.with_doc_type(fx.papers(spark, sf)).select("doc_id", "doc_type", "confidence", "source")
    return d.withColumn("authority", ru.authority(F.col("doc_type")))


_STOP = ", ".join(map(q, ru.NAME_STOP))
PERSONS = rf"""(WITH p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS part FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_extract(path, '[^\\/]*$'), '\.[^.]*$', ''), '[^A-Za-z0-9]+') AS w FROM {ST})),
 f AS (SELECT doc_id, i, regexp_replace(part, '[^A-Za-z]', '', 'g') AS letters, lower(part) IN ({_STOP}) OR regexp_matches(part, '^[0-9]+$') AS stop, regexp_matches(part, '^[A-Za-z]') AS starts FROM p),
 n AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT *, NOT stop AND starts AND length(letters) >= 2 AS ok FROM f)),
 m AS (SELECT *, max(CAST(stop AND n >= 2 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS done FROM n)
 SELECT doc_id, string_agg(upper(letters[1]) || lower(letters[2:]), ' ' ORDER BY i) AS person FROM m WHERE ok AND done = 0 AND n <= 3 GROUP BY doc_id HAVING count(*) >= 2)"""
_LINE = f"list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 12), lambda x: trim(x)), lambda x: length(x) <= 60 AND lower(x) NOT IN ({', '.join(map(q, ru.NOT_A_NAME))}) AND regexp_matches(x, {q(ru.NAME_LINE)}))[1]"


@query("person_names", f"SELECT d.doc_id, d.doc_type, coalesce(p.person, {_LINE}) AS person FROM (SELECT doc_id, text, {KIND} AS doc_type FROM {ST}) d LEFT JOIN {PERSONS} p USING (doc_id) WHERE d.doc_type IN ('cv', 'cover_letter', 'reference_letter')")
def _(spark, sf):
    st = fx.statements(spark, sf)
    d = ru.with_doc_type(st).where(F.col("doc_type").isin("cv", "cover_letter", "reference_letter"))
    return d.join(ru.file_persons(d), "doc_id", "left").select("doc_id", "doc_type", F.coalesce("person", ru.text_person(F.col("text"))).alias("person"))


def _family_case() -> str:
    sample = f"lower(substring(coalesce(text, ''), 1, {ru.FAMILY_SAMPLE}))"
    out = []
    for name, kinds, in_path, in_text in ru.FAMILY_RULES:
        tests = [f"doc_type IN ({', '.join(map(q, kinds))})"] * bool(kinds) + [f"contains(lower(path), {q(x)})" for x in in_path] + [f"contains({sample}, {q(x)})" for x in in_text]
        out.append(f"WHEN {' OR '.join(tests)} THEN {q(name)}")
    return f"CASE {' '.join(out)} WHEN regexp_matches({ascii_sql('path')}, {q(ru.BOOK)}) THEN 'book' WHEN regexp_matches({ascii_sql(sample)}, {q(ru.TAX_SIGNAL)}) THEN 'official_letter' ELSE 'archive_misc' END"


FAMILY = _family_case()
SIGNALS = f"regexp_extract_all({ascii_sql('text')}, {q(ru.TAX_SIGNAL)}, 1)"
DISTINCT_IN_ORDER = Sql("list_filter(@@, lambda x, i: list_position(@@, x) = i)")
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({ascii_sql('text')}, {q(p)}) THEN {q(n)}" for n, p in ru.CATEGORIES) + " END"
RECORD_TYPE = Sql("CASE WHEN contains(lower(@@), 'refund') THEN 'refund' WHEN contains(lower(@@), 'tax') THEN 'tax_payment' WHEN family IN ('receipt', 'invoice', 'school_fee_letter') THEN 'expense' WHEN family IN ('payment_confirmation', 'bank_statement') THEN 'payment' ELSE 'financial_event' END")
TYPED = Sql(f"(SELECT *, {FAMILY} AS family FROM (SELECT *, {KIND} AS doc_type FROM @@))")


def typed(docs: DataFrame) -> DataFrame:
    return ru.with_family(ru.with_doc_type(docs))


@query("source_family", f"SELECT doc_id, family, {RECORD_TYPE.of('text')} AS record_type FROM {TYPED.of(PAPERS)}")
def _(spark, sf):
    return typed(fx.papers(spark, sf)).select("doc_id", "family", ru.record_type(F.col("family"), F.col("text")).alias("record_type"))


@query("tax_signals", f"SELECT doc_id, array_to_string({DISTINCT_IN_ORDER.of(SIGNALS)}, ',') AS signals FROM {PAPERS}")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", F.array_join(ru.tax_signals(F.col("text")), ",").alias("signals"))


@query("expense_category", f"SELECT doc_id, {CATEGORY} AS category FROM {PAPERS}")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ru.expense_category(F.col("text")).alias("category"))


# --- amounts, dates, counterparties ---

_RAW = f"regexp_extract(span, {q(mo.NUMBER)})"
_SIGN = r"upper(regexp_replace(span, '[\d.,\s]', '', 'g'))"
CURRENCY = f"CASE {_SIGN} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mo.SIGNS) + f" WHEN '' THEN 'UNKNOWN' ELSE {_SIGN} END"
VALUE = """TRY_CAST(CASE WHEN contains(raw, ',') AND contains(raw, '.') THEN CASE WHEN strpos(reverse(raw), ',') < strpos(reverse(raw), '.') THEN replace(replace(raw, '.', ''), ',', '.') ELSE replace(raw, ',', '') END
 WHEN regexp_matches(raw, ',[0-9]{1,2}$') THEN replace(raw, ',', '.') ELSE replace(raw, ',', '') END AS DOUBLE)"""
_LENGTH = Sql("coalesce(list_sum(list_transform(@@, lambda x: length(x))), 0)")


def amounts_sql(source: str, keys: str) -> str:
    """keys, i, span, amount, currency, start of each amount in the source's text."""
    return f"""(SELECT {keys}, i, span, amount, {CURRENCY} AS currency, start FROM (SELECT *, {VALUE} AS amount FROM (SELECT *, {_RAW} AS raw FROM (SELECT {keys}, i, spans[i] AS span,
 CAST({_LENGTH.of('between_[1:i]')} + {_LENGTH.of('spans[1:i - 1]')} AS INT) AS start FROM (SELECT {keys}, spans, between_, unnest(range(1, len(spans) + 1)) AS i FROM
 (SELECT {keys}, regexp_extract_all(text, {q(mo.AMOUNT)}) AS spans, regexp_split_to_array(text, {q(mo.AMOUNT)}) AS between_ FROM {source}) WHERE len(spans) > 0)))) WHERE amount > 0)"""


_PAPER_TEXTS = f"(SELECT doc_id, coalesce(text, '') AS text FROM {PAPERS})"


@query("amounts_extract", f"SELECT doc_id, span, round(amount, 6) AS amount, currency, start FROM {amounts_sql(_PAPER_TEXTS, 'doc_id')}")
def _(spark, sf):
    a = fx.papers(spark, sf).select("doc_id", F.explode(mo.amounts(F.col("text"))).alias("a"))
    return a.select("doc_id", "a.span", F.round("a.amount", 6).alias("amount"), "a.currency", "a.start")


_DAY = "CAST(TRY_CAST(lpad({0}, 4, '0') || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') AS DATE) AS VARCHAR)"
_ISO, _DMY, _NAMED = r"'^(\d{4})-(\d{1,2})-(\d{1,2})$'", r"'^(\d{1,2})([./-])(\d{1,2})([./-])(\d{4}|\d{2})$'", r"'^([a-z]+) (\d{1,2}),? (\d{4})$'"
_X = lambda p, i: f"regexp_extract(x, {p}, {i})"
_MONTHS = "CASE " + " ".join(f"WHEN {_X(_NAMED, 1)} IN ({q(m)}, {q(m[:3])}) THEN '{i + 1}'" for i, m in enumerate(mo.MONTHS)) + " ELSE '99' END"
_YEAR = f"CASE WHEN length({_X(_DMY, 5)}) = 4 THEN {_X(_DMY, 5)} WHEN {_X(_DMY, 5)} >= '{mo.PIVOT}' THEN '19' || {_X(_DMY, 5)} ELSE '20' || {_X(_DMY, 5)} END"
DATE_OF = f"CASE WHEN regexp_matches(x, {_ISO}) THEN {_DAY.format(_X(_ISO, 1), _X(_ISO, 2), _X(_ISO, 3))} WHEN regexp_matches(x, {_DMY}) AND {_X(_DMY, 2)} = {_X(_DMY, 4)} THEN {_DAY.format(_YEAR, _X(_DMY, 3), _X(_DMY, 1))} WHEN regexp_matches(x, {_NAMED}) THEN {_DAY.format(_X(_NAMED, 3), _MONTHS, _X(_NAMED, 2))} END"
_TOKENS = rf"list_transform(regexp_extract_all({ascii_sql('@@')}, {q(mo.DATE)}), lambda y: lower(regexp_replace(y, '\s+', ' ', 'g')))"
DATES = Sql(f"list_sort(list_distinct(list_filter(list_transform({_TOKENS}, lambda x: {DATE_OF}), lambda z: z IS NOT NULL)))")


@query("dates_extract", f"SELECT doc_id, array_to_string({DATES.of('text')}, ',') AS dates FROM {_PAPER_TEXTS}")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", F.array_join(mo.dates(F.col("text")), ",").alias("dates"))


COUNTERPARTY = Sql(rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(@@, {q(mo.COUNTERPARTY)}, 1), '\s+', ' ', 'g'), '^[ ,.;:]+', ''), '[ ,.;:]+$', ''), '')")


@query("counterparty_extract", f"SELECT doc_id, {COUNTERPARTY.of('text')} AS counterparty FROM {ST}")
def _(spark, sf):
    return fx.statements(spark, sf).select("doc_id", mo.counterparty(F.col("text")).alias("counterparty"))


# --- enrichment ---

YEARS = Sql(r"list_sort(list_distinct(list_transform(regexp_extract_all(@@, '\b((?:19|20)[0-9]{2})\b', 1), lambda y: CAST(y AS INT))))")
_NEAR = r"\b(tax|steuer|vat)\b"
TAX_YEARS = Sql(rf"list_filter({YEARS}, lambda y: regexp_matches(lower(@@), '\b' || y || '\b.{{0,20}}{_NEAR}|{_NEAR}.{{0,20}}\b' || y || '\b'))")
_STATE = TYPED.of(ST)
_SUP, _PREF = ", ".join(map(q, ru.SUPPRESSED)), ", ".join(map(q, ru.PREFERRED))


def enrichment(docs: DataFrame) -> DataFrame:
    """Facts of each document (doc_id, path, text); a family that holds no financial papers has is_financial false and no facts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = typed(docs).withColumn("open", ~F.col("family").isin(*ru.SUPPRESSED))
    only = lambda c: F.when(F.col("open"), c)
    d = d.withColumn("all_dates", mo.dates(t)).withColumn("years", tx.years(t)).withColumn("amounts", F.slice(F.array_distinct(F.transform(mo.amounts(t), lambda a: a["amount"])), 1, 25)).withColumn("signals", ru.tax_signals(t))
    # a record needs an amount and a date, in any chunk
    financial = F.col("family").isin(*ru.PREFERRED) | (F.size("signals") > 0) | ((F.size("amounts") >= 1) & (F.size("all_dates") >= 1))
    return d.select(
        "doc_id", "family", (F.col("open") & financial).alias("is_financial"), only(F.get("all_dates", F.lit(0))).alias("document_date"), only(F.array_join(F.col("years").cast("array<string>"), ",")).alias("mentioned_years"),
        only(F.array_join(mo.tax_years(F.col("years"), t).cast("array<string>"), ",")).alias("tax_years"), only(F.size("amounts").cast("long")).alias("n_amounts"), only(F.round(F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x), 4)).alias("sum_amounts"), only(mo.counterparty(t)).alias("counterparty"),
        only(F.array_join("signals", ",")).alias("signals"), only(ru.expense_category(t)).alias("category"), only(ru.record_type(F.col("family"), t)).alias("record_type"),
    )


@query("financial_enrichment", f"""WITH d AS (SELECT *, {DATES.of('text')} AS dates_, {YEARS.of('text')} AS years_, {TAX_YEARS.of('text')} AS tax_, {DISTINCT_IN_ORDER.of(SIGNALS)} AS signals_, {CATEGORY} AS category_, {RECORD_TYPE.of('text')} AS type_, {COUNTERPARTY.of('text')} AS party FROM {_STATE}),
 a AS (SELECT doc_id, count(*) AS n, sum(amount) AS s FROM (SELECT DISTINCT doc_id, amount FROM {amounts_sql(ST, 'doc_id')}) GROUP BY doc_id),
 j AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(s, 0) AS s, family NOT IN ({_SUP}) AS open_ FROM d LEFT JOIN a USING (doc_id))
 SELECT doc_id, family, open_ AND (family IN ({_PREF}) OR len(signals_) > 0 OR (n >= 1 AND len(dates_) >= 1)) AS is_financial, CASE WHEN open_ THEN dates_[1] END AS document_date, CASE WHEN open_ THEN array_to_string(years_, ',') END AS mentioned_years, CASE WHEN open_ THEN array_to_string(tax_, ',') END AS tax_years,
 CASE WHEN open_ THEN n END AS n_amounts, CASE WHEN open_ THEN round(s, 4) END AS sum_amounts, CASE WHEN open_ THEN party END AS counterparty, CASE WHEN open_ THEN array_to_string(signals_, ',') END AS signals, CASE WHEN open_ THEN category_ END AS category, CASE WHEN open_ THEN type_ END AS record_type FROM j""")
def _(spark, sf):
    return enrichment(fx.statements(spark, sf))


_CHUNKS = f"(SELECT doc_id, checksum, family, day, at_ // {STEP} AS chunk, substring(text, at_ + 1, {CHUNK}) AS text FROM (SELECT *, {DATES.of('text')}[1] AS day, unnest(range(0, greatest(length(text) - 1, 0) + 1, {STEP})) AS at_ FROM {_STATE} WHERE family NOT IN ({_SUP})))"
_KEYS = "doc_id, checksum, family, day, chunk, text"
RECORDS = f"""(SELECT doc_id, checksum, merge_key, arg_min(record_type, chunk * 1000 + i) AS record_type, arg_min(date, chunk * 1000 + i) AS date, arg_min(amount, chunk * 1000 + i) AS amount, arg_min(currency, chunk * 1000 + i) AS currency, min(party) AS counterparty, min(family) AS family, max(confidence) AS confidence,
 least(count(DISTINCT (chunk, evidence)), {LINKS}) AS n_links, CAST(substring(min(date), 1, 4) AS INT) AS year FROM (SELECT *, record_type || '|' || date || '|' || printf('%.2f', amount) || '|' || currency || '|' || coalesce(lower(party), '') AS merge_key,
 CASE WHEN party IS NULL THEN 0.72::DOUBLE ELSE 0.8::DOUBLE END AS confidence, trim(substring(text, greatest(start - {AROUND}, 0) + 1, start + length(span) + {AROUND} - greatest(start - {AROUND}, 0))) AS evidence
 FROM (SELECT *, coalesce({DATES.of('text')}[1], day) AS date, {COUNTERPARTY.of('text')} AS party, {RECORD_TYPE.of('text')} AS record_type FROM {amounts_sql(_CHUNKS, _KEYS)}) WHERE date IS NOT NULL) GROUP BY doc_id, checksum, merge_key)"""


@query("financial_records", f"SELECT doc_id, merge_key, record_type, date, round(amount, 4) AS amount, currency, counterparty, confidence, n_links, year FROM {RECORDS}")
def _(spark, sf):
    return records(fx.statements(spark, sf)).select("doc_id", "merge_key", "record_type", "date", F.round("amount", 4).alias("amount"), "currency", "counterparty", "confidence", "n_links", "year")


@query("record_upsert_stats", f"""WITH r AS (SELECT sha1(merge_key) AS id, bool_or(doc_id % 3 = 0) AS had, bool_or(doc_id % 3 <> 0) AS comes, max(confidence) AS confidence, sum(n_links) AS links FROM {RECORDS} GROUP BY merge_key)
 SELECT CASE WHEN comes AND had THEN 'updated' WHEN comes THEN 'created' ELSE 'kept' END AS change, count(*) AS n, max(confidence) AS confidence, CAST(sum(links) AS BIGINT) AS links FROM r GROUP BY 1""")
def _(spark, sf):
    # the store has every third document's records; all others come and are merged by id, the hash's bytes
    old = F.col("doc_id") % 3 == 0
    r = records(fx.statements(spark, sf)).groupBy(F.unhex(F.sha1("merge_key")).alias("id")).agg(F.max(old).alias("had"), F.max(~old).alias("comes"), F.max("confidence").alias("confidence"), F.sum("n_links").alias("links"))
    change = F.when(F.col("comes") & F.col("had"), "updated").when(F.col("comes"), "created").otherwise("kept")
    return r.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.sum("links").alias("links"))


# --- answers ---

YEAR, SURE = 1996, 0.65


def _concept(kind: Column) -> Column:
    return kind.contains("expense") | kind.contains("invoice") | kind.contains("receipt")


_LINE_SQL = "'- Date: ' || coalesce(date, 'unknown') || ' | Amount: ' || printf('%.2f', amount) || CASE WHEN currency IN ('', 'UNKNOWN') THEN '' ELSE ' ' || currency END || ' | Counterparty: ' || coalesce(counterparty, 'unknown') || ' | Source: ' || source"


@query("financial_answer", f"""WITH d AS (SELECT doc_id, customer, path, text, checksum, family FROM {_STATE}), r AS (SELECT * FROM {RECORDS}),
 items AS (SELECT d.customer, CASE WHEN r.year <> {YEAR} THEN 'mentioned' WHEN confidence >= {SURE}::DOUBLE AND n_links > 0 THEN 'clearly_supported' ELSE 'ambiguous' END AS bucket, date, amount, currency, counterparty, regexp_extract(path, '[^/]*$') || ' (chunk evidence)' AS source
  FROM r JOIN d USING (doc_id) WHERE regexp_matches(record_type, 'expense|invoice|receipt')),
 bare AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r)), f AS (SELECT *, {YEARS.of('text')} AS ys FROM bare), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM {amounts_sql('bare', 'doc_id')}) WHERE n = 1),
 fallback AS (SELECT customer, 'mentioned' AS bucket, {DATES.of('text')}[1] AS date, amount, currency, NULL AS counterparty, regexp_extract(path, '[^/]*$') AS source FROM f JOIN a USING (doc_id) WHERE len(ys) = 0 OR list_contains(ys, {YEAR}))
 SELECT customer, bucket, count(*) AS n, round(sum(amount), 2) AS total, min({_LINE_SQL}) AS first_line FROM (SELECT * FROM items UNION ALL SELECT * FROM fallback) GROUP BY customer, bucket""")
def _(spark, sf):
    # a customer's papers are what was retrieved; papers without records are told from their texts
    d = fx.statements(spark, sf)
    # made once, as it is read three times: answers on the concept, what has records, and what may have none
    made = kept(papers(d, YEAR).withColumn("checksum", F.when(_concept(F.col("record_type")), F.col("checksum"))).withColumn("path", F.when(F.col("merge_key").isNull(), F.col("path"))))
    name = ru.filename(F.col("path"))
    bucket = F.when(F.col("year") != YEAR, "mentioned").when((F.col("confidence") >= SURE) & (F.col("n_links") > 0), "clearly_supported").otherwise("ambiguous")
    items = merged(made.where(_concept(F.col("record_type")))).join(d.select("doc_id", "customer", "path"), "doc_id").select("customer", bucket.alias("bucket"), "date", "amount", "currency", "counterparty", F.concat(name, F.lit(" (chunk evidence)")).alias("source"))
    bare = made.where("merge_key is null").join(made.where("merge_key is not null").select("doc_id"), "doc_id", "left_anti").select("customer", F.lit("mentioned").alias("bucket"), "date", "amount", "currency", "counterparty", name.alias("source"))
    unit = F.when(F.col("currency").isin("", "UNKNOWN"), "").otherwise(F.concat(F.lit(" "), "currency"))
    line = F.concat(F.lit("- Date: "), F.coalesce("date", F.lit("unknown")), F.lit(" | Amount: "), F.format_string("%.2f", "amount"), unit, F.lit(" | Counterparty: "), F.coalesce("counterparty", F.lit("unknown")), F.lit(" | Source: "), "source")
    return items.unionByName(bare).groupBy("customer", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.min(line).alias("first_line"))


@query("answer_coverage", f"SELECT customer, count(*) AS papers, count(*) FILTER (WHERE family NOT IN ({_SUP}) AND doc_id NOT IN (SELECT doc_id FROM {RECORDS})) AS uncovered FROM {_STATE} GROUP BY customer")
def _(spark, sf):
    # a document's rows meet, since any of them may have its records
    d = covered(fx.statements(spark, sf)).withColumn("any", F.max("has").over(Window.partitionBy("doc_id")))
    return d.groupBy("customer").agg(F.count("*").alias("papers"), F.count_if(F.col("open") & ~F.col("any")).alias("uncovered"))


@query("linked_records_semi", f"SELECT doc_id, merge_key FROM {RECORDS} WHERE checksum IN (SELECT checksum FROM {ST} WHERE customer % 10 = 0)")
def _(spark, sf):
    # links name documents by checksum; a record's checksum is its document's, so only linked documents are read
    st = fx.statements(spark, sf)
    linked = st.where("customer % 10 = 0").select("checksum").distinct()
    return records(st.join(small(linked, 200_000), "checksum", "left_semi")).select("doc_id", "merge_key")
