"""Views that bind the driver's tables to the engine's: fulltext, chunks, inventory, records, hits, statements, a search catalogue and questions. The SQL texts define the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_S = 1704067200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fulltext(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Documents (a stream of them, if one is given) as files."""
    ext = F.element_at(F.array(F.lit("txt"), F.lit("pdf"), F.lit("docx")), (F.col("doc_id") % 3 + 1).cast("int"))
    return (table(spark, sf_dir, "documents") if documents is None else documents).select(
        "doc_id", "text", "lang", "source", F.sha2("text", 256).alias("checksum"), ext.alias("ext"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), (F.lit(BASE_S) + F.col("doc_id") * 3600).cast("long").alias("modified_s"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext(spark, sf_dir).select(
        "path", "source", "modified_s", F.when(F.col("doc_id") % 17 != 0, F.col("size_bytes")).alias("size_bytes"), (F.col("doc_id") % 10 != 0).alias("exists_now"),
        F.when(F.col("doc_id") % 4 != 0, F.col("modified_s") + (F.col("doc_id") % 3 - 1) * 60).alias("last_indexed_s"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits of twenty queries with scores fixed by doc_id."""
    d = F.col("doc_id")
    return fulltext(spark, sf_dir).select(
        (d % 20).alias("query_id"), d.alias("id"), "checksum", "path", "modified_s", "lang",
        (d * 37 % 101 / 100.0).alias("score_vector"), (d * 53 % 97 / 96.0).alias("score_bm25"), (d % 7 / 4.0 - 0.25).alias("authority_rank"),
        F.when(d % 3 == 0, F.lit("cv")).when(d % 3 == 1, F.lit("other")).otherwise(F.lit("invoice")).alias("doc_type"), F.concat(F.lit("person"), (d * 7 % 5).cast("string")).alias("person"),
        (d * 11 % 4).cast("int").alias("title_overlap"), (d * 13 % 5 == 0).alias("generic_title"), (d * 17 % 6 == 0).alias("artefact"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    kind = F.when(F.col("l_returnflag") == "R", "refund").when(F.col("l_returnflag") == "A", "payment").otherwise("expense")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.round("l_extendedprice", 2).alias("amount"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").cast("long").alias("year"),
        F.col("c_name").alias("counterparty"), kind.alias("record_type"), (F.col("l_quantity") / 50.0).alias("confidence"),
    )


# Names of the files that statements are kept in, one for each kind.
STATEMENT_FILES = ("invoice", "receipt", "kontoauszug", "payment confirmation", "steuerbescheid", "tuition", "form", "lecture", "cv", "CV_Anna_Weber", "Reference_Letter_Jonas_Keller", "scan")


#: Where a session's statements of a data folder are.
_WRITTEN: dict[tuple[str, str], str] = {}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and bills written from orders: doc_id, customer, path, text, checksum. Dates and amounts come in several spellings. They are written to the shared folder once a session: rules are
    to read texts, and a text that is made by an expression would be made again for each rule that looks at it."""
    from ..streaming.jobs import folder

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        path = folder(spark)
        _letters(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema("doc_id long, customer long, path string, text string, checksum string").parquet(_WRITTEN[key])


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % len(STATEMENT_FILES)
    year = F.year("o_orderdate").cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = lambda mark: F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(mark), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    european, american = F.concat(grouped("."), F.lit(","), part), F.concat(grouped(","), F.lit("."), part)
    amount = F.when(k % 3 == 0, F.concat(F.lit("EUR "), european)).when(k % 3 == 1, F.concat(F.lit("$"), american)).otherwise(F.concat(american, F.lit(" USD")))
    day = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 4 == 2, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    head = F.when(kind == 8, F.lit("Maria Lopez")).when(k % 4 == 0, F.concat(F.lit("Invoice number "), k.cast("string"))).when(k % 4 == 1, F.lit("Receipt of your order")).when(k % 4 == 2, F.lit("Gross pay and net pay")).otherwise(F.lit("Dear customer"))
    last = F.when(k % 5 == 0, F.concat(F.lit("Tax year "), year, F.lit(" with vat of 19 percent"))).when(k % 5 == 1, F.lit("Refund of EUR 12,50 for the flight")).when(k % 5 == 2, F.lit("Insurance premium of 99.95 EUR")).otherwise(F.lit("Thank you"))
    text = F.concat_ws("\n", head, F.concat(F.lit("Vendor: Firm "), F.col("o_custkey").cast("string"), F.lit(" Ltd.")), F.concat(F.lit("Date: "), day), F.concat(F.lit("Sum due "), amount), last)
    name = F.element_at(F.array(*map(F.lit, STATEMENT_FILES)), (kind + 1).cast("int"))
    path = F.concat(F.lit("/finance/"), year, F.lit("/"), name, F.lit("_"), k.cast("string"), F.lit(".pdf"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    # a small file is one task's, and so would be all that reads the letters
    if orders.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        orders = orders.repartition(spark.sparkContext.defaultParallelism)
    return orders.select(k.alias("doc_id"), F.col("o_custkey").alias("customer"), path.alias("path"), text.alias("text")).withColumn("checksum", F.sha2("text", 256))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text of all documents, and of statements under negative numbers."""
    return fulltext(spark, sf_dir).select("doc_id", "path", "text").unionByName(statements(spark, sf_dir).select((-F.col("doc_id")).alias("doc_id"), "path", "text"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search metadata of documents: names that hold titles, artefacts and persons."""
    d = F.col("doc_id")
    stem = F.element_at(F.array(*map(F.lit, CATALOG_STEMS)), (d % len(CATALOG_STEMS) + 1).cast("int"))
    person = F.when(d % 3 == 0, F.concat(F.lit("person"), (d * 7 % 5).cast("string")))
    return fulltext(spark, sf_dir).select(
        "doc_id", "text", "checksum", "modified_s", F.concat(F.lit("/corpus/"), "source", F.lit("/"), stem, F.lit("_"), d.cast("string"), F.lit("."), "ext").alias("path"), F.concat(stem, F.lit("_"), d.cast("string"), F.lit("."), "ext").alias("filename"),
        F.when(d % 3 == 0, F.lit("cv")).when(d % 3 == 1, F.when(d % 4 == 0, F.lit("letter")).otherwise(F.lit("other"))).otherwise(F.lit("invoice")).alias("doc_type"), person.alias("person_name"), (d % 7 / 4.0 - 0.25).alias("authority_rank"),
        F.when(d % 2 == 0, F.lit("expense")).when(d % 5 == 1, F.lit("payment")).alias("record_type"),
    )


# The first parts of the catalogue's file names, and what questions are led in by.
CATALOG_STEMS = ("cv", "report", "file_list", "invoice", "paper_overview", "course", "drive_inventory", "contract", "summary")
LEAD_INS = ("", "what is in the report on ", "which cv tells of ", "when and where did the person of this cv study ", "bitcoin price today ", "file list of ", "\"contract\" 2024 ", "which invoices of 2024 were paid for ", "tax payments of 2023 on ")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: every benchmark item as a question."""
    lead = F.element_at(F.array(*map(F.lit, LEAD_INS)), (F.col("item_id") % len(LEAD_INS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(lead, "text").alias("text"))


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} + 1 AS INT))"


_GROUPED = "CASE WHEN whole >= 1000 THEN CAST(whole // 1000 AS VARCHAR) || '{0}' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') ELSE CAST(whole AS VARCHAR) END"
STATEMENTS = f"""(SELECT k AS doc_id, o_custkey AS customer, '/finance/' || y || '/' || {_pick(STATEMENT_FILES, f'k % {len(STATEMENT_FILES)}')} || '_' || k || '.pdf' AS path, text, sha256(text) AS checksum FROM (SELECT *,
 CASE WHEN k % 12 = 8 THEN 'Maria Lopez' WHEN k % 4 = 0 THEN 'Invoice number ' || k WHEN k % 4 = 1 THEN 'Receipt of your order' WHEN k % 4 = 2 THEN 'Gross pay and net pay' ELSE 'Dear customer' END || chr(10) || 'Vendor: Firm ' || o_custkey || ' Ltd.' || chr(10) ||
 'Date: ' || CASE k % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') ELSE strftime(o_orderdate, '%B %-d, %Y') END || chr(10) ||
 'Sum due ' || CASE k % 3 WHEN 0 THEN 'EUR ' || {_GROUPED.format('.')} || ',' || part WHEN 1 THEN '$' || {_GROUPED.format(',')} || '.' || part ELSE {_GROUPED.format(',')} || '.' || part || ' USD' END || chr(10) ||
 CASE k % 5 WHEN 0 THEN 'Tax year ' || y || ' with vat of 19 percent' WHEN 1 THEN 'Refund of EUR 12,50 for the flight' WHEN 2 THEN 'Insurance premium of 99.95 EUR' ELSE 'Thank you' END AS text
 FROM (SELECT *, cents // 100 AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))))"""
FULLTEXT = f"""(SELECT doc_id, text, lang, source, sha256(text) AS checksum, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'docx' END AS ext,
 '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'docx' END AS path,
 CAST(strlen(text) AS BIGINT) AS size_bytes, CAST({BASE_S} + doc_id * 3600 AS BIGINT) AS modified_s FROM documents)"""
INVENTORY = f"""(SELECT path, source, modified_s, CASE WHEN doc_id % 17 <> 0 THEN size_bytes END AS size_bytes, doc_id % 10 <> 0 AS exists_now,
 CASE WHEN doc_id % 4 <> 0 THEN modified_s + (doc_id % 3 - 1) * 60 END AS last_indexed_s FROM {FULLTEXT})"""
HITS = f"""(SELECT doc_id % 20 AS query_id, doc_id AS id, checksum, path, modified_s, lang, (doc_id * 37 % 101) / 100.0::DOUBLE AS score_vector, (doc_id * 53 % 97) / 96.0::DOUBLE AS score_bm25,
 (doc_id % 7) / 4.0::DOUBLE - 0.25::DOUBLE AS authority_rank, CASE doc_id % 3 WHEN 0 THEN 'cv' WHEN 1 THEN 'other' ELSE 'invoice' END AS doc_type, 'person' || (doc_id * 7 % 5) AS person,
 CAST(doc_id * 11 % 4 AS INT) AS title_overlap, doc_id * 13 % 5 = 0 AS generic_title, doc_id * 17 % 6 = 0 AS artefact FROM {FULLTEXT})"""
RECORDS = """(SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, round(l_extendedprice, 2) AS amount, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year, c_name AS counterparty,
 CASE l_returnflag WHEN 'R' THEN 'refund' WHEN 'A' THEN 'payment' ELSE 'expense' END AS record_type, l_quantity / 50.0::DOUBLE AS confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
PAPERS = f"(SELECT doc_id, path, text FROM {FULLTEXT} UNION ALL SELECT -doc_id, path, text FROM {STATEMENTS})"
CATALOG = f"""(SELECT doc_id, text, checksum, modified_s, '/corpus/' || source || '/' || stem || '_' || doc_id || '.' || ext AS path, stem || '_' || doc_id || '.' || ext AS filename, CASE doc_id % 3 WHEN 0 THEN 'cv' WHEN 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'letter' ELSE 'other' END ELSE 'invoice' END AS doc_type,
 CASE WHEN doc_id % 3 = 0 THEN 'person' || (doc_id * 7 % 5) END AS person_name, (doc_id % 7) / 4.0::DOUBLE - 0.25::DOUBLE AS authority_rank, CASE WHEN doc_id % 2 = 0 THEN 'expense' WHEN doc_id % 5 = 1 THEN 'payment' END AS record_type FROM (SELECT *, {_pick(CATALOG_STEMS, f'doc_id % {len(CATALOG_STEMS)}')} AS stem FROM {FULLTEXT}))"""
ASKED = f"(SELECT item_id AS query_id, {_pick(LEAD_INS, f'item_id % {len(LEAD_INS)}')} || text AS text FROM benchmark)"
