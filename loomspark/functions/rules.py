"""Rules on paths and texts as Catalyst expressions: document types, persons, source families, signals and categories.

Word boundaries are ASCII's in Spark's expressions. Letters beyond ASCII are written as z before a rule with boundaries is tried, so that
they are letters there, as in Unicode's boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (type, where, pattern, confidence), first match wins.
DOC_RULES = (
    ("cover_letter", "path", r"cover[_\s-]*letter|motivation[_\s-]*letter", 0.98),
    ("reference_letter", "path", r"reference[_\s-]*letter|recommendation[_\s-]*letter", 0.98),
    ("cv", "path", r"cv|resume|curriculum[_\s-]*vitae", 0.97),
    ("cv", "text", "curriculum vitae|professional summary|work experience|employment history", 0.88),
    ("research_paper", "path", r"research[_\s-]*paper|journal[_\s-]*paper|conference[_\s-]*paper|paper", 0.95),
    ("research_paper", "text", "abstract|introduction|methodology|results|discussion|references|doi", 0.78),
    ("technical_report", "path", r"technical[_\s-]*report|project[_\s-]*report|feasibility[_\s-]*study|report", 0.94),
    ("technical_report", "text", "project report|technical report|system design|implementation|case study", 0.77),
    ("course_material", "path", "course|lecture|syllabus|slides|assignment|tutorial|module", 0.94),
    ("course_material", "text", "course code|lecture notes|syllabus|assignment|tutorial|semester", 0.76),
    ("contract", "path", r"contract|agreement|lease|terms[_\s-]*and[_\s-]*conditions", 0.96),
    ("contract", "text", "this agreement|party of the first part|terms and conditions|effective date", 0.80),
    ("policy", "path", "policy|guideline|compliance|handbook", 0.95),
    ("policy", "text", "policy statement|compliance|scope|purpose|applies to", 0.78),
    ("invoice", "path", "invoice|receipt|rechnung|bill", 0.96),
    ("invoice", "text", "invoice number|bill to|total due|vat|amount due", 0.82),
    ("payroll", "path", "payroll|payslip|salary|wage|lohnabrechnung|gehaltsabrechnung", 0.96),
    ("payroll", "text", "gross pay|net pay|salary statement|pay period|tax withheld", 0.82),
    ("insurance_letter", "path", "insurance|insurer|premium|claim|versicherung", 0.95),
    ("insurance_letter", "text", "policyholder|premium|coverage|claim number|insurance", 0.80),
    ("government_form", "path", "form|formular|jobcenter|government|behorde|behzrde|amt|application", 0.95),
    ("government_form", "text", "application form|jobcenter|antrag|kundennummer|case number|government office", 0.80),
    ("academic_record", "path", r"transcript|academic[_\s-]*record|certificate|diploma|grade[_\s-]*report", 0.96),
    ("academic_record", "text", "transcript|gpa|academic record|certificate|matriculation", 0.82),
)
DOC_SAMPLE, FAMILY_SAMPLE = 4000, 5000
AUTHORITY = (("cv", 1.0), ("cover_letter", 0.85), ("reference_letter", 0.8))
NAME_STOP = ("cv", "resume", "curriculum", "vitae", "cover", "letter", "motivation", "reference", "recommendation", "profile", "final", "draft", "v1", "v2", "copy")
NOT_A_NAME = ("curriculum vitae", "work experience", "professional summary", "employment history", "education", "skills", "profile", "summary")
NAME_LINE = r"^[A-Z][A-Za-z'`-]+(?:\s+[A-Z][A-Za-z'`-]+){1,3}$"
# Fixed values: (family, document types, parts of the path, parts of the text), any of which decides; first match wins.
FAMILY_RULES = (
    ("invoice", ("invoice",), ("invoice",), ()),
    ("receipt", (), ("receipt", "quittung"), ()),
    ("bank_statement", (), ("bank statement", "kontoauszug"), ("iban",)),
    ("payment_confirmation", (), ("payment confirmation",), ("payment received",)),
    ("tax_document", (), ("tax", "steuer"), ("tax return",)),
    ("school_fee_letter", (), ("tuition",), ("school fee", "semester fee")),
    ("official_letter", ("government_form", "insurance_letter", "payroll"), (), ()),
    ("course_material", ("course_material",), (), ()),
    ("publication", ("research_paper", "technical_report"), (), ()),
    ("cv", ("cv", "resume"), (), ()),
    ("reference", ("reference_letter",), (), ()),
)
BOOK = r"\b(book|ebook)\b"
TAX_SIGNAL = r"\b(tax|vat|deductible|expense|receipt|invoice|tuition|school fee|medical)\b"
PREFERRED = ("tax_document", "bank_statement", "receipt", "invoice", "payment_confirmation", "school_fee_letter", "official_letter")
SUPPRESSED = ("book", "course_material", "publication", "cv", "reference", "archive_misc")
CATEGORIES = (
    ("education", r"\b(tuition|school|university|course fee)\b"),
    ("medical", r"\b(medical|clinic|hospital|doctor|pharmacy)\b"),
    ("travel", r"\b(travel|flight|train|bus|ticket|hotel)\b"),
    ("insurance", r"\b(insurance|premium)\b"),
    ("housing", r"\b(rent|lease|housing|utilities?)\b"),
    ("professional", r"\b(software|subscription|equipment|office)\b"),
)


def ascii_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "z")


def ascii_words(text: Column) -> Column:
    return ascii_letters(F.lower(text))


def path_words(path: Column) -> Column:
    return F.regexp_replace(ascii_words(path), r"[_/\\.\-]+", " ")


def first_of(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(c, v) for c, v in cases], otherwise)


def with_doc_type(docs: DataFrame) -> DataFrame:
    """docs (path, text) with doc_type, confidence and source: the first rule on the path's words or the text's start that fits. What the rules look at is made once a row."""
    look = docs.withColumn("_path", path_words(F.col("path"))).withColumn("_text", ascii_words(F.substring(F.coalesce("text", F.lit("")), 1, DOC_SAMPLE)))
    # the first rule's number, then what it says
    rule = F.coalesce(*[F.when(F.col("_" + w).rlike(rf"\b({p})\b"), F.lit(i)) for i, (_, w, p, _c) in enumerate(DOC_RULES)], F.lit(len(DOC_RULES)))
    kinds = F.array(*[F.lit(r[0]) for r in DOC_RULES], F.lit("other"))
    sure = F.array(*[F.lit(r[3]) for r in DOC_RULES], F.lit(0.25))
    out = look.withColumn("_rule", rule).drop("_path", "_text")
    return out.withColumn("doc_type", F.get(kinds, F.col("_rule"))).withColumn("confidence", F.get(sure, F.col("_rule"))).withColumn("source", F.when(F.col("_rule") < len(DOC_RULES), "rule").otherwise("fallback")).drop("_rule")


def authority(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in AUTHORITY])


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]+"), -1)


def file_persons(docs: DataFrame) -> DataFrame:
    """doc_id, person: the first two or three parts of the file's name that can be a person's, up to a part that can't once there are two."""
    stem = F.regexp_replace(filename(F.col("path")), r"\.[^.]*$", "")
    rows = docs.select("doc_id", F.posexplode(F.split(stem, "[^A-Za-z0-9]+")).alias("i", "part"))
    letters = F.regexp_replace("part", "[^A-Za-z]", "")
    stop = F.lower("part").isin(*NAME_STOP) | F.col("part").rlike("^[0-9]+$")
    rows = rows.select("doc_id", "i", letters.alias("letters"), stop.alias("stop"), (~stop & F.col("part").rlike("^[A-Za-z]") & (F.length(letters) >= 2)).alias("ok"))
    before = F.count_if("ok").over(Window.partitionBy("doc_id").orderBy("i"))
    rows = rows.withColumn("n", before).withColumn("done", F.max((F.col("stop") & (F.col("n") >= 2)).cast("int")).over(Window.partitionBy("doc_id").orderBy("i")))
    names = rows.where("ok and done = 0 and n <= 3").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.initcap("letters").alias("w")))), lambda x: x["w"]).alias("w"))
    return names.where("size(w) >= 2").select("doc_id", F.array_join("w", " ").alias("person"))


def text_person(text: Column) -> Column:
    """The first of the text's first twelve lines that looks like a person's name."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 12), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: (F.length(x) <= 60) & ~F.lower(x).isin(*NOT_A_NAME) & x.rlike(NAME_LINE)), F.lit(0))


def with_family(docs: DataFrame) -> DataFrame:
    """docs (path, text, doc_type) with family, the kind of source that financial facts may come from."""
    look = docs.withColumn("_path", F.lower("path")).withColumn("_text", F.lower(F.substring(F.coalesce("text", F.lit("")), 1, FAMILY_SAMPLE)))

    def fits(kinds: tuple, in_path: tuple, in_text: tuple) -> Column:
        out = F.col("doc_type").isin(*kinds) if kinds else F.lit(False)
        for x in in_path:
            out = out | F.col("_path").contains(x)
        for x in in_text:
            out = out | F.col("_text").contains(x)
        return out

    cases = [(fits(*r[1:]), F.lit(r[0])) for r in FAMILY_RULES] + [(ascii_letters(F.col("_path")).rlike(BOOK), F.lit("book")), (ascii_letters(F.col("_text")).rlike(TAX_SIGNAL), F.lit("official_letter"))]
    return look.withColumn("family", first_of(*cases, otherwise=F.lit("archive_misc"))).drop("_path", "_text")


def tax_signals(text: Column) -> Column:
    """Distinct signal words in the order they come."""
    return F.array_distinct(F.regexp_extract_all(ascii_words(F.coalesce(text, F.lit(""))), F.lit(TAX_SIGNAL), 1))


def expense_category(text: Column) -> Column:
    t = ascii_words(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for n, p in CATEGORIES])


def record_type(family: Column, text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("refund"), "refund").when(t.contains("tax"), "tax_payment").when(family.isin("receipt", "invoice", "school_fee_letter"), "expense").when(family.isin("payment_confirmation", "bank_statement"), "payment").otherwise("financial_event")
