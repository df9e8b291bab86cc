"""Amounts, dates and counterparties in texts as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ascii_words
from .text import amount

# What an amount, a date and a counterparty look like.
_NUMBER = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?"
_CURRENCY = r"EUR|USD|GBP|CHF|€|\$|£"
AMOUNT = rf"(?i)(?:{_CURRENCY})\s*{_NUMBER}|{_NUMBER}\s*(?:{_CURRENCY})"
NUMBER = _NUMBER
SIGNS = (("€", "EUR"), ("$", "USD"), ("£", "GBP"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE = rf"(?i)\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b|\b\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}\b|\b(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{2,4}}\b"
COUNTERPARTY = r"(?i)(?:payee|merchant|vendor|recipient|to|from)\s*[:\-]?\s*([A-Z][A-Za-z0-9&.,'() \-]{2,80})"
#: Two-digit years from this one on are of the last century.
PIVOT = 69


def currency(span: Column) -> Column:
    """The ISO code of a span's sign or code; UNKNOWN without one."""
    raw = F.upper(F.regexp_replace(span, r"[\d.,\s]", ""))
    return F.coalesce(*[F.when(raw == k, F.lit(v)) for k, v in SIGNS], F.when(raw == "", "UNKNOWN").otherwise(raw))


def amounts(text: Column) -> Column:
    """array of struct(span, amount, currency, start) in the order they stand; start counts from 0."""
    t = F.coalesce(text, F.lit(""))
    spans, between = F.regexp_extract_all(t, F.lit(AMOUNT), 0), F.split(t, AMOUNT, -1)
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    found = F.transform(spans, lambda s, i: F.struct(s.alias("span"), amount(F.regexp_extract(s, NUMBER, 0)).alias("amount"), currency(s).alias("currency"), (length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(spans, F.lit(1), i))).alias("start")))
    return F.filter(found, lambda x: x["amount"].isNotNull())


def _day(y: Column, m: Column, d: Column) -> Column:
    """The ISO date, null where there is no such day."""
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string")


def date_of(token: Column) -> Column:
    """A date token, in small letters and with single spaces, as an ISO date: year first, day first with one kind of mark, or a month's name; null for others."""
    t = token
    part = lambda p, i: F.regexp_extract(t, p, i)
    iso, dmy, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})([./-])(\d{1,2})([./-])(\d{4}|\d{2})$", r"^([a-z]+) (\d{1,2}),? (\d{4})$"
    year = part(dmy, 5)
    full = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year >= str(PIVOT), "19").otherwise("20"), year))
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for k in dict.fromkeys((m, m[:3])) for x in (k, str(i + 1))])
    month = F.element_at(names, part(named, 1))
    return F.when(t.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(dmy) & (part(dmy, 2) == part(dmy, 4)), _day(full, part(dmy, 3), part(dmy, 1))).when(t.rlike(named) & month.isNotNull(), _day(part(named, 3), month, part(named, 2)))


def date_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(ascii_words(F.coalesce(text, F.lit(""))), F.lit(DATE), 0)
    return F.transform(found, lambda t: F.regexp_replace(t, r"\s+", " "))


def dates(text: Column) -> Column:
    """Sorted distinct ISO dates."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(date_tokens(text), date_of), lambda x: x.isNotNull())))


def counterparty(text: Column) -> Column:
    """The name after a word such as vendor or to; null without one."""
    raw = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), COUNTERPARTY, 1), r"\s+", " ")
    name = F.regexp_replace(F.regexp_replace(raw, r"^[ ,.;:]+", ""), r"[ ,.;:]+$", "")
    return F.when(name != "", name)


def tax_years(years: Column, text: Column) -> Column:
    """Years that stand within twenty characters of a word of tax."""
    t = F.lower(text)
    word = r"\b(tax|steuer|vat)\b"
    return F.filter(years, lambda y: F.regexp_like(t, F.concat(F.lit(r"\b"), y.cast("string"), F.lit(r"\b.{0,20}" + word + "|" + word + r".{0,20}\b"), y.cast("string"), F.lit(r"\b"))))
