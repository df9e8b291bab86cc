"""Families and financial records of papers, in Arrow batches. Patterns run in RE2, as those of the SQL do, each once over a column; a document's records are merged where it is read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as mo
from ..functions import rules as ru

CHUNK, STEP, AROUND, LINKS = 120, 90, 60, 50
#: Bytes that are looked at together.
TOGETHER = 8_000_000
RECORD = "merge_key string, record_type string, date string, amount double, currency string, counterparty string, family string, confidence double, n_links long"

_ISO, _DMY, _NAMED = (re.compile(p, re.A) for p in (r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})([./-])(\d{1,2})([./-])(\d{4}|\d{2})", r"([a-z]+) (\d{1,2}),? (\d{4})"))
_NUMBER, _CENTS, _NO_SIGN = re.compile(mo.NUMBER, re.A), re.compile(r",[0-9]{1,2}\Z"), re.compile(r"[\d.,\s]", re.A)
_NUMBER_OF_MONTH = {k: i + 1 for i, m in enumerate(mo.MONTHS) for k in (m, m[:3])}
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_PARTY = mo.COUNTERPARTY.replace("([A-Z]", "(?P<p>[A-Z]", 1)


def _ascii(x: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(x, r"[^\x00-\x7F]", "z")


def _true(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, False).to_numpy(zero_copy_only=False)


def doc_types(path: pa.Array, text: pa.Array) -> np.ndarray:
    """As rules.with_doc_type."""
    look = {"path": pc.replace_substring_regex(_ascii(pc.utf8_lower(path)), r"[_/\\.\-]+", " "), "text": _ascii(pc.utf8_lower(pc.utf8_slice_codeunits(text, 0, ru.DOC_SAMPLE)))}
    out, left = np.full(len(path), "other", object), np.arange(len(path))
    for kind, where, pattern, _ in ru.DOC_RULES:
        hit = _true(pc.match_substring_regex(look[where], rf"\b({pattern})\b"))
        if hit.any():
            out[left[hit]], left = kind, left[~hit]
            look = {k: c.filter(pa.array(~hit)) for k, c in look.items()}
    return out


def families(path: pa.Array, text: pa.Array) -> np.ndarray:
    """As rules.with_family after rules.with_doc_type; a null text is empty."""
    kinds, path, text = doc_types(path, text), pc.utf8_lower(path), pc.utf8_lower(pc.utf8_slice_codeunits(text, 0, ru.FAMILY_SAMPLE))
    cases = []
    for name, types, in_path, in_text in ru.FAMILY_RULES:
        fits = np.isin(kinds, types) if types else np.zeros(len(kinds), bool)
        for column, parts in ((path, in_path), (text, in_text)):
            for x in parts:
                fits |= _true(pc.match_substring(column, x))
        cases.append((fits, name))
    cases += [(_true(pc.match_substring_regex(_ascii(path), ru.BOOK)), "book"), (_true(pc.match_substring_regex(_ascii(text), ru.TAX_SIGNAL)), "official_letter")]
    out = np.full(len(kinds), "archive_misc", object)
    for fits, name in reversed(cases):
        out[fits] = name
    return out


def _pieces(text: pa.Array, pattern: str) -> pa.Array:
    """Each text cut at its matches: every other piece is a match. A mark that stands in a text gives way to another sign of its kind, which is no more of a word, space or number than it was."""
    marked = pc.replace_substring_regex(pc.replace_substring(text, "\x01", "\x03"), f"({pattern})", "\x01\\1\x01")
    return pc.split_pattern(marked, "\x01")


@lru_cache(1 << 16)
def day(token: str) -> str | None:
    """As money.date_of."""
    if m := _ISO.fullmatch(token):
        y, mo_, d = m.groups()
    elif (m := _DMY.fullmatch(token)) and m[2] == m[4]:
        d, mo_, y = m[1], m[3], m[5] if len(m[5]) == 4 else ("19" if m[5] >= str(mo.PIVOT) else "20") + m[5]
    elif (m := _NAMED.fullmatch(token)) and m[1] in _NUMBER_OF_MONTH:
        mo_, d, y = _NUMBER_OF_MONTH[m[1]], m[2], m[3]
    else:
        return None
    y, mo_, d = int(y), int(mo_), int(d)
    leap = mo_ == 2 and y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return f"{y:04}-{mo_:02}-{d:02}" if 1 <= mo_ <= 12 and 1 <= d <= _DAYS[mo_ - 1] + leap else None


def first_days(text: pa.Array) -> list[str | None]:
    """The earliest date of each text."""
    out = []
    for p in _pieces(_ascii(pc.utf8_lower(text)), mo.DATE).to_pylist():
        found = [x for t in p[1::2] if (x := day(" ".join(t.split())))]
        out.append(min(found) if found else None)
    return out


def value(span: str) -> float | None:
    """The number of an amount with European or American marks; null where it is none or not positive."""
    raw = _NUMBER.search(span)[0]
    if "," in raw and "." in raw:
        raw = raw.replace(".", "").replace(",", ".") if raw.rindex(",") > raw.rindex(".") else raw.replace(",", "")
    else:
        raw = raw.replace(",", "." if _CENTS.search(raw) else "")
    try:
        return x if (x := float(raw)) > 0 else None
    except ValueError:
        return None


def currency(span: str) -> str:
    sign = _NO_SIGN.sub("", span).upper()
    return dict(mo.SIGNS).get(sign, sign or "UNKNOWN")


def parties(text: pa.Array) -> list[str | None]:
    """As money.counterparty."""
    raw = pc.struct_field(pc.extract_regex(text, _PARTY), "p")
    for p, to in ((r"\s+", " "), (r"^[ ,.;:]+", ""), (r"[ ,.;:]+$", "")):
        raw = pc.replace_substring_regex(raw, p, to)
    return [x or None for x in raw.to_pylist()]


def records_of(text: pa.Array, family: np.ndarray) -> list[tuple]:
    """Place of the text, then the columns of RECORD: amounts of overlapping chunks with the chunk's earliest date (else the text's), merged. The first chunk's amount counts; links are distinct evidence."""
    texts = text.to_pylist()
    cuts = [(d, k, t[a : a + CHUNK]) for d, (t, f) in enumerate(zip(texts, family, strict=True)) if f not in ru.SUPPRESSED for k, a in enumerate(range(0, max(len(t), 1), STEP))]
    chunk = pa.array([c for _, _, c in cuts], pa.string())
    pieces = _pieces(chunk, mo.AMOUNT)
    has = pc.greater(pc.list_value_length(pieces), 1)
    cuts, chunk, pieces = [c for c, h in zip(cuts, has.to_pylist(), strict=True) if h], chunk.filter(has), pieces.filter(has)
    low, dates = pc.utf8_lower(chunk), first_days(chunk)
    dateless = list(dict.fromkeys(d for (d, _, _), x in zip(cuts, dates, strict=True) if x is None))
    days = dict(zip(dateless, first_days(text.take(pa.array(dateless, pa.int64()))), strict=True))
    found: dict[tuple[int, str], list] = {}
    for (d, k, t), parts, date, party, refund, tax in zip(cuts, pieces.to_pylist(), dates, parties(chunk), pc.match_substring(low, "refund").to_pylist(), pc.match_substring(low, "tax").to_pylist(), strict=True):
        date = date or days[d]
        if date is None:
            continue
        f = family[d]
        kind = "refund" if refund else "tax_payment" if tax else "expense" if f in ("receipt", "invoice", "school_fee_letter") else "payment" if f in ("payment_confirmation", "bank_statement") else "financial_event"
        start = 0
        for i, span in enumerate(parts):
            if i % 2 and (amount := value(span)):
                sign = currency(span)
                key = d, f"{kind}|{date}|{amount:.2f}|{sign}|{_lower(party) if party else ''}"
                evidence = k, t[max(start - AROUND, 0) : start + len(span) + AROUND].strip(" ")
                if r := found.get(key):
                    r[-1].add(evidence)
                    if party and party < r[4]:
                        r[4] = party
                else:
                    found[key] = [kind, date, amount, sign, party, f, 0.8 if party else 0.72, {evidence}]
            start += len(span)
    return [(d, key, *r[:-1], min(len(r[-1]), LINKS)) for (d, key), r in found.items()]


def _lower(x: str) -> str:
    return x.lower() if x.isascii() else pc.utf8_lower(pa.scalar(x)).as_py()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, b.num_rows * TOGETHER // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    text = pc.fill_null(b.column("text"), "")
    family = families(b.column("path"), text)
    return family, records_of(text, family)


_KINDS = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _rows(b: pa.RecordBatch, own: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """The batch's own columns beside rows that begin with their place in it."""
    at, *columns = zip(*rows, strict=True)
    taken = [b.column(c).take(pa.array(at, pa.int64())) for c in own]
    return pa.RecordBatch.from_arrays(taken + [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[*own, *_NAMES])


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _bounded(batches):
        if rows := _read(b)[1]:
            yield _rows(b, ["doc_id", "checksum"], rows)


def merged(rows: DataFrame) -> DataFrame:
    """Rows of records, one for each document and merge key: rows that repeat a document have the same records, which are one."""
    same = [F.min(c).alias(c) for c in ("record_type", "date", "amount", "currency", "counterparty", "family", "confidence", "n_links")]
    return rows.groupBy("doc_id", "checksum", "merge_key").agg(*same).withColumn("year", F.substring("date", 1, 4).cast("int"))


def records(docs: DataFrame) -> DataFrame:
    """Records of statements (doc_id, checksum, path, text), merged."""
    return merged(docs.select(F.col("doc_id").cast("long"), "checksum", "path", "text").mapInArrow(_record_rows, f"doc_id long, checksum string, {RECORD}"))


def _cover_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _bounded(batches):
        family, rows = _read(b)
        has = np.zeros(b.num_rows, bool)
        has[[r[0] for r in rows]] = True
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("customer"), pa.array(~np.isin(family, ru.SUPPRESSED)), pa.array(has)], names=["doc_id", "customer", "open", "has"])


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, customer, open, has of each row of docs (doc_id, customer, path, text): whether its family can hold financial papers, and whether it has records."""
    return docs.select(F.col("doc_id").cast("long"), F.col("customer").cast("long"), "path", "text").mapInArrow(_cover_rows, "doc_id long, customer long, open boolean, has boolean")


def _paper_rows(year: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ["doc_id", "customer", "path", "checksum"]
        for b in _bounded(batches):
            rows = _read(b)[1]
            if rows:
                yield _rows(b, own, rows)
            bare = np.ones(b.num_rows, bool)
            bare[[r[0] for r in rows]] = False
            at = np.flatnonzero(bare)
            text = pc.fill_null(b.column("text"), "").take(pa.array(at))
            fits = _true(pc.match_substring_regex(text, rf"\b{year}\b")) | ~_true(pc.match_substring_regex(text, r"\b(?:19|20)[0-9]{2}\b"))
            at, text = at[fits], text.filter(pa.array(fits))
            spans = [next((x for s in p[1::2] if (x := (value(s), currency(s)))[0]), None) for p in _pieces(text, mo.AMOUNT).to_pylist()]
            rows = [(int(d), None, None, day_, s[0], s[1], None, None, None, None) for d, day_, s in zip(at, first_days(text), spans, strict=True) if s]
            if rows:
                yield _rows(b, own, rows)

    return run


def papers(docs: DataFrame, year: int) -> DataFrame:
    """doc_id, customer, path, checksum and the columns of RECORD, of docs (these and text): records, not merged; of a row without any that names the year, or no year, its first amount and earliest date, without a merge_key."""
    return docs.select(F.col("doc_id").cast("long"), F.col("customer").cast("long"), "path", "checksum", "text").mapInArrow(_paper_rows(year), f"doc_id long, customer long, path string, checksum string, {RECORD}")
