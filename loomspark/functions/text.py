"""Text rules as Catalyst expressions: document types, years, tax signals, source families, chunk windows, amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def years(text: Column) -> Column:
    """Sorted distinct years 1900 to 2099."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda x: x.cast("int"))))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 3000, "short").when(n <= 20000, "medium").otherwise("long")


def chunk_profile(kind: Column) -> Column:
    return F.when(kind == "txt", "400/50").when(kind == "pdf", "600/80").otherwise("800/100")


def fixed_windows(docs: DataFrame, size: int | Column = 800, step: int | Column = 700, *more: str) -> DataFrame:
    """doc_id, more columns of docs, chunk_index, chunk, location_percent. Sizes and steps may differ by row. A null text has no chunk, an empty one an empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    rows = docs.where("text is not null").select("doc_id", *more, "text", F.lit(size).alias("_size"), F.size(starts).alias("n"), F.posexplode(starts).alias("chunk_index", "s"))
    return rows.select("doc_id", *more, F.col("chunk_index").cast("long"), F.substring("text", F.col("s") + 1, F.col("_size")).alias("chunk"), F.round(100.0 * F.col("chunk_index") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("location_percent"))


def split_recursively(text: str, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that does; neighbours share up to overlap characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    parts = [p for p in text.split(sep) if p] if sep else [text[i : i + 1] for i in range(len(text))]
    out: list[str] = []
    held: list[str] = []

    def length(xs: list[str]) -> int:
        return sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)

    def close() -> None:
        if held and (joined := sep.join(held).strip()):
            out.append(joined)

    for p in parts:
        if len(p) > size:
            close()
            held.clear()
            out += split_recursively(p, size, overlap, rest or ("",))
            continue
        if held and length([*held, p]) > size:
            close()
            while held and (length(held) > overlap or length([*held, p]) > size):
                held.pop(0)
        held.append(p)
    close()
    return out


def recursive_chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_index, chunk by split_recursively, in Arrow batches."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(split_recursively(t or "", size, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "chunk_index", "chunk"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, chunk_index long, chunk string")


def amount(text: Column) -> Column:
    """A positive number from text with European or American separators; null otherwise."""
    s = F.regexp_replace(text, r"[^0-9.,]", "")
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    both = s.contains(",") & s.contains(".")
    plain = F.when(both & (comma > dot), F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).when(both, F.regexp_replace(s, ",", "")).when(s.rlike(r",[0-9]{1,2}$"), F.regexp_replace(s, ",", ".")).otherwise(F.regexp_replace(s, ",", ""))
    v = plain.try_cast("double")
    return F.when(v > 0, v)


def highlighted(text: Column, terms: list[str], size: int = 200) -> Column:
    """The text around its first term, HTML-escaped, with terms in <mark>; its start where no term occurs."""
    pattern = "(?i)\\b(" + "|".join(terms) + ")\\b"
    at = F.greatest(F.regexp_instr(text, F.lit(pattern)) - 40, F.lit(1))
    escaped = F.replace(F.replace(F.replace(F.substr(text, at, F.lit(size)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(escaped, pattern, "<mark>$1</mark>")
