"""Readers of files: text with unknown encodings, documents of several kinds, folder listings, question sets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order they are tried, and what a scan leaves out.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")
TEMPORARY = ("~$", ".~", "._")
PARTIAL = (".tmp", ".part", ".crdownload")
IGNORED = ("node_modules", "__pycache__", ".git")


def decoded(raw: bytes) -> str:
    """Text by the first encoding that fits; utf-16 only with its byte order mark."""
    for e in ENCODINGS:
        if e == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes) -> str:
    """The paragraphs of a word processor's file."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))


#: Loaders by extension: bytes to the texts of a file's pages. Others, such as one for PDF, are passed in by the caller.
LOADERS: dict[str, Callable[[bytes], list[str]]] = {"txt": lambda b: [decoded(b)], "md": lambda b: [decoded(b)], "docx": lambda b: [docx_text(b)]}


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md"), least_bytes: int = 0, with_checksum: bool = False, ignored: tuple[str, ...] = IGNORED, limit: int | None = None) -> DataFrame:
    """path, size, modified_at, ext (and checksum) of files, without hidden, temporary and partial ones and those in ignored folders. Contents are read only for checksums; limit takes the
    first files by path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    ok = ext.isin(*extensions) & (F.col("length") >= least_bytes) & ~name.startswith(".")
    for x in TEMPORARY:
        ok = ok & ~name.startswith(x)
    for x in PARTIAL:
        ok = ok & ~F.lower(name).endswith(x)
    ok = ok & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored or ("",))))
    cols = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "ext"]
    rows = df.withColumn("ext", ext).where(ok).select(*cols, *([F.sha2("content", 256).alias("checksum")] if with_checksum else []))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def documents(spark: SparkSession, path: str, loaders: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """path, page, text of the files whose extension has a loader. A file that a loader fails on gives no row, and so do others; a file is one row while it is read, so files are meant to fit a task."""
    import pyarrow as pa

    known = LOADERS | (loaders or {})

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(p, i, t) for i, t in enumerate(known[p.rpartition(".")[2].lower()](raw or b""))]
                except Exception:  # noqa: BLE001, S112 - any loader may fail in any way on a broken file
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "page", "text"])

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted(known)) + "}").load(path)
    return df.select("path", "content").mapInArrow(run, "path string, page int, text string")


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of each file; a file is one row, so files are meant to fit a task. Files of no bytes give no row."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", "content").mapInArrow(run, "path string, text string")


def coerced(raw: DataFrame) -> DataFrame:
    """text, metadata of loaders' outputs (page_content, text, content: the first that is there; metadata: a map; extra: keys beside them, which go into the metadata unless it has them)."""
    text = F.coalesce("page_content", "text", "content", F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    own, extra = F.coalesce("metadata", empty), F.coalesce("extra", empty)
    return raw.select("id", text.alias("text"), F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k)), own).alias("metadata"))


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file with one object over many lines: a row each, with the set's version."""
    q = "struct<id: string, mode: string, query: string, expected_doc_types: array<string>, expected_checksums: array<string>>"
    j = spark.read.option("multiLine", True).schema(f"meta struct<version: string>, queries array<{q}>").json(path)
    return j.select(F.col("meta.version").alias("version"), F.explode("queries").alias("q")).select("version", "q.*")
