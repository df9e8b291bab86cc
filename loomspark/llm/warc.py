"""WARC archives without repeated payloads: headers are shuffled by payload digest, all but one record of a payload become revisit records that
name the original response, and archives are written with fresh headers. Reading joins revisits to their responses again.

Archives are gzip files of WARC/1.1 records that Spark's text writer writes and commits, so a lost executor leaves no half-written record. A
file is read by one task from start to end, as a stream cut where a record may begin; Content-Length decides where a record ends, so payloads may hold anything.

Payloads don't move to find their equals: the shuffle has headers only, dealt by digest and a salt, so that a payload of a third of
all pages stays spread. Payloads are equal if SHA-1, length and a second hash are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, looked_up, map_arrow, new_path, read_table, small, stored

VERSION, CRLF = "WARC/1.1", "\r\n"
#: What stands between two records of a file.
BETWEEN = CRLF * 2
#: Payloads of fewer bytes are always written as responses.
LEAST_BYTES = 0
#: The header field that carries a page's number.
PAGE_FIELD = "X-Page-ID"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in upper-case base 32: eight digits for each ten of hex."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_row_ids(pages: DataFrame, row_id: Column | None = None) -> DataFrame:
    """page_id, url, payload (null: empty) and rid, which tells rows apart, those that are equal too. row_id has to give a row the same value
    each time it is read; without it the rows are stored first, and their places in the stored files are it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), *([] if row_id is None else [row_id.alias("rid")]))
    return rows if row_id is not None else stored(rows, "pages").withColumn("rid", place())


def place() -> Column:
    """A row's file and number, for a table read from Parquet files."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def resolve(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The rows of heads (rid, page_id, url, key, digest, n_bytes) that revisit another: with r_rid, r_page_id, r_url of the row with the largest page_id
    (null the least; of equals the largest rid) among those with their key. Payloads under least_bytes never revisit.

    A key's rows are counted in SALTS parts before these meet, and the response's row is copied to the parts that exist.
    """
    rows = heads.where(F.col("n_bytes") >= least_bytes).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    parts = rows.groupBy("key", "salt").agg(F.max(F.struct("page_id", "rid", "url")).alias("m"), F.count("*").alias("n"))
    best = parts.groupBy("key").agg(F.max("m").alias("m"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    best = best.select("key", F.explode("salts").alias("salt"), F.col("m.rid").alias("r_rid"), F.col("m.page_id").alias("r_page_id"), F.col("m.url").alias("r_url"))
    return rows.join(best, ["key", "salt"]).where("rid <> r_rid").drop("salt")


def _record_id(rid: Column, run: str) -> Column:
    h = F.md5(F.concat(F.lit(run), rid))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _uri(url: Column) -> Column:
    """A url that can't end its header line: white space and control characters are escaped."""
    for c in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def _field(name: str, value: Column | str) -> Column:
    """One header line; none for a null value."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: str, run: str, fields: list[Column], n_block: Column, block: Column) -> Column:
    head = [F.lit(VERSION + CRLF), _field("WARC-Type", kind), _field("WARC-Record-ID", _record_id(F.col("rid"), run)), _field("WARC-Date", DATE), _field("WARC-Target-URI", _uri(F.col("url"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    head += [*fields, _field(PAGE_FIELD, F.col("page_id").cast("string")), _field("Content-Type", "application/http; msgtype=response"), _field("Content-Length", n_block.cast("string"))]
    return F.concat(*[F.encode(x, "UTF-8") for x in (*head, F.lit(CRLF))], block)


def write_archives(pages: DataFrame, path: str, row_id: Column | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html; null html: empty) to gzip files in path: a response, or a revisit where resolve finds one.

    Of equal rows one is the response. A null url or page_id has no header field. The responses' payloads are read a second time; they are
    shuffled only where the list of revisits is too large to be broadcast (small). An empty table gives files without records.
    """
    rows = with_row_ids(pages, row_id)
    n, digest = F.octet_length("payload").cast("long"), base32_sha1(F.col("payload"))
    heads = stored(rows.select("rid", "page_id", "url", digest.alias("digest"), n.alias("n_bytes"), F.concat_ws(":", digest, n, F.xxhash64("payload")).alias("key")), "heads")
    again, run, head = stored(resolve(heads, least_bytes), "revisits"), uuid.uuid4().hex, F.lit(HTTP_HEAD.encode())
    first = rows.join(small(again.select("rid")), "rid", "left_anti").withColumn("digest", digest)
    responses = first.select(_record("response", run, [], n + len(HTTP_HEAD), F.concat(head, F.col("payload"))).alias("value"))
    original = [_field("WARC-Refers-To", _record_id(F.col("r_rid"), run)), _field("WARC-Refers-To-Target-URI", _uri(F.col("r_url"))), _field("WARC-Refers-To-Date", DATE), _field("WARC-Profile", PROFILE)]
    revisits = again.select(_record("revisit", run, original, F.lit(len(HTTP_HEAD)), head).alias("value"))
    # the writer ends each value with what has to stand behind a record
    responses.unionByName(revisits).select(F.col("value").cast("string")).write.option("lineSep", BETWEEN).option("compression", "gzip").text(path)


def _parsed(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record from a file's pieces, which are cut wherever a record may begin: a piece that ends before the
    header or the block's Content-Length does goes on in the next."""
    start, cut, gap = (VERSION + CRLF).encode(), (BETWEEN + VERSION + CRLF).encode(), BETWEEN.encode()
    # need: bytes that the open block lacks, or its header if fields is None; nothing is open after a whole record
    file, is_open, fields, held, need = None, False, None, [], 0
    for now, piece in pieces:
        if now != file:
            if is_open:
                raise ValueError(f"{file} ends inside a record")
            file = now
            if not piece:
                continue
            if not piece.startswith(start):
                raise ValueError(f"{file} doesn't begin with a record")
        else:
            piece = (cut if is_open else start) + piece
        if not is_open:
            is_open, fields, held = True, None, []
        if fields is None:
            head, ends, rest = b"".join([*held, piece]).partition(gap)
            if not ends:
                held = [head]
                continue
            fields, held, piece = _parsed(head), [], rest
            need = int(fields["content-length"])
        held.append(piece)
        need -= len(piece)
        if need <= 0:
            whole, size = b"".join(held), int(fields["content-length"])
            # only what ends a file may stand behind a block
            if whole[size:] not in (b"", gap):
                raise ValueError(f"{file}: a record is longer than its Content-Length")
            is_open = False
            yield fields, whole[:size]
    if is_open:
        raise ValueError(f"{file} ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """record_id, type, page_id, uri, refers_to, digest, n_bytes (and payload) of every record in path. A response's digest and bytes are those of the stored
    payload, and a digest that its header doesn't have is an error; a revisit has its header's digest, and null bytes."""
    cut = spark.read.option("lineSep", BETWEEN + VERSION + CRLF).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    names = ["record_id", "type", "page_id", "uri", "refers_to", "digest", "n_bytes", *["payload"] * payloads]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for f, block in _records((p for b in batches for p in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))):
            page, digest, n, payload = f.get(PAGE_FIELD.lower()), f.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
            if f["warc-type"] == "response":
                payload = block.partition(BETWEEN.encode())[2]
                n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest not in ("", found):
                    raise ValueError(f"{f['warc-record-id']}: payload and digest differ")
                digest = found
            out.append((f["warc-record-id"], f["warc-type"], None if page is None else int(page), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, n, *[payload] * payloads))
            size += len(payload or b"") * payloads
            if len(out) >= 4096 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return map_arrow(cut, run, "record_id string, type string, page_id long, uri string, refers_to string, digest string, n_bytes long" + ", payload binary" * payloads)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read_archives' records: revisits are joined to the responses that they
    refer to, spread over SALTS parts each. A revisit of a response that isn't there keeps its header's digest and has null bytes."""
    originals = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("n_bytes").alias("r_bytes"), F.col("digest").alias("r_digest"), F.col("page_id").alias("r_page_id"))
    revisits = looked_up(records.where("type = 'revisit'"), originals, "refers_to", F.col("record_id"))
    return records.where("type = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.coalesce("r_digest", "digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("r_page_id").alias("refers_to"))
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record is read back from the deduplicated archives: resolved(read_archives)."""
    path = new_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path, place())
    return resolved(stored(read_archives(spark, path), "records"))


QUERIES = {"op11_warc": op11_warc}
_DIGEST = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), 'string_agg', '')"
SQL = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS r_page FROM p)
SELECT page_id, n AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN r_page END AS refers_to FROM r""",
}
