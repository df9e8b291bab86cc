"""Media columns: GIF. Decodes LZW code streams, applies palettes, disposal and transparency, and stores timed frames.

Encoding exists to store payloads losslessly. It builds a dictionary as usual, one byte at a time; compress=False writes
literal codes with regular clear codes (a valid LZW stream of constant width, built with array operations). The decoder reads
any GIF87a/GIF89a stream: runs that hold literals only are decoded as arrays, others code by code. How wide a code is hangs only
on its place after a clear, so that codes are packed and unpacked as arrays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, map_arrow, read_table

WIDTH, FRAME_ROWS, DELAY_CS = 192, 256, 10
#: Literals after which the encoder clears, while codes are still nine bits wide.
RUN = 248


@dataclass
class Frame:
    """A decoded frame. samples: palette indexes of the frame's own rectangle; canvas: RGB of the whole screen as shown."""

    left: int
    top: int
    samples: np.ndarray
    canvas: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int
    starts_ms: int = 0


def _pack9(codes: np.ndarray) -> bytes:
    """Codes of nine bits, least significant bit first. Eight codes fill nine bytes."""
    c = np.zeros(-(-len(codes) // 8) * 8, np.uint16)
    c[: len(codes)] = codes
    c = c.reshape(-1, 8)
    out = np.zeros((len(c), 9), np.uint16)
    for k in range(8):
        out[:, k] |= c[:, k] << k
        out[:, k + 1] |= c[:, k] >> (8 - k)
    return out.astype(np.uint8).tobytes()[: -(-len(codes) * 9 // 8)]


def _unpack9(data: bytes) -> np.ndarray:
    n = len(data) * 8 // 9
    raw = np.zeros(-(-n // 8) * 9 + 9, np.uint16)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = raw[: -(-n // 8) * 9].reshape(-1, 9)
    out = np.empty((len(raw), 8), np.uint16)
    for k in range(8):
        out[:, k] = ((raw[:, k] >> k) | (raw[:, k + 1] << (8 - k))) & 511
    return out.ravel()[:n]


def lzw_literal(samples: np.ndarray) -> bytes:
    n = len(samples)
    rows = max(1, -(-n // RUN))
    codes = np.zeros((rows, RUN + 1), np.uint16)
    codes[:, 0] = 256
    flat = np.zeros(rows * RUN, np.uint16)
    flat[:n] = samples
    codes[:, 1:] = flat.reshape(rows, RUN)
    codes = codes.ravel()[: n + rows]
    return _pack9(np.append(codes, np.uint16(257)))


def _widths(min_size: int) -> np.ndarray:
    """Bits of the code at each place after a clear, up to the place from which on all have twelve."""
    known = (1 << min_size) + 1 + np.arange(4096)
    return np.clip(np.frexp(known)[1], min_size + 1, 12).astype(np.int64)


#: A clear follows so many codes: the dictionary is full then.
FULL = 4096 - 258 + 1
_OWN = np.append(_widths(8)[:FULL], 12)


def lzw_compress(samples: np.ndarray) -> bytes:
    """The usual growing dictionary with code widths from 9 to 12 bits."""
    codes: list[int] = []
    put, table, nxt, prefix = codes.append, {}, 258, -1
    get = table.get
    for k in samples.tolist():
        key = prefix << 8 | k
        known = get(key) if prefix >= 0 else k
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            put(256)
            table.clear()
            nxt = 258
        prefix = k
    if prefix >= 0:
        put(prefix)
    put(257)
    c = np.array(codes, np.int64)
    at = np.append(9, np.resize(_OWN, len(c))).cumsum()
    c, start, size = np.append(256, c), np.append(0, at[:-1]), -(-int(at[-1]) // 8)
    c <<= start & 7
    # a code is in three bytes at most, and no two codes share a bit
    out = sum(np.bincount((start >> 3) + i, (c >> (8 * i)) & 255, size + 2) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, min_size: int, n: int) -> np.ndarray:
    """The first n samples of a code stream. A stream that ends early gives fewer; a bad code raises ValueError."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    if min_size == 8:
        codes = _unpack9(data)
        at = np.flatnonzero(codes == clear)
        stop = np.flatnonzero(codes == end)
        last = int(stop[0]) if len(stop) else len(codes)
        at = at[at < last]
        runs = np.diff(np.append(at, last))
        # codes are nine bits wide as long as a clear is followed by at most 254 literals
        if len(at) and at[0] == 0 and runs.max() <= 255 and not (codes[:last] > end).any():
            keep = codes[:last]
            return keep[keep < clear].astype(np.uint8)[:n]
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, table, prev, held, at, grown = [], list(base), None, 0, 0, _widths(min_size)
    widths = grown
    while held < n:
        # codes up to the next clear
        ends = at + np.cumsum(widths)
        w = widths[: int(np.searchsorted(ends, len(data) * 8, "right"))]
        start = ends[: len(w)] - w
        b = start >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (start & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        last = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:last].tolist():
            if code < len(table):
                entry = table[code]
            elif prev is not None and code == len(table):
                entry = prev + prev[:1]
            elif sum(map(len, out)) >= n:
                break
            else:
                raise ValueError(f"bad code {code}")
            out.append(entry)
            if prev is not None and len(table) < 4096:
                table.append(prev + entry[:1])
            prev = entry
        held = sum(map(len, out))
        if not len(codes) or (len(stop) and codes[last] == end):
            break
        if len(stop):
            at, table, prev, widths = int(ends[last]), list(base), None, grown
        else:
            at, widths = int(ends[len(w) - 1]), np.full(4096, 12)
    return np.frombuffer(b"".join(out)[:n], np.uint8)


def _blocks(data: bytes) -> bytes:
    """Data cut into sub-blocks of at most 255 bytes, each after its length, and the terminator."""
    n, full = len(data), len(data) // 255
    a = np.empty((full, 256), np.uint8)
    a[:, 0] = 255
    a[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return a.tobytes() + (bytes([len(rest)]) + rest if n % 255 else b"") + b"\0"


#: 256 greys: a sample's index is its value.
GREYS = bytes(v for i in range(256) for v in (i, i, i))


def encode_payload(payload: bytes, compress: bool = True) -> bytes:
    """A GIF of grey frames, 192 samples wide and up to FRAME_ROWS high, that holds the payload (a multiple of 192 bytes)."""
    px = np.frombuffer(payload, np.uint8)
    rows = len(px) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREYS]
    for r in range(0, rows, FRAME_ROWS):
        part = px[r * WIDTH : (r + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", DELAY_CS, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks((lzw_compress if compress else lzw_literal)(part))]
    return b"".join([*out, b"\x3b"])


def _joined(data: bytes, i: int) -> tuple[bytes, int]:
    parts = []
    while i < len(data) and data[i]:
        parts.append(data[i + 1 : i + 1 + data[i]])
        i += 1 + data[i]
    return b"".join(parts), i + 1


def _rows_shown(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF. Raises ValueError for what isn't a GIF; frames before a broken end are kept."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    i, palette = 13, np.frombuffer(GREYS, np.uint8).reshape(-1, 3)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, n * 3, i).reshape(-1, 3)
        i += n * 3
    canvas, frames, clock = np.zeros((h, w, 3), np.uint8), [], 0
    delay = disposal = 0
    transparent = -1
    while i < len(data) and data[i] != 0x3B:
        if data[i] == 0x21:
            label = data[i + 1] if i + 1 < len(data) else 0
            body, i = _joined(data, i + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
        elif data[i] == 0x2C and i + 11 < len(data):
            left, top, fw, fh, ff = struct.unpack_from("<HHHHB", data, i + 1)
            i += 10
            colours = palette
            if ff & 0x80:
                n = 2 << (ff & 7)
                colours = np.frombuffer(data, np.uint8, n * 3, i).reshape(-1, 3)
                i += n * 3
            size = data[i]
            body, i = _joined(data, i + 1)
            got = lzw_decode(body, size, fw * fh)
            px = np.zeros(fw * fh, np.uint8)
            px[: len(got)] = got
            samples = np.empty((fh, fw), np.uint8)
            samples[_rows_shown(fh, bool(ff & 0x40))] = px.reshape(fh, fw)
            # a screen that is too small for a frame shows what fits
            y, x = max(0, min(fh, h - top)), max(0, min(fw, w - left))
            before = canvas.copy() if disposal == 3 else None
            shown = samples[:y, :x]
            rgb = colours[np.minimum(shown, len(colours) - 1)]
            area = canvas[top : top + y, left : left + x]
            area[:] = np.where((shown == transparent)[..., None], area, rgb) if transparent >= 0 else rgb
            frames.append(Frame(left, top, samples, canvas.copy(), delay, disposal, transparent, clock))
            clock += delay * 10
            if disposal == 2:
                canvas[top : top + y, left : left + x] = 0
            elif before is not None:
                canvas = before
            delay = disposal = 0
            transparent = -1
        else:
            break
    return w, h, frames


def histogram(rgb: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of colours in bins x bins x bins cells of RGB space."""
    q = (rgb.reshape(-1, 3).astype(np.uint16) * bins) >> 8
    return np.bincount((q[:, 0] * bins + q[:, 1]) * bins + q[:, 2], minlength=bins**3)


def decode_frames(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """Timed frames of a binary GIF column: one row a frame with its canvas (RGB bytes) and colour histogram.

    Null, empty or broken media give one row with frame null and error set. Other columns are dropped; repeated rows
    give repeated frames.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    w, h, frames = decode(m or b"")
                    rows += [(k, i, f.starts_ms, f.delay_cs * 10, f.disposal, w, h, f.canvas.tobytes(), histogram(f.canvas).tolist(), None) for i, f in enumerate(frames)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, None, None, None, str(e)))
            names = ("key", "frame", "starts_ms", "lasts_ms", "disposal", "width", "height", "rgb", "histogram", "error")
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, media), run, f"key {kind}, frame int, starts_ms long, lasts_ms long, disposal int, width int, height int, rgb binary, histogram array<long>, error string").withColumnRenamed("key", key)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, duration_ms long"


def media_of_documents(docs: DataFrame, compress: bool = True) -> DataFrame:
    """Each document's text as a GIF, written and read back, with digests and features.

    Null text is empty; an empty text is one row of 192 blanks. Texts longer than a frame take more frames. Repeated
    rows give equal rows. feature: counts of 16 grey levels of all frames, as shown, comma-joined.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                media = encode_payload(t + b" " * (max(WIDTH, -(-len(t) // WIDTH) * WIDTH) - len(t)), compress)
                _, _, frames = decode(media)
                # the shown grey of each frame's own rectangle is the stored sample
                back = b"".join(f.canvas[: len(f.samples), :, 0].tobytes() for f in frames)
                levels = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
                rows.append((k, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, levels.tolist())), len(frames), sum(f.delay_cs for f in frames) * 10))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in MEDIA_SCHEMA.split(", ")])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, MEDIA_SCHEMA)


def op9_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a GIF and back: media_of_documents."""
    return media_of_documents(read_table(spark, sf_dir, "documents"))


# DuckDB can restate the payload's digests, not the stored form.
QUERIES = {"op9_media_gif": op9_media_gif}
SQL: dict[str, str] = {}
