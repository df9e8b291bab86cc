"""Personal data: fixed patterns as the base, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (their digit groups, separators, checksums, neighbours) and a dynamic program over
segments of at most MAX_TOKENS tokens (white space included) chooses boundaries and types jointly. Segments without a digit or @ have no
entity score, so texts are decoded in islands that hold all tokens in reach of such characters, which gives what decoding the whole text would.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import as_text, map_arrow, read_table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, EPOCHS, RATE, DECAY, TRAINING_LINES = 16, 5, 0.2, 1e-3, 520

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = (ord(c) - 48) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """In the order of their @: the part before it is the run of its characters since the last match."""
    done, at = 0, t.find("@")
    while at >= 0:
        i = at
        while i > done and t[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(t, at + 1) if i < at else None
        if m:
            done = m.end()
            yield i, done
        at = t.find("@", at + 1)


def _ips(t: str) -> Iterator[tuple[int, int]]:
    """Runs of numbers joined by single dots, taken four by four; what is left of a run is no match."""
    for m in _CHAIN.finditer(t):
        parts = [p.span() for p in re.finditer(r"[0-9]+", m[0])]
        for k in range(0, len(parts) - 3, 4):
            four = [m[0][a:b].lstrip("0") for a, b in parts[k : k + 4]]
            if all(len(x) < 4 and int(x or 0) <= 255 for x in four):
                yield m.start() + parts[k][0], m.start() + parts[k + 3][1]


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, by start and kind. Time grows with the text, whatever it holds."""
    out = [(a, 0, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [(a, 1, b) for a, b in _ips(t)]
        for m in _CARD.finditer(t):
            if len(m[0]) >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]|\s+")
_WORD = re.compile(r"[A-Za-z]+")


def _kind(c: str) -> str:
    """What runs of characters are one token: letters, digits, white space; '' for a character that is a token of its own."""
    return "s" if c.isspace() else "" if not c.isalnum() or not c.isascii() else "d" if c.isdigit() else "w"


def islands(t: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @ with all tokens that a segment with such a token can hold; those that touch are one."""
    lo = hi = -1
    for m in _TRIGGER.finditer(t):
        a, b = m.span()
        for _ in range(MAX_TOKENS - 1):
            if a <= max(hi, 0):
                break
            a -= 1
            kind = _kind(t[a])
            while kind and a > max(hi, 0) and _kind(t[a - 1]) == kind:
                a -= 1
        for _ in range(MAX_TOKENS - 1):
            if b == len(t):
                break
            b = _TOKEN.match(t, b).end()
        if hi >= 0 and a <= hi:
            hi = max(hi, b)
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def segment_features(t: str, a: int, b: int, before: str) -> list[str]:
    """Features of t[a:b] as a whole. before: the word in front of it, lower-cased."""
    s = t[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]+", "", s))))[:6]
    shape = re.sub(r"[A-Za-z]+", "w", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", s))
    f = ["bias", f"seps={seps}", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}", f"first={'d' if s[0].isdigit() else 'w' if s[0].isalpha() else s[0]}", f"last={'d' if s[-1].isdigit() else 'w' if s[-1].isalpha() else s[-1]}", f"letters={bool(_WORD.search(s))}"]
    if len(shape) <= 20:
        f.append("shape=" + shape)
    if a and (t[a - 1].isalnum() or t[a - 1] in "+@._-/"):
        f.append("joined-left")
    if b < len(t) and (t[b].isalnum() or t[b] == "@" or t[b : b + 1] in "._-" and t[b + 1 : b + 2].isalnum()):
        f.append("joined-right")
    if len(digits) >= 13:
        f.append(f"luhn={luhn(digits[:24])}")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        f.append("bytes4")
    if "@" in s:
        f.append("mail-like" if re.fullmatch(r"[\w.+%-]+ ?@ ?[\w-]+(\.[\w-]+)+", s) else "at")
    if before:
        f.append("before=" + before[:12])
    return f


def segments(t: str, toks: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
    """Candidate segments (first token, one past the last, features). Features depend on the text and the segment alone."""
    has = [t[a] in "0123456789@" for a, _ in toks]
    for i, (a, _) in enumerate(toks):
        if t[a].isspace():
            continue
        reach = range(i, min(len(toks), i + MAX_TOKENS))
        first = next((j for j in reach if has[j]), None)
        if first is None:
            continue
        w = _WORD.findall(t[max(0, a - 24) : a])
        before = w[-1].lower() if w else ""
        for j in reach[first - i :]:
            if not t[toks[j][0]].isspace():
                yield i, j + 1, segment_features(t, a, toks[j][1], before)


def candidates(t: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of an island, and its candidate segments."""
    toks = [m.span() for m in _TOKEN.finditer(t, lo, hi)]
    return toks, list(segments(t, toks))


Weights = dict[tuple[int, str], float]


def _scores(segments: list[tuple[int, int, list[str]]], w: Weights) -> list[list[float]]:
    return [[sum(w.get((k, x), 0.0) for x in f) for k in range(len(KINDS))] for _, _, f in segments]


def decode(n: int, segs: list[tuple[int, int, list[str]]], w: Weights) -> list[tuple[int, int, int]]:
    """The best labelling of n tokens: (first, past, kind); a token outside a segment scores 0."""
    ends: dict[int, list[int]] = {}
    for i, (_, j, _) in enumerate(segs):
        ends.setdefault(j, []).append(i)
    sc = _scores(segs, w)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for p in range(1, n + 1):
        best[p] = best[p - 1]
        for i in ends.get(p, ()):
            for k, s in enumerate(sc[i]):
                if (v := best[segs[i][0]] + s) > best[p]:
                    best[p], back[p] = v, (i, k)
    out, p = [], n
    while p:
        if back[p] is None:
            p -= 1
        else:
            i, k = back[p]
            out.append((segs[i][0], segs[i][1], k))
            p = segs[i][0]
    return out[::-1]


def marginals(n: int, segments: list[tuple[int, int, list[str]]], w: Weights) -> np.ndarray:
    """Probability of each candidate segment and kind, by forward and backward sums."""
    sc = np.array(_scores(segments, w)).reshape(len(segments), len(KINDS))
    f, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    f[0] = b[n] = 0.0
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for i, (s, e, _) in enumerate(segments):
        by_end.setdefault(e, []).append(i)
        by_start.setdefault(s, []).append(i)
    for p in range(1, n + 1):
        f[p] = np.logaddexp.reduce([f[p - 1], *(f[segments[i][0]] + v for i in by_end.get(p, ()) for v in sc[i])])
    for p in range(n - 1, -1, -1):
        b[p] = np.logaddexp.reduce([b[p + 1], *(b[segments[i][1]] + v for i in by_start.get(p, ()) for v in sc[i])])
    return np.exp(np.array([f[s] + b[e] for s, e, _ in segments])[:, None] + sc - f[n])


def training_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up lines with their spans (start, end, kind): entities in usual and in odd spellings among look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))

    def card() -> str:
        x = "4" + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        g = [x[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([x, " ".join(g), "-".join(g), ".".join(g)])

    makers = (
        lambda: r.choice([f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", f"{w()}@{w()}.org", f"{w()} @ {w()}.com", f"{w()}@{w()}.{w()}.net"]),
        lambda: r.choice([".", ".", ".", "[.]", " . "]).join(str(r.randint(1, 255)) for _ in range(4)),
        card,
        lambda: r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(2)}/{d(3)}/{d(7)}"]),
    )
    def not_a_card() -> str:
        """A number as long as a card's that fails the checksum."""
        x = d(r.choice([14, 15, 16, 16, 16, 17, 19]))
        x = x[:-1] + next(c for c in r.sample("0123456789", 10) if not luhn(x[:-1] + c))
        return r.choice([x, x, " ".join(x[i : i + 4] for i in range(0, len(x), 4)), "-".join(x[i : i + 4] for i in range(0, len(x), 4))])

    alike = (
        not_a_card, not_a_card, not_a_card, not_a_card, lambda: f"order {d(12)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1900, 2030)}", lambda: f"version {r.randint(1, 9)}.", lambda: f"${d(3)}.{d(2)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(2000, 2030)}-{d(2)}-{d(2)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKL23456789") for _ in range(16)),
        lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}", lambda: f"{d(2)}%", lambda: d(r.randint(1, 6)), lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"@{w()}", lambda: f"{d(2)}:{d(2)}",
    )
    out = []
    for i in range(n):
        line, spans = " ".join(w() for _ in range(2)) + " ", []
        for _ in range(r.randint(1, 2)):
            if i % 5 < 3:
                k = r.randrange(4)
                x = makers[k]()
                spans.append((len(line), len(line) + len(x), k))
            else:
                x = r.choice(alike)()
            line += x + r.choice([" ", ", ", ". ", "\n"]) + w() + " "
        out.append((line, spans))
    return out


@cache
def trained() -> tuple[tuple[tuple[int, str], float], ...]:
    """Weights, fit by stochastic gradient steps on the conditional likelihood. The same in every process."""
    w: Weights = {}
    data = []
    for line, spans in training_lines():
        missing = set(spans)
        for lo, hi in islands(line):
            toks, segs = candidates(line, lo, hi)
            at = {(toks[i][0], toks[j - 1][1]): k for k, (i, j, _) in enumerate(segs)}
            gold = {(at[a, b], k) for a, b, k in spans if (a, b) in at}
            missing -= {x for x in spans if x[:2] in at}
            if segs:
                data.append((len(toks), segs, gold))
        if missing:
            raise ValueError(f"spans that no candidate covers: {missing} of {line!r}")
    rng = random.Random(5)
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        rate = RATE / (1 + epoch)
        for n, segs, gold in data:
            p = marginals(n, segs, w)
            for i, (_, _, f) in enumerate(segs):
                for k in range(len(KINDS)):
                    g = ((i, k) in gold) - p[i, k]
                    if abs(g) > 1e-3:
                        for x in f:
                            w[k, x] = w.get((k, x), 0.0) * (1 - DECAY * rate) + rate * g
    return tuple(w.items())


def all_spans(t: str, base: list[tuple[int, int, int]], w: Weights) -> list[tuple[int, int, int]]:
    """The base, and the field's segments that touch no base span."""
    out = list(base)
    starts: list[int] = []  # the base's spans, those that overlap as one
    ends: list[int] = []
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for lo, hi in islands(t):
        i = bisect_right(starts, lo) - 1
        if i >= 0 and hi <= ends[i]:
            continue
        toks = [m.span() for m in _TOKEN.finditer(t, lo, hi)]
        # the best labelling holds no segment of a score that isn't positive; features of the others needn't be kept
        segs = [x for x in segments(t, toks) if max(_scores([x], w)[0]) > 0]
        for i, j, k in decode(len(toks), segs, w):
            a, b = toks[i][0], toks[j - 1][1]
            i = bisect_left(starts, b) - 1
            if i < 0 or ends[i] <= a:
                out.append((a, k, b))
    return sorted(out)


def as_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(t: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of spans that overlap, becomes the first one's kind in angle brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [t[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + t[at:] if spans else t


PII_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each document. Null or empty text has no spans; repeated rows give equal rows."""
    weights = dict(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), as_text(b.column(1)), strict=True):
                base = base_spans(t)
                n = [sum(x[1] == i for x in base) for i in range(4)]
                rows.append((k, *n, hashlib.sha256(as_string(base).encode()).hexdigest(), as_string(all_spans(t, base, weights))))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(kinds)], names=[x.split()[0] for x in PII_SCHEMA.split(", ")])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, PII_SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind; null stays null, other columns stay as they are."""
    weights, at = dict(trained()), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redacted(t, all_spans(t, base_spans(t), weights)) for t in b.column(at).to_pylist()]
            cols = b.columns
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(docs, run, T.StructType(docs.schema.fields))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: find_pii."""
    return find_pii(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
