"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def encoded(texts, file, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def near(rows):
    """rows: (doc_id, text). doc_id -> (n_shingles, component_id)."""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    seen = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def dedup(rows, w=13):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, ws in words:
        for i in range(len(ws) - w + 1) if d is not None else ():
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - w + 1) if d is not None else ():
            if first[tuple(ws[i : i + w])] < d:
                gone |= set(range(i, i + w))
        out.append((d, len(ws), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return out


def contamination(rows, bench, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, t in bench:
        w = word.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1)) if w and item is not None else ():
            wins[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w = word.findall((t or "").translate(LOW))
        hit, items = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                k = tuple(w[i : i + s])
                if k in wins:
                    hit |= set(range(i, i + s))
                    items |= wins[k]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def base_pii(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
