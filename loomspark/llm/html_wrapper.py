"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page's tags form nested token groups; neighbours of one shape fold into repeated groups. All pages of a host, whole, are aligned one
after the other with the wrapper so far, in parts that are then aligned too: groups without a partner become optional, texts that differ
become slots. The wrapper decides twice. The element that holds most of the slots' text is the host's main region; hosts with one page, pages
that lack the region, and pages whose own article or main element stands outside it fall back on the page's own article, main or body element.
And a text that stays the same where it stands on FIXED_PAGES distinct pages or more, and on half of those that the host has, is the
template's and no main text. Names of elements (classes, ids) are a prior alone: an element that they call boilerplate stays if the page has hardly any text beside it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, shuffle_partitions, stored, tune

#: Distinct pages, half of the host's at least, that a template's text stands on.
FIXED_PAGES = 3
#: Parts that a host's pages are dealt into by their hash; a part's pages are aligned in one task.
HOST_PARTS = 64
#: Wrappers of at most so many bytes in all are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never main text; header is one outside an article or main element only.
BOILER = frozenset("nav footer aside form script style noscript template iframe svg button select dialog head title menu".split())
BOILER_WORD = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead siteheader pageheader footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended comment comments commentlist disqus replies reply respond readercomments widget widgets toolbar pagination pager skiplink searchform login".split())
#: Parts of a class name that say where or how, not what: comments-area and sidebar-left are what their first part says.
LAYOUT_WORD = frozenset("area bar block body bottom box btn button buttons col column container content form group header heading inner item items left line link links list main outer panel posts right row section site page text title top wrap wrapper zone".split())
#: Class names that begin so tell of something beside the element.
BESIDE = ("has-", "has_", "with-", "with_", "no-", "no_", "is-", "is_")
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', tag, names) and ('close', tag, '') in page order; scripts, styles and comments are left out."""
    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                yield "close", tag, ""
            else:
                found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[4])} if m[4] else {}
                names = f"{found.get('class', '')} {found.get('id', '')}".strip()
                yield "open", tag, names + (f" role={found['role'].lower()}" if "role" in found else "")
                if m[4].endswith("/") and tag not in VOID:
                    yield "close", tag, ""
    if at < len(page):
        yield "text", html.unescape(page[at:]), ""


@lru_cache(4096)
def names_boiler(names: str) -> bool:
    """Whether a class or id among names calls an element boilerplate: by its last part that isn't about layout."""
    for token in names.lower().split():
        if token.startswith(BESIDE):
            continue
        parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=\d)", token) if x and not x.isdigit()]
        if "".join(parts) in BOILER_WORD or "".join(parts[:2]) in ("siteheader", "pageheader"):
            return True
        what = next((x for x in reversed(parts) if x not in LAYOUT_WORD), "")
        if what in BOILER_WORD and not (len(parts) > 1 and what in ("comment", "notice", "related") and parts[-1] in ("body", "text", "title", "content", "main")):
            return True
    return False


def is_boiler(tag: str, names: str, inside: bool) -> str:
    """'tag' where an element's tag or role makes it boilerplate, 'name' where a class or id does, else ''."""
    role = names.rpartition("role=")[2] if "role=" in names else ""
    if tag in BOILER or tag == "header" and not inside or role in BOILER_ROLE:
        return "tag"
    return "name" if names and tag not in ("html", "body", "article", "main") and names_boiler(names.partition(" role=")[0]) else ""


def key_of(tag: str, names: str) -> str:
    return tag + ("." + _SPACE.sub(".", names) if names and tag not in ("html", "body") else "")


Events = list[tuple[str, str, str]]


def walk(page: Events, spared: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, str, str, int]]:
    """Blocks and elements of a page's events in order: ('text', block, boilerplate or '', '', 0), ('open', tag, key, boilerplate or '', number), ('close', '', '', '', how many).
    Inline elements are part of a block, but for those inside boilerplate or named so. spared: numbers of elements whose names don't count."""
    stack: list[tuple[str, str]] = []  # tag, boilerplate
    line: list[str] = []
    n = 0
    for kind, a, names in page:
        if kind == "text":
            line.append(a)
            continue
        now = stack[-1][1] if stack else ""
        if a in INLINE and not now and not (kind == "open" and a not in VOID and names and is_boiler(a, names, True)):
            continue
        if line:
            if t := " ".join("".join(line).split()):
                yield "text", t, now, "", 0
            line.clear()
        if a in VOID:
            continue
        if kind == "open":
            if a == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                yield "close", "", "", "", 1
                now = stack[-1][1] if stack else ""
            own = is_boiler(a, names, any(x in ("article", "main") for x, _ in stack))
            boiler = now or ("" if own == "name" and n in spared else own)
            stack.append((a, boiler))
            yield "open", a, key_of(a, names), boiler, n
            n += 1
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == a:
                    yield "close", "", "", "", len(stack) - i
                    del stack[i:]
                    break
    if line and (t := " ".join("".join(line).split())):
        yield "text", t, stack[-1][1] if stack else "", "", 0


Items = list[tuple[str, str, str, str, int]]


def read(page: str) -> Items:
    """What walk gives for a page. Elements whose names call them boilerplate are spared if they hold nine tenths of the page's text outside boilerplate by tag, and no
    article or main element has any beside them."""
    ev, found = list(events(page)), frozenset()
    while True:
        items = list(walk(ev, found))
        more = overruled(items)
        if more is None:
            return items
        found |= {more}


def overruled(items: Items) -> int | None:
    """The number of an element whose name's verdict doesn't stand; None without one."""
    mass: dict[int, int] = {}
    stack: list[tuple[str, str, int]] = []
    total, own = 0, 0
    for kind, a, b, boiler, n in items:
        if kind == "open":
            stack.append((a, boiler, n))
        elif kind == "close":
            del stack[-n:]
        elif b != "tag":
            total += len(a)
            if b == "name":
                outer = next(x for _, y, x in stack if y == "name")
                mass[outer] = mass.get(outer, 0) + len(a)
            elif not own:
                own = any(x in ("article", "main") for x, _, _ in stack)
    if own or not mass:
        return None
    most = max(mass, key=mass.__getitem__)
    return most if 10 * mass[most] >= 9 * total else None


# --- inference: a group is [key, children, optional, repeated, boiler], a text is [None, text or None, length, pages] ---


def marked(t: str) -> str:
    """A short text as it is; a long one as its start and its hash, which tell it from others."""
    return t if len(t) <= 80 else f"{t[:40]}\0{xxhash.xxh3_128_hexdigest(t)}"


def groups(page: str) -> list:
    """The page's groups, folded. Below 60 levels, elements stand beside each other."""
    root = ["", [], False, False, False]
    stack, depth = [root], 0
    for kind, a, b, boiler, n in read(page):
        if kind == "text":
            stack[-1][1].append([None, marked(a), len(a), 1])
        elif kind == "open":
            g = [b, [], False, False, bool(boiler)]
            stack[-1][1].append(g)
            depth += 1
            if depth < 60:
                stack.append(g)
        else:
            depth -= n
            del stack[depth + 1 :]
    return fold(root)


def fold(g: list) -> list:
    """Neighbours with one key become one repeated group; neighbouring texts one text."""
    out: list = []
    for c in g[1]:
        if c[0] is None:
            if out and out[-1][0] is None:
                out[-1] = [None, None, out[-1][2] + c[2], 1]
            else:
                out.append(c)
            continue
        c = fold(c)
        if out and out[-1][0] == c[0]:
            out[-1] = [*merge(out[-1], c, max)[:3], True, c[4]]
        else:
            out.append(c)
    return [g[0], out, *g[2:]]


def lcs_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x and each start of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for k in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == k)))
    return row


def aligned(x: list, y: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists of keys."""
    start = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    out = [(i, i) for i in range(start)]
    if start == len(x) or start == len(y):
        return out
    number: dict = {}
    u, v = (np.array([number.setdefault(k, len(number)) for k in keys[start:]]) for keys in (x, y))
    if len(u) <= len(v):
        return out + _aligned(u, v, start, start)
    return out + [(i, j) for j, i in _aligned(v, u, start, start)]


def _aligned(x: np.ndarray, y: np.ndarray, at_x: int, at_y: int) -> list[tuple[int, int]]:
    """x is halved, and y where the halves have most in common (Hirschberg): the space is linear, however wide the groups are."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        hit = np.flatnonzero(y == x[0])
        return [(at_x, at_y + int(hit[0]))] if len(hit) else []
    half = len(x) // 2
    cut = int(np.argmax(lcs_row(x[:half], y) + lcs_row(x[half:][::-1], y[::-1])[::-1]))
    return _aligned(x[:half], y[:cut], at_x, at_y) + _aligned(x[half:], y[cut:], at_x + half, at_y + cut)


def merge(a: list, b: list, pages: Callable[[int, int], int] = int.__add__) -> list:
    """One group (or text) that matches what either matches: children are aligned by longest common subsequence. pages: of how many pages a
    text is that both have; neighbours of one page are of one page."""
    if a[0] is None:
        return [None, a[1] if a[1] == b[1] else None, a[2] + b[2], pages(a[3], b[3])]
    x, y = a[1], b[1]
    out, i, j = [], 0, 0
    maybe = lambda c: c if c[0] is None else [c[0], c[1], True, *c[3:]]
    for p, q in [*aligned([c[0] for c in x], [c[0] for c in y]), (len(x), len(y))]:
        for c in (*map(maybe, x[i:p]), *map(maybe, y[j:q]), *([merge(x[p], y[q], pages)] if p < len(x) else ())):
            if out and c[0] is not None and out[-1][0] == c[0]:
                out[-1] = [*merge(out[-1], c, max)[:3], True, c[4]]
            else:
                out.append(c)
        i, j = p + 1, q + 1
    return [a[0], out, a[2] or b[2], a[3] or b[3], a[4] and b[4]]


def slot_mass(g: list) -> int:
    if g[0] is None:
        return g[2] if g[1] is None else 0
    return 0 if g[4] else sum(map(slot_mass, g[1]))


def main_path(wrapper: list) -> list[str]:
    """Keys from the top to the element that holds most of the slots' text."""
    path, g = [], wrapper
    while True:
        kids = [c for c in g[1] if c[0] is not None and not c[4]]
        total, heavy = slot_mass(g), max(kids, key=slot_mass, default=None)
        if path and path[-1].partition(".")[0] in ("article", "main") or heavy is None or heavy[3] or not total or slot_mass(heavy) < 0.7 * total or heavy[0].partition(".")[0] in ("p", "ul", "ol", "table", "blockquote", "pre", "h1", "h2"):
            return path
        path.append(heavy[0])
        g = heavy


def fixed_texts(wrapper: list, pages: int) -> set[str]:
    """The template's texts (marked) outside boilerplate, of a wrapper of so many distinct pages."""
    out: set[str] = set()
    todo = [wrapper]
    while todo:
        for c in todo.pop()[1]:
            if c[0] is not None:
                if not c[4]:
                    todo.append(c)
            elif c[1] is not None and c[3] >= FIXED_PAGES and 2 * c[3] >= pages:
                out.add(c[1])
    return out


def expression(g: list) -> str:
    """The wrapper as a union-free regular expression over tags, for people."""
    if g[0] is None:
        return "#TEXT" if g[1] is None else repr(g[1][:40])
    inner = " ".join(map(expression, g[1]))
    body = f"<{g[0]}> {inner} </>" if g[0] else inner
    return f"({body})" + ("+" if g[3] else "") + ("?" if g[2] else "") if g[2] or g[3] else body


def infer(pages: list[str]) -> list | None:
    """The wrapper of a host's pages. Equal pages count once; fewer than two distinct pages tell nothing (None)."""
    distinct = list(dict.fromkeys(p for p in pages if p))
    if len(distinct) < 2:
        return None
    return reduce(merge, map(groups, distinct))


# --- application ---


def spot_of(stack: list[tuple[str, str]], path: tuple[str, ...]) -> tuple[str, ...]:
    """Where open elements (tag, key) put a text: in the path, an article, the main element, the body."""
    out = ["path"] if path and len(stack) >= len(path) and all(k == p for (_, k), p in zip(stack, path)) else []
    tags = [t for t, _ in stack]
    if "article" in tags:
        out.append("article")
    if "main" in tags or any("role=main" in k for _, k in stack):
        out.append("main")
    return (*out, "body")


def main_text(page: str, path: tuple[str, ...] = (), fixed: frozenset[str] = frozenset()) -> str:
    """Blocks of the main region, white space folded, joined by one space, without the template's (fixed). The region: the wrapper's path, if the page's
    longest article (without one: its main element) doesn't stand outside it; else the page's article elements, main element or body. A region of template texts alone keeps them."""
    spots: dict[str, list[str]] = {"path": [], "article": [], "main": [], "body": []}
    own: dict[tuple[str, int], list[int]] = {}  # characters of each outermost article, and of main, in all and within the path
    seen = {"article": 0, "main": 0}
    stack: list[tuple[str, str]] = []
    where: tuple[str, ...] | None = None
    for kind, a, b, boiler, n in read(page):
        if kind == "text":
            if b:
                continue
            where = where or spot_of(stack, path)
            for w in where:
                spots[w].append(a)
                if path and w != "path" and w in seen:
                    k = own.setdefault((w, seen[w]), [0, 0])
                    k[0] += len(a)
                    k[1] += len(a) * ("path" in where)
            continue
        if kind == "open":
            if a == "article" and all(x != a for x, _ in stack):
                seen[a] += 1
            stack.append((a, b))
        else:
            del stack[-n:]
        where = None
    longest = max((n for (w, _), n in own.items() if w == ("article" if spots["article"] else "main")), default=[0, 0])
    if longest[1] < longest[0]:
        spots["path"] = []
    blocks = next((spots[w] for w in ("path", "article", "main", "body") if spots[w]), [])
    return " ".join([t for t in blocks if marked(t) not in fixed] or blocks) if fixed else " ".join(blocks)


@lru_cache(4096)
def _list(text: str | None) -> tuple[str, ...]:
    return tuple(json.loads(text)) if text else ()


@lru_cache(4096)
def _set(text: str | None) -> frozenset[str]:
    return frozenset(_list(text))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit("")).alias("_host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, main_path and fixed (JSON), expression, from all pages of a host. Their groups, of less size than the pages, are dealt by the pages' hashes into
    HOST_PARTS parts a host and aligned there in the hashes' order, a page at a time; the parts' wrappers are aligned last. So a host with
    very many pages is no large task, and the result doesn't depend on how rows are partitioned."""
    rows = with_host(pages).where("_host <> '' and html is not null and html <> ''")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            h = [xxhash.xxh3_128_hexdigest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(x[:4], 16) % HOST_PARTS for x in h], pa.int32()), pa.array(h, pa.string()), pa.array([json.dumps(groups(t), separators=(",", ":")) for t in texts], pa.string())], names=["host", "part", "h", "shape"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = wrapper = None
        n = 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([json.dumps(wrapper, separators=(",", ":"))])], names=["host", "part", "n", "wrapper"])
        for b in batches:
            for host, part, h, shape in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (host, part) != key:
                    if key:
                        yield done()
                    key, last, n = (host, part), None, 0
                if h != last:
                    wrapper = merge(wrapper, json.loads(shape)) if n else json.loads(shape)
                    last, n = h, n + 1
        if key:
            yield done()

    dealt = map_arrow(rows.select("_host", "html"), shapes, "host string, part int, h string, shape string").repartition(shuffle_partitions(pages.sparkSession), "host", "part").sortWithinPartitions("host", "part", "h")
    parts = map_arrow(dealt, folded, "host string, part int, n long, wrapper string")

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["n"].sum())
        w = reduce(merge, map(json.loads, f.sort_values("part")["wrapper"])) if n > 1 else None
        return pd.DataFrame({"host": [key[0]], "main_path": [json.dumps(main_path(w)) if w else None], "fixed": [json.dumps(sorted(fixed_texts(w, n))) if w else None], "expression": [expression(w)[:4000] if w else None]})

    return parts.groupBy("host").applyInPandas(one, "host string, main_path string, fixed string, expression string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html gives an empty text; a null url has no host and so
    no wrapper. Repeated rows give equal rows."""
    spark = pages.sparkSession
    tune(spark)
    found = stored(wrappers(pages).where("main_path is not null").select("host", "main_path", "fixed"), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("main_path") + F.octet_length("fixed")), F.lit(0))).first()[0]
    rows = with_host(pages).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "main_path", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, _list(p), _set(x)) if h else "" for h, p, x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: extract."""
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_wrapper": op2_html_wrapper}
SQL: dict[str, str] = {}
