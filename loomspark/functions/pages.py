"""Cleaning of page texts: arrays of pages in, arrays of pages out, by Arrow batches.

The order: characters, repeated heads and feet, page numbers, hyphens at line ends, soft wraps, tables, lines of symbols, white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame

# What page numbers, broken words, ends of sentences, list items, headings and symbols look like.
_PAGE_NO = re.compile(r"^\s*(page\s+\d+(\s+of\s+\d+)?|\d+)\s*$", re.I)
_BROKEN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ0-9]+)-\n([A-Za-zÀ-ÖØ-öø-ÿ0-9]+)")
_ENDS = re.compile(r"[.!?…)](?:['\"»])?\s*$")
_ITEM = re.compile(r"^\s*([\-–—•·*]\s+|\d+\.\s+|[a-zA-Z]\)\s+)")
_CAPITALS = re.compile(r"^[A-Z0-9][A-Z0-9\s\-_&]+$")
_BULLETS, _RULES = "•◦○◯●▪▫■□◻◼⁃·", "-–—_=*.•·"
_SYMBOLS = re.compile(rf"^[\s{re.escape(_BULLETS + _RULES)}]+$")
_WORDY = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]")
SMALL_WORDS = frozenset("a an and as at but by for from in into nor of on or out the to via with".split())
OPEN, CLOSE = "[TABLE]", "[/TABLE]"


def normalised(page: str) -> str:
    return unicodedata.normalize("NFKC", page.replace("\r\n", "\n").replace("\r", "\n"))


def repeated_ends(pages: list[str], share: float = 0.5) -> set[str]:
    """Lines that stand among the first or last two of at least share of the pages; fewer than three pages have none."""
    if len(pages) < 3:
        return set()
    n: Counter[str] = Counter()
    for p in pages:
        full = [x.strip() for x in p.split("\n") if x.strip()]
        n.update(set(full[:2] + full[-2:]))
    return {x for x, c in n.items() if c >= -(-len(pages) * share // 1)}


def without_ends(page: str, ends: set[str]) -> str:
    """Empty lines for repeated ends and for page numbers near the page's ends."""
    lines = page.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    near = {*full[:2], *full[-2:]}
    edge = {*range(3), *range(max(0, len(lines) - 4), len(lines))}
    return "\n".join("" if i in near and x.strip() in ends or i in edge and _PAGE_NO.match(x) else x for i, x in enumerate(lines))


def joined_words(page: str, mode: str = "smart") -> str:
    """Words that a hyphen breaks over a line end. merge: one word; space: two; keep: as they are; smart: one word, but two where the line has a hyphen before, and a hyphenated
    one before a small word."""
    if mode == "keep":
        return page
    page = page.replace("­", "")

    def join(m: re.Match) -> str:
        before = page[page.rfind("\n", 0, m.start()) + 1 : m.start()]
        gap = {"merge": "", "space": " "}.get(mode)
        if gap is None:
            gap = "-" if m[2].lower() in SMALL_WORDS else " " if "-" in before else ""
        return m[1] + gap + m[2]

    return _BROKEN.sub(join, page)


def goes_on(line: str, following: str) -> bool:
    """Whether a line's sentence goes on in the next line: it is no list item, heading or lead-in and ends no sentence, and the next line's first letter is small."""
    first = next((c for c in following if c.isalpha()), "")
    return first.islower() and not (_ITEM.match(line) or _CAPITALS.match(line.strip()) or line.rstrip().endswith(":") or _ENDS.search(line.rstrip()))


def unwrapped(page: str) -> str:
    """Lines that go on take the next one. A line that has taken one is done, so three lines of a sentence become two."""
    def step(done: tuple[list[str], bool], line: str) -> tuple[list[str], bool]:
        out, may = done
        if out and may and goes_on(out[-1], line):
            return [*out[:-1], f"{out[-1].rstrip()} {line.lstrip()}".strip()], False
        return [*out, line], True

    return "\n".join(reduce(step, page.split("\n"), ([], False))[0])


def columns(line: str) -> tuple[str, int] | None:
    """How a line is parted into columns, and into how many: by bars between texts, else by tabs."""
    cells = line.split("|")
    if len(cells) > 1 and cells[0].strip() and cells[-1].strip():
        return "bar", len(cells)
    return ("tab", line.count("\t") + 1) if "\t" in line else None


def with_tables(lines: list[str]) -> list[tuple[str, bool]]:
    """Lines and whether they are a table's: two neighbours or more of one kind and number of columns, between marks. Rules of dashes stay within a table of bars."""
    kinds: list = []
    for x in lines:
        rule = re.match(r"^\s*-{3,}\s*$", x) and kinds and kinds[-1] and kinds[-1][0] == "bar"
        kinds.append(kinds[-1] if rule else columns(x))
    out: list[tuple[str, bool]] = []
    for kind, run in groupby(zip(kinds, lines), key=lambda p: p[0]):
        rows = [x for _, x in run]
        if kind and sum(columns(x) == kind for x in rows) >= 2:
            out += [(OPEN, True), *((x, True) for x in rows), (CLOSE, True)]
        else:
            out += [(x, False) for x in rows]
    return out


def tidy(page: str) -> str:
    """Tables are marked and stay as they are. Elsewhere a line of symbols goes: a list mark goes before the text of the next line, and a rule becomes an empty line. Trailing
    space goes, and two empty lines are the most."""
    out: list[str] = []
    mark = ""
    for x, in_table in with_tables(page.split("\n")):
        if not in_table and _SYMBOLS.match(x):
            mark = next((c for c in x if c in _BULLETS), "")
            if not mark and (not out or out[-1] != ""):
                out.append("")
            continue
        out.append(f"{mark} {x.strip()}" if mark and not in_table and _WORDY.search(x) else x)
        mark = ""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip("\n")


def clean_pages(pages: list[str | None] | None, hyphens: str = "smart") -> list[str]:
    """All steps in order. Null is no pages; a null page is an empty one."""
    ps = [normalised(p or "") for p in pages or []]
    ends = repeated_ends(ps)
    return [tidy(unwrapped(joined_words(without_ends(p, ends), hyphens))) for p in ps]


def with_clean_pages(df: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """key, pages (cleaned) of each row."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean_pages(p) for p in b.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, pages])

    return df.select(key, pages).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{pages}` array<string>")
