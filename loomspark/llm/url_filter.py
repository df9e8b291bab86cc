"""URL filters by a sort-merge range join: reversed-host keys turn host rules and path prefixes into intervals, and a sweep over
sorted URLs keeps a stack of the rules that are open.

Hosts are compared label by label from the right, so a rule's host and all its subdomains are one interval of reversed
hosts; inside a host, a rule's path prefix is one interval of paths. Either kind of interval nests, so a stack holds those that are open. In a key SEP ends
each label; labels that hold SEP themselves have it escaped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, tune

DEFAULT_VERDICT = "allow"
#: Stands after each label of a reversed host, and what escapes it within a label.
SEP, ESCAPE = "\x01", "\x02"
#: Rules of at most so many bytes in all are sent to each task; more are refused by judge() and need judge_in_ranges().
RULE_BYTES = 64 << 20


@dataclass(frozen=True, order=True)
class Rule:
    """key: reversed host labels, each followed by SEP; path: prefix from the slash on."""

    key: str
    path: str
    host: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def escaped(host: str) -> str:
    return host.replace(ESCAPE, ESCAPE + ESCAPE).replace(SEP, ESCAPE + "s")


def rule(verdict: str, text: str) -> Rule:
    """A rule of a host, which may be empty, and a path. It fits hosts that are the same and those that end with a dot and it."""
    host, slash, path = text.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return Rule(SEP.join(reversed(escaped(host).split("."))) + SEP, slash + path, host, verdict)


RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    host = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE)), F.lit(SEP), F.lit(ESCAPE + "s"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


class Paths:
    """The rule that holds for each of a host's paths, which come in ascending order: a stack of the path prefixes that are open."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.at, self.active = sorted(rules, key=lambda r: (r.path, -len(r.text), r.key)), 0, []

    def of(self, path: str) -> Rule | None:
        while self.active and not path.startswith(self.active[-1].path):
            self.active.pop()
        while self.at < len(self.rules) and self.rules[self.at].path <= path:
            r = self.rules[self.at]
            self.at += 1
            if path.startswith(r.path):
                self.active.append(r)
        # longest text wins; of equally long ones the longer host
        return max(self.active, key=lambda r: (len(r.text), len(r.host)), default=None)


class Sweep:
    """Judges (key, path) pairs that come in ascending order; rules that end before the current pair are off the stacks for good."""

    def __init__(self, rules: list[Rule], default: str = DEFAULT_VERDICT):
        # of rules with one host and path the last stated holds
        self.rules, self.default = sorted({(r.key, r.path): r for r in rules}.values()), default
        self.next, self.open, self.key, self.paths = 0, [], None, None

    def of(self, key: str, path: str) -> Rule | None:
        if key != self.key:
            while self.open and not key.startswith(self.open[-1][0]):
                self.open.pop()
            while self.next < len(self.rules) and self.rules[self.next].key <= key:
                k = self.rules[self.next].key
                same = []
                while self.next < len(self.rules) and self.rules[self.next].key == k:
                    same.append(self.rules[self.next])
                    self.next += 1
                if key.startswith(k):
                    self.open.append((k, same))
            self.key, self.paths = key, Paths([r for _, rs in self.open for r in rs])
        return self.paths.of(path)


def _judged(sorted_rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(rules, default)
        for b in batches:
            found = [sweep.of(k, p) for k, p in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r and r.text for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    out = map_arrow(sorted_rows, run, f"page_id {sorted_rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    tune(sorted_rows.sparkSession)
    return out


def judge(pages: DataFrame, rules: list[Rule] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict of every row of pages (page_id, url).

    The rules, within RULE_BYTES, go to each task, which sorts its own rows and sweeps both: no shuffle, and a host with very many
    pages stays spread over the tasks that read them. Null urls and urls without :// have empty host and path, which no
    rule with a host fits; a rule without a host fits an empty one, and hosts that end with a dot. Repeated rows are judged alike.
    """
    if sum(len(r.text) * 4 + 64 for r in rules) > RULE_BYTES:
        raise ValueError("too many rules for one task; use judge_in_ranges")
    host = host_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"), reversed_key(host).alias("key"))
    return _judged(rows.sortWithinPartitions("key", "path"), rules, default)


#: Parts over which the urls of one site are dealt.
SITE_PARTS = 16


def judge_in_ranges(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, partitions: int = 0) -> DataFrame:
    """The same for rules (verdict, text) in a table of any size: rules and urls are dealt by the first two labels of the reversed
    host, rules of one label go to every part (they are few: one a top-level domain), and each part sweeps its sorted rows.
    A hot site is dealt over SITE_PARTS parts, each with the site's rules. Of rules with one host and path the verdict last in order holds."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = host_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), host.alias("host"), path_of(F.col("url")).alias("path"), reversed_key(host).alias("key"), F.lit(None).cast("string").alias("verdict"), F.pmod(F.xxhash64("url"), F.lit(SITE_PARTS)).alias("salt"))
    rule_host = _lower(F.substring_index("text", "/", 1))
    base = rules.where("text is not null and verdict is not null").select(F.lit(None).cast("string").alias("page_id"), rule_host.alias("host"), F.expr("substring(text, length(substring_index(text, '/', 1)) + 1)").alias("path"), "verdict")
    base = base.groupBy("page_id", "host", "path").agg(F.max("verdict").alias("verdict")).select("page_id", "host", "path", reversed_key(F.col("host")).alias("key"), "verdict")
    site = F.concat_ws(SEP, F.slice(F.split("key", SEP), 1, 2))
    labels = F.size(F.split("host", r"\."))
    deep = base.where(labels > 1).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SITE_PARTS - 1).cast("long")))).withColumn("part", F.pmod(F.xxhash64(site, "salt"), F.lit(n))).dropDuplicates(["host", "path", "part"])
    short = base.where(labels == 1).withColumn("salt", F.lit(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    events = rows.withColumn("part", F.pmod(F.xxhash64(site, "salt"), F.lit(n))).unionByName(deep).unionByName(short)
    dealt = events.repartition(n, "part").sortWithinPartitions("part", "key", F.col("verdict").isNull(), "path").select("part", "page_id", "host", "path", "key", "verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, stack, paths = None, None, [], None  # stack: (key, rules) of nested hosts that are open
        for b in batches:
            out = []
            for p, page, host, path, key, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, at, stack = p, None, []
                if key != at:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    at, paths = key, None
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append(Rule(key, path, host, verdict))
                    continue
                paths = paths or Paths([r for _, rs in stack for r in rs])
                best = paths.of(path)
                out.append((page, host, path, best and best.text, best.verdict if best else default))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(5)], names=["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(dealt, run, "page_id string, host string, path string, rule string, verdict string").withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: judge with RULES."""
    return judge(read_table(spark, sf_dir, "pages"))


QUERIES = {"op4_url_filter": op4_url_filter}
_FITS = " UNION ALL ".join(f"SELECT '{r.host}' rh, '{r.path}' rp, '{r.verdict}' rv" for r in RULES)
SQL = {
    "op4_url_filter": rf"""
WITH rules AS ({_FITS}),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
f AS (SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '{DEFAULT_VERDICT}') AS verdict FROM f WHERE n = 1""",
}
