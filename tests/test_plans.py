"""Every query with SQL gives DuckDB's rows; operators' rules on small literal inputs."""

import pytest

from loomspark.functions import text as tx
from loomspark.operators import search as s
from loomspark.operators import tables as ops
from loomspark.plans import registry
from tests import harness

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.views(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, con, name):
    assert harness.compare(spark, con, SF, name, registry.QUERIES[name], registry.SQL[name]) is None


def test_mmr_prefers_other_directions(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0], [1.0, 0.2]), (1, 2, 0.89, [1.0, 0.01], [1.0, 0.2]), (1, 3, 0.5, [0.0, 1.0], [1.0, 0.2])]
    got = s.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, v array<double>, q array<double>"), 2, lam=0.3).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 3]


def test_near_duplicates_fold_in_rank_order(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [0.99, 0.01]), (1, 3, 0.7, [0.0, 1.0]), (1, 4, 0.6, [0.02, 1.0])]
    got = s.near_duplicate_fold(spark.createDataFrame(rows, "query_id long, id long, score double, v array<float>"), 0.9).first()
    assert list(got["ids"]) == [1, 3]


def test_near_duplicates_fold_of_long_lists(spark):
    import random

    r = random.Random(2)
    rows = [(q, i, r.random(), [r.uniform(-1, 1) for _ in range(4)]) for q in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, v array<float>")
    got = {x["query_id"]: list(x["ids"]) for x in s.near_duplicate_fold(df, 0.97).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in (1, 2):
        kept = []
        for _, i, _, v in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1])):
            if all(sum(a * b for a, b in zip(u, v)) / norm(u) / norm(v) < 0.97 for _, u in kept):
                kept.append((i, v))
        assert len(kept) > 64 and got[q] == [i for i, _ in kept]


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, i, 1.0 - i / 10, n) for i, n in enumerate((60, 50, 30, 10))]
    got = s.budget_pack(spark.createDataFrame(rows, "query_id long, id long, score double, n_tokens long"), 100, 1).first()
    assert (got["used"], list(got["ids"])) == (100, [0, 2, 3])


def test_merge_and_union(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long"), spark.createDataFrame([(2, 21), (3, None)], "k long, v long")
    assert sorted(map(tuple, ops.merge(a, b, ["k"]).collect()), key=repr) == [(1, 10), (2, 21), (3, None)]
    assert ops.union_evolved(a, b.drop("v")).count() == 4


@pytest.mark.parametrize("text, want", [("1.234,50 €", 1234.5), ("$1,234.50", 1234.5), ("12,5", 12.5), ("1,234", 1234.0), ("0", None), ("", None), (None, None)])
def test_amount(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.amount(df["t"])).first()[0] == want


def test_recursive_split():
    text = "\n\n".join("word " * n for n in (30, 400, 3)) + "x" * 2000
    parts = tx.split_recursively(text)
    assert max(map(len, parts)) <= 800 and set("".join(text.split())) == set("".join("".join(parts).split()))
    assert tx.split_recursively("") == [] and tx.split_recursively("short") == ["short"]


def test_null_and_empty_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, None)], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in s.bm25(docs, q).collect()] == [(1, 3)]
    assert tx.fixed_windows(docs).count() == 2


def test_page_cleaning():
    from loomspark.functions import pages as pg

    body = ["A sen-\ntence goes\non here.", "x | y\n1 | 2\n***\n•\nitem", "Ends."]
    pages = [f"Head line\n{b}\n\n\n\nPage {i} of 3" for i, b in enumerate(body)]
    assert pg.clean_pages(pages) == ["A sentence goes on here.", "[TABLE]\nx | y\n1 | 2\n[/TABLE]\n\n• item", "Ends."]
    assert pg.clean_pages(None) == [] and pg.clean_pages([None]) == [""]
    assert pg.unwrapped("one goes\non and\non.\nHEAD\nlow\nlead:\nlow\n- item\nlow") == "one goes on and\non.\nHEAD\nlow lead:\nlow - item\nlow"
    assert [pg.joined_words("state-of-\nart up-\nto it-\nself", m) for m in ("smart", "merge", "space", "keep")] == ["state-of art up-to itself", "state-ofart upto itself", "state-of art up to it self", "state-of-\nart up-\nto it-\nself"]
    assert pg.tidy("a\tb\nc\td\n====\nx | y") == "[TABLE]\na\tb\nc\td\n[/TABLE]\n\nx | y"


def test_files(spark, tmp_path):
    from loomspark.sources import files

    for name, raw in (("a.txt", "grün".encode()), ("b.txt", "grün".encode("cp1252")), ("c.txt", "grün".encode("utf-16")), (".h.txt", b"x"), ("d.pdf", b"x"), ("e.txt", b"")):
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == got["b.txt"] == got["c.txt"] == "grün" and "e.txt" not in got
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), least_bytes=1, with_checksum=True).collect()) == ["a.txt", "b.txt", "c.txt"]


def test_highlight(spark):
    df = spark.createDataFrame([("a <b> License & more",), ("none",)], "t string")
    assert [r[0] for r in df.select(tx.highlighted(df["t"], ["license"])).collect()] == ["a &lt;b&gt; <mark>License</mark> &amp; more", "none"]
