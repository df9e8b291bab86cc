"""Operators that change tables, cluster vectors, read files and apply small rules, on literal inputs and against plain versions."""

import datetime
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import clusters as cl
from loomspark.functions import fields as fi
from loomspark.functions import money as mo
from loomspark.functions import rules as ru
from loomspark.operators import retrieve as r
from loomspark.operators import sinks
from loomspark.plans import sync


def one(spark, column, *values):
    """A column expression over one text column t, for each of the values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [x[0] for x in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_tables_change_by_versions(spark):
    t = sinks.Table.fresh(spark.createDataFrame([(1, "a", ["x"]), (2, None, []), (3, "c", None)], "k long, v string, l array<string>"), ["k"])
    first = t.version()
    n = t.merge(spark.createDataFrame([(2, "b", ["y"]), (4, "d", None)], "k long, v string, l array<string>"))
    assert (n["created"], n["updated"], n["kept"]) == (1, 1, 2)
    assert sorted(map(tuple, t.read().select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert t.read(first).count() == 3  # the old version is still there
    t.merge(spark.createDataFrame([(1, "z", ["new"]), (3, "z", ["new"]), (9, "z", None)], "k long, v string, l array<string>"), insert=False, fill_only=True)
    assert sorted((x["k"], x["v"], x["l"]) for x in t.read().collect()) == [(1, "a", ["x"]), (2, "b", ["y"]), (3, "c", ["new"]), (4, "d", None)]
    assert t.update(F.col("k") == 4, v=F.lit("dd")) == 1 and t.delete(F.col("l").isNull()) == 1
    assert t.delete_keys(spark.createDataFrame([("a",), (None,)], "v string"), "v") == 1
    t.append(spark.createDataFrame([(7, "g")], "k long, v string"))
    assert sorted(x["k"] for x in t.read().collect()) == [2, 3, 7]


def test_tables_without_versions_and_errors(spark):
    t = sinks.Table(spark, sinks.folder(spark), ["k"], "k long, v string")
    assert t.version() == 0 and t.read().count() == 0 and t.delete(F.col("k") == 1) == 0
    bad = sinks.indexed(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), t, ("k", "v"))
    assert [tuple(x) for x in bad.collect()] == [(2, "missing v")] and t.read().count() == 1


def test_vectors_are_cleaned_and_checked(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), None],)], "v array<float>")
    assert df.select(sinks.clean_vectors(F.col("v"), 4)).first()[0] == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="a vector needs 3 values"):
        df.select(sinks.clean_vectors(F.col("v"), 3)).collect()


def test_cache_keys():
    assert sinks.Cache.key({"a": 1, "b": 2}, 3, "x") == sinks.Cache.key({"b": 2, "a": 1}, 3, "x") != sinks.Cache.key({"a": 1, "b": 2}, 4, "x")


def test_density_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (40, 3)), rng.normal(1, 0.05, (30, 3)), rng.normal((3, 0, 0), 0.05, (25, 3)), rng.uniform(-6, 6, (12, 3))])
    labels, prob = cl.density_clusters(x, 10, 5)
    for a, b in ((0, 40), (40, 70), (70, 95)):
        kinds, counts = np.unique(labels[a:b], return_counts=True)
        assert counts.max() >= 0.9 * (b - a) and kinds[np.argmax(counts)] >= 0
    assert len(set(labels[labels >= 0])) == 3 and (labels[95:] == -1).mean() > 0.7
    assert ((prob >= 0) & (prob <= 1)).all() and (prob[labels == -1] == 0).all()
    assert cl.density_clusters(x[:1], 5, 5)[0].tolist() == [-1]


def test_spanning_tree_is_least():
    rng = np.random.default_rng(3)
    d = rng.random((9, 9))
    d = np.minimum(d, d.T)
    root, total = list(range(9)), 0.0
    for w, a, b in sorted((d[i, j], i, j) for i in range(9) for j in range(i)):
        if root[a] != root[b]:
            total += w
            root = [root[a] if x == root[b] else x for x in root]
    assert abs(cl.spanning_tree(d)[:, 0].sum() - total) < 1e-12


def test_average_linkage_and_silhouette():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.1, (4, 5)) for m in (np.eye(5)[0], np.eye(5)[1], np.eye(5)[2])])
    d = cl.cosine_distances(x)
    labels = cl.average_linkage(d, 3)
    assert labels.tolist() == [0] * 4 + [1] * 4 + [2] * 4
    plain = []
    for i in range(12):
        own = [d[i, j] for j in range(12) if j != i and labels[j] == labels[i]]
        other = min(np.mean([d[i, j] for j in range(12) if labels[j] == g]) for g in range(3) if g != labels[i])
        plain.append((other - np.mean(own)) / max(other, np.mean(own)))
    assert abs(cl.silhouette(d, labels) - np.mean(plain)) < 1e-12
    groups, how = cl.macro_groups(x, np.ones(12), (2, 6))
    assert how["k"] == 3 and groups.tolist() == labels.tolist()
    assert cl.macro_groups(x[:2], np.ones(2))[1]["k"] == 1


def test_the_largest_group_is_split():
    c = np.array([[1, 0, 0], [1, 0.3, 0], [0, 1, 0], [0, 0, 1.0]])
    out = cl.split_largest(np.array([0, 0, 0, 1]), c, np.array([5.0, 4, 3, 2]))
    assert len(set(out[:3].tolist())) == 2 and out[0] == out[1] and out[3] == 1
    assert cl.split_largest(np.array([0, 1, 2]), c[:3], np.ones(3)).tolist() == [0, 1, 2]


def test_diverse_rows():
    x = np.array([[1, 0], [1, 0.01], [0.7, 0.7], [0, 1]])
    assert cl.diverse(x, np.array([1.0, 0.0]), 3) == [0, 2, 3] and cl.diverse(x, np.array([1.0, 0.0]), 4) == [0, 2, 3, 1]


def test_dates(spark):
    text = "on 2020-02-30 or 2020-2-9, 05.03.1996, 5/3/69 and 5/3/68, 1.2-2020, March 5, 1996; Sept 3 2001; Sep 3 2001 x may 12 99"
    assert one(spark, mo.dates, text, None, "") == [["1969-03-05", "1996-03-05", "2001-09-03", "2020-02-09", "2068-03-05"], [], []]


def test_amount_matches(spark):
    got = one(spark, mo.amounts, "Pay EUR 1.234,50 or $7 now; 12,5 € later, usd 0", None)
    assert [(a["span"], a["amount"], a["currency"], a["start"]) for a in got[0]] == [("EUR 1.234,50", 1234.5, "EUR", 4), ("$7", 7.0, "USD", 20), ("12,5 €", 12.5, "EUR", 28)] and got[1] == []


def test_counterparty_and_signals(spark):
    assert one(spark, mo.counterparty, "Vendor: Acme Ltd., \nx", "nothing here", None) == ["Acme Ltd", None, None]
    assert one(spark, ru.tax_signals, "VAT and tax, vat; taxi", None) == [["vat", "tax"], []]


def test_document_types(spark):
    rows = [("/a/Cover_Letter.pdf", "invoice number"), ("/a/x.pdf", "Work Experience at"), ("/papers/new-paper.pdf", None), ("/a/x.pdf", None), ("/b/Behörde.pdf", ""), ("/a/übill.txt", "")]
    got = ru.with_doc_type(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, path string, text string")).orderBy("i").collect()
    assert [(x["doc_type"], x["confidence"]) for x in got] == [("cover_letter", 0.98), ("cv", 0.88), ("research_paper", 0.95), ("other", 0.25), ("government_form", 0.95), ("other", 0.25)]


def test_persons(spark):
    df = spark.createDataFrame([(1, "/x/CV_Ali_Hawa_2024.pdf"), (2, "/x/cv.pdf"), (3, "/x/anna-maria_BEER_extra_long.txt"), (4, "/x/Ali_Hawa_final_Otto.pdf")], "doc_id long, path string")
    assert {x["doc_id"]: x["person"] for x in ru.file_persons(df).collect()} == {1: "Ali Hawa", 3: "Anna Maria Beer", 4: "Ali Hawa"}
    assert one(spark, ru.text_person, "Curriculum vitae\nEducation\nMaria  de Lopez\nMaria Lopez", None) == ["Maria Lopez", None]


def test_small_rules(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (1280,), (5 << 30,), (None,)], "n long")
    assert [x[0] for x in sizes.select(fi.file_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KB", "1.2 KB", "5.0 GB", "0 B"]
    assert one(spark, fi.processed_name, "o'neil 3d", " misc ", "--", "a b c d e f g") == ["O'Neil 3D", "Untitled", "Untitled", "A B C D E F"]
    assert one(spark, lambda c: fi.label_match(c, ("Tax", "Travel")), "'tax'", "my travel tax", "x", None) == ["Tax", "Tax", "", ""]
    assert one(spark, fi.answer_status, "", None, "I don't know.", "[LLM Error: x]", "❌ retrieval failed.", "❌ other", "yes") == ["fallback", "fallback", "fallback", "error", "fallback", "error", "answer"]
    assert one(spark, lambda c: fi.reason_value(c, "content"), "meta=0.5; content = 0.25", "content=x", "", None) == [0.25, None, None, None]
    assert one(spark, fi.snippets, "One. Two!  Three", " a \n\n b", "") == [["One.", "Two!", "Three"], ["a", "b"], []]


def test_names_are_told_apart_as_the_rule_says(spark):
    df = spark.createDataFrame([(1, "Alpha", "finance"), (2, "Alpha", ".pdf"), (3, "Alpha", None), (4, "Beta", None), (5, "Alpha", "finance"), (6, "Alpha", "x")], "n int, name string, differentiator string")
    got = {x["n"]: x["name"] for x in fi.disambiguated(df).collect()}
    assert [got[i] for i in range(1, 5)] == ["Alpha", "Alpha (Finance)", "Alpha (Pdf)", "Beta"] and got[5] == "Alpha (2)"


def test_path_prefixes(spark):
    paths = spark.createDataFrame([("C:\\docs\\a.txt",), ("c:/Docs/Old/b",), ("/srv/c",)], "path string")
    pairs = spark.createDataFrame([("C:/", "/c"), ("C:/Docs/Old", "/old/")], "source string, target string")
    assert {x["path"]: x["mapped"] for x in fi.mapped_paths(paths, pairs).collect()} == {"C:\\docs\\a.txt": "/c/docs/a.txt", "c:/Docs/Old/b": "/old/b", "/srv/c": "/srv/c"}


def test_reconciliation(spark):
    index = spark.createDataFrame([("a", "/r/a", ["/r/a2"], False), ("b", "/r/b", [], False), ("c", "/r/c", [], False), ("d", "/off/d", [], False), ("e", "/r/e", [], True), ("f", "/r/f", [], False)], "checksum string, canonical string, aliases array<string>, duplicated boolean")
    disk = spark.createDataFrame([("/r/a", "a"), ("/r/a3", "a"), ("/r/moved", "b"), ("/r/new", "n"), ("/r/e", "e"), ("/r/f", "g")], "path string, checksum string")
    got = {x["checksum"]: (x["bucket"], x["reasons"], x["new_canonical"], x["adds"], x["removes"]) for x in sync.reconciled(index, disk, ("/r",)).collect()}
    assert got == {
        "a": ("SAFE", "ADD_ALIAS;REMOVE_ALIAS", None, ["/r/a3"], ["/r/a2"]), "b": ("SAFE", "ADD_ALIAS;SET_CANONICAL", "/r/moved", ["/r/moved"], []), "c": ("REVIEW", "ORPHANED_INDEX_CONTENT", None, [], []),
        "e": ("BLOCKED", "DUPLICATE_INDEX_DOCS", None, [], []), "f": ("REVIEW", "PATH_REPLACED", None, [], []), "g": ("INFO", "NOT_INDEXED", None, ["/r/f"], []), "n": ("INFO", "NOT_INDEXED", None, ["/r/new"], []),
    }


def test_question_traits(spark):
    rows = [(1, "Where is it?"), (2, "the cv of Ada"), (3, "list all files"), (4, "when did this person study at university"), (5, "bitcoin price today"), (6, 'say "exact words" again'), (7, "")]
    got = {x["query_id"]: x for x in r.traits(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    assert [got[i]["anchored"] for i in range(1, 8)] == [False, True, False, False, False, True, False]
    assert got[3]["discovery"] and not got[3]["question"] and got[1]["question"] and got[2]["canonical"] and got[4]["profile"] and got[4]["when_"] and not got[4]["where_"]
    assert got[5]["abroad"] and got[5]["recent"] and not got[5]["home"] and got[7]["content"] == []


def test_mmr_against_a_plain_version(spark):
    from loomspark.operators import search as s

    rng = random.Random(4)
    rows = [(1, i, rng.random(), [rng.uniform(-1, 1) for _ in range(3)], [1.0, 0.5, 0.2]) for i in range(30)]
    got = s.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, v array<double>, q array<double>"), 6).orderBy("place").collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    top, low = max(x[2] for x in rows), min(x[2] for x in rows)
    chosen, left = [], sorted(rows, key=lambda x: (-x[2], x[1]))
    while len(chosen) < 6:
        best = max(left, key=lambda x: 0.6 * (0.5 * (cos(x[3], x[4]) + 1) / 2 + 0.5 * (x[2] - low) / (top - low)) - 0.4 * max([0.0, *(cos(x[3], y[3]) for y in chosen)]))
        chosen.append(best)
        left.remove(best)
    assert [x["id"] for x in got] == [x[1] for x in chosen]


def test_loaders(spark, tmp_path):
    from loomspark.sources import files

    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"one|two")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    got = sorted((x["path"].rsplit("/", 1)[1], x["page"], x["text"]) for x in files.documents(spark, str(tmp_path), {"pdf": lambda b: b.decode().split("|")}).collect())
    assert got == [("a.txt", 0, "plain"), ("b.docx", 0, "Hello you\nend"), ("p.pdf", 0, "one"), ("p.pdf", 1, "two")]


def test_times(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (0,), (None,)], "v long")
    assert [x[0] for x in df.select(fi.epoch_text(F.col("v"))).collect()] == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", "", ""]
    at = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 0, 5),), (datetime.datetime(2024, 1, 2, 13, 5),)], "t timestamp_ntz")
    assert [x[0] for x in at.select(fi.ampm(F.col("t"))).collect()] == ["2024-01-02 12:05 AM", "2024-01-02 1:05 PM"]
