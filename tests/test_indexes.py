"""Indexes and exact quantiles against plain versions."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import highlights
from loomspark.operators import path_index as pi
from loomspark.operators import search as s
from loomspark.operators import text_index as ti
from loomspark.operators import vector_index as vi
from loomspark.operators.quantiles import quantiles

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents over a skewed vocabulary, copies of one another, an empty and a null one; and their index."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[min(299, int(r.expovariate(0.03)))] for _ in range(r.randrange(1, 60))) for _ in range(400)]
    texts += texts[:30] + ["", None, "W1, w2 w3-w4! café w5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "i")
    ti.write_index(docs.select("doc_id", s.tokens(F.col("text")).alias("w")), path)
    return texts, docs, ti.read_index(spark, path)


def plain_bm25(texts, asked):
    w = [[x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x] for t in texts]
    n, avg, df = len(w), sum(map(len, w)) / len(w), Counter(x for d in w for x in set(d))
    out = {}
    for i, d in enumerate(w):
        tf = Counter(d)
        parts = [log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] / (tf[x] + s.K1 * (1 - s.B + s.B * len(d) / avg)) for x in set(asked) if x in tf]
        if parts:
            out[i] = sum(parts)
    return out


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_first_by_bm25_is_exact(spark, made, k):
    texts, _, index = made
    r = random.Random(k)
    asked = {i: [f"w{min(299, int(r.expovariate(0.02)))}" for _ in range(r.randrange(1, 12))] for i in range(25)} | {90: ["nowhere"], 91: [], 92: ["w0", "w1", "nowhere"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    for slack in (0.0, 0.5):
        got = {}
        for x in ti.bm25_first(index, queries, k, slack).collect():
            got.setdefault(x["query_id"], {})[x["doc_id"]] = x["score"]
        for i, terms in asked.items():
            scores = plain_bm25(texts, terms)
            least = sorted(scores.values(), reverse=True)[k - 1] if len(scores) >= k else 0
            want = {d: v for d, v in scores.items() if v >= least - slack - 1e-9}
            have = got.get(i, {})
            assert set(want) <= set(have) and all(abs(have[d] - scores[d]) < 1e-9 for d in have), (i, slack)
            assert all(v >= least - slack - 1e-6 for v in have.values())


def test_common_words_postings_are_left_out(spark, made):
    _, _, index = made
    queries = spark.createDataFrame([(1, ["w0", "w1", "w2", "w3", "w180", "w190", "w200", "w210"])], "query_id long, terms array<string>")
    read, every = ti.touched(index, queries, 3).select("read", "all_").first()
    assert 0 < read < 0.5 * every


def test_the_index_gives_what_scoring_every_document_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = ti.index_once(docs.select("doc_id", s.tokens(F.col("text")).alias("w")), "documents", [f"{SF}/documents.parquet"])
    best = lambda h: {(x["query_id"], x["doc_id"], x["score"]) for x in s.top_k(h.withColumn("score", F.round("score", 9)), 20, F.desc("score"), F.asc("doc_id")).collect()}
    assert best(ti.bm25_first(index, q.select("query_id", s.tokens(F.col("text")).alias("terms")), 20)) == best(s.bm25(docs, q))
    # a second caller finds what the first one built; other rows are another index
    again = lambda d: ti.index_once(d.select("doc_id", s.tokens(F.col("text")).alias("w")), "documents", [f"{SF}/documents.parquet"])
    assert again(spark.read.parquet(f"{SF}/documents.parquet")).by_doc.inputFiles() == index.by_doc.inputFiles()
    assert again(docs.where("doc_id < 5")).n == 5 and index.n == docs.count()


def test_items_in_texts(spark, made):
    texts, docs, index = made
    needles = ["w1, w2", "1 w", "w", "w3-w4! ca", "é", "! ", "", None, "nowhere at all", "W1", "w12 ", " w0 w0 ", "x y", texts[5], texts[5][1:-1], "zz"]
    items = spark.createDataFrame(list(enumerate(needles)), "query_id long, needle string")
    want = {(i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if n is not None and t is not None and n in t}
    assert {tuple(x) for x in ti.holding(index, docs, items).select("query_id", "doc_id").collect()} == want


def test_paths_by_runs(spark, tmp_path):
    r = random.Random(2)
    paths = [f"/Corpus/src{r.randrange(9)}/{r.choice(['En', 'de'])}/Doc_{i}.{r.choice(['pdf', 'TXT'])}" for i in range(300)] + ["/x", "", None, "/aaaa/aaaa"]
    pi.write_index(spark.createDataFrame([(p,) for p in paths], "path string"), str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p/postings")), spark.read.parquet(str(tmp_path / "p/grams"))
    terms = ["doc 12", "SRC3/en", "aaa", "aaaaaa", "pd", "", None, "nowhere", "Doc_7.pdf", "endoc"]
    plain = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(t, p) for t in terms if t is not None and len(plain(t)) >= 3 for p in paths if p is not None and plain(t) in plain(p)}
    assert {tuple(x) for x in pi.find_paths(index, df).collect()} == want
    assert pi.candidates(index, df).count() < 0.5 * len(paths) * len(terms)


def test_quantiles_are_exact(spark):
    r = random.Random(6)
    rows = [("a", r.gauss(0, 1)) for _ in range(501)] + [("hot", 5.0)] * 300 + [("hot", 1e12), ("hot", -1e-9)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None)]
    rows += [("wide", 10.0 ** r.randrange(-300, 300)) for _ in range(99)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"least": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "most": 1.0}
    got = {x["g"]: x for x in quantiles(df, ["g"], "v", shares).collect()}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        for name, p in shares.items():
            assert got[g][name] == (pytest.approx(float(np.quantile(v, p)), rel=1e-9) if v else None), (g, name)
    assert tuple(quantiles(df.where("g = 'a'"), [], "v", {"mid": 0.5}).first()) == (pytest.approx(float(np.median([x for g, x in rows if g == "a"]))),)
    assert quantiles(df.where("false"), [], "v", {"mid": 0.5}).collect()[0]["mid"] is None


def test_vectors_by_lists_have_recall(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    odd = spark.createDataFrame([(-1, None, 1), (-2, [0.0] * 64, 2)], v.schema)
    v = v.unionByName(odd)
    q = v.where("id % 50 = 0 and id >= 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    vi.write_index(v, str(tmp_path / "v"), ("label",))
    index = vi.read_index(spark, str(tmp_path / "v"))
    assert index.codes.count() == v.count()
    exact = {(x["query_id"], x["id"]) for x in s.top_k(s.cosine_hits(v.where("embedding is not null"), q), 20, F.desc("score"), F.asc("id")).collect()}
    found = vi.nearest(index, v, q, 20, probes=len(index.centroids) * 2 // 3).collect()
    assert len({(x["query_id"], x["id"]) for x in found} & exact) / len(exact) >= 0.9
    # all lists, all refined: the exact result; filters hold for every row
    whole = vi.nearest(index, v.where("embedding is not null"), q, 20, probes=len(index.centroids), refine=1000).collect()
    assert {(x["query_id"], x["id"]) for x in whole} == exact
    labelled = vi.nearest(index, v.drop("label"), q, 5, probes=len(index.centroids), where=F.col("label") == 3).join(v.select("id", "label"), "id").collect()
    assert labelled and all(x["label"] == 3 for x in labelled)
    assert vi.nearest(index, v, q.limit(0), 5, probes=2).count() == 0


def test_fragments(spark):
    text = "Nothing here. The <b>cat</b> & the Cat's hat! Dog cat.\n" + "x" * 250 + " cat dog bird? It's over"
    docs = spark.createDataFrame([(1, text), (2, "no words\tof it <i>"), (3, None), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, ["cat", "dog", "bird", "hat"])], "query_id long, terms array<string>")
    hits = spark.createDataFrame([(7, d) for d in (1, 2, 3, 4)], "query_id long, doc_id long")
    got = {r["doc_id"]: r["fragments"] for r in highlights.highlighted(hits, docs, queries).collect()}
    m = lambda x: f"<mark>{x}</mark>"
    assert got[1] == ["x" * 50 + f" {m('cat')} {m('dog')} {m('bird')}?", f"The &lt;b&gt;{m('cat')}&lt;/b&gt; &amp; the {m('Cat')}&#x27;s {m('hat')}!", f"{m('Dog')} {m('cat')}."]
    assert got[2] == ["no words of it &lt;i&gt;"] and got[3] == got[4] == []
