"""Likeness of documents is that of their whole texts."""

import pytest

from loomspark.plans import evaluation, registry

registry.load()
SIDE = " ".join(f"w{i}" for i in range(4000))


@pytest.fixture
def sf(spark, tmp_path, monkeypatch):
    """A pair of documents that differ in their middles alone, far from both ends, and one document as both of a pair."""
    middle = [" ".join(f"{x}{i}" for i in range(2000)) for x in "pq"]
    docs = [(i, f"{SIDE} {m} {SIDE}") for i, m in enumerate(middle)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(evaluation, "rows", lambda spark, sf: spark.createDataFrame([(1, 0, 1, 1), (2, 0, 0, 1)], "query_id long, expected long, top1 long, rank long"))
    return str(tmp_path)


def test_words_in_the_middle_count(spark, sf):
    got = {r["query_id"]: (r["jaccard"], r["containment"]) for r in registry.QUERIES["near_duplicate_text"](spark, sf).collect()}
    assert got == {1: (0.5, round(4000 / 6000, 4)), 2: (1.0, 1.0)}


def test_characters_in_the_middle_count(spark, sf):
    got = {r["query_id"]: r for r in registry.QUERIES["answer_similarity"](spark, sf).collect()}
    assert (got[1]["jaccard"], got[1]["near_duplicate"], got[1]["likelihood"]) == (0.5, False, "possibly_correct_top3")
    assert got[1]["ratio"] < 0.95 and got[2]["ratio"] == 1.0
