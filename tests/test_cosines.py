"""Exact cosine search that keeps what can't be among the first in its task."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import search as s


def _vectors(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(i, [round(rnd.gauss(0, 1), 1) for _ in range(4)], rnd.randrange(5)) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(2 * n, None, 1), (2 * n + 1, [0.0] * 4, None), (2 * n + 2, [1.0, None, 0.0, 0.0], 2), (2 * n + 3, [1.0, 2.0], 3), (2 * n + 4, rows[3][1], None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("n", [3, 60, 400])
def test_first_cosines_are_those_of_all_pairs(spark, n, monkeypatch):
    monkeypatch.setattr(s, "SENT", 7)
    monkeypatch.setattr(s, "COMPARED", 3)
    v = _vectors(spark, max(n, 20), n)
    q = v.where("id % 5 = 0 and embedding is not null and size(embedding) = 4").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")).limit(20)
    every, some = s.cosine_hits(v, q), s.cosine_first(v, q, 6)
    first = lambda h: sorted(tuple(r) for r in s.top_k(h.withColumn("score", F.round("score", 9)), 6, F.desc("score"), F.asc("id")).collect())
    assert first(some) == first(every)
    best = lambda h: sorted(tuple(r)[:3] for r in s.first_per_key(h.withColumn("score", F.round("score", 9)).where("score >= 0.25").join(v.select("id", "label"), "id").select("query_id", "id", "score", "label"), "label", F.desc("score"), F.asc("id")).collect())
    assert best(s.cosine_first(v, q, 1, least=0.25 - s.SLACK, by="label")) == best(every)


def test_pairs_that_cannot_be_first_stay_in_their_task(spark):
    v = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + i * i).cast("float")).alias("embedding")).repartition(2)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    # all pairs are 180,000 rows
    assert s.cosine_first(v, q, 10).count() <= 60 * 10 * 2 * 3


def test_questions_of_uneven_lengths_meet_every_vector(spark):
    v = _vectors(spark, 20, 1)
    q = v.where("id in (0, 40, 43)").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    assert s.cosine_first(v, q, 2).count() == 3 * v.count()


def test_nearest_centroids_are_found_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from loomspark.operators import vector_index as vi

    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(20_000, 16)), rng.normal(size=(500, 16))
    tracemalloc.start()
    got = vi._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[::997] == np.argmin(((x[::997, None] - c) ** 2).sum(2), axis=1)).all()
    # all distances at once are 80 MB
    assert peak < 20e6
