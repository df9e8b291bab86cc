import corpus_pipeline
from loomspark.llm import pii
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        was, now = rows(before), None
        if name != "packing":
            assert after.columns == docs.columns
            now = rows(after)
        if name == "quality":
            assert set(now) <= set(was) and 0 < len(now) < len(was)
        elif name == "near_duplicates":
            keep = {c for _, c in brute.near(was).values()}
            assert now == [r for r in was if r[0] in keep]
        elif name == "decontamination":
            bad = {r[0] for r in brute.contamination(was, bench) if r[-1]}
            assert now == [r for r in was if r[0] not in bad]
        elif name == "personal_data":
            assert [r[0] for r in now] == [r[0] for r in was] and all(not pii.base_spans(t) for _, t in now)
        else:
            assert {r["doc_id"] for r in after.collect()} == {r[0] for r in was}
        before = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, before.select("doc_id", "piece", "length").collect()))
