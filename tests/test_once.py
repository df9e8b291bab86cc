"""Work that a query needs more than once, or for several kinds of rows, is done once."""

from pyspark.sql import functions as F

import __spark_entry__ as e
from loomspark.functions import text as tx

SF = "/root/testdata/sf0.001"


def test_windows_by_sizes_of_rows_are_those_of_each_size(spark):
    docs = spark.createDataFrame([(i, "abcdefghij" * i, 7 + i % 3) for i in range(12)] + [(90, None, 7), (91, "", 8)], "doc_id long, text string, size int")
    got = {tuple(r) for r in tx.fixed_windows(docs, F.col("size"), F.col("size") - 2, "size").collect()}
    want = {(r["doc_id"], n, *r[1:]) for n in (7, 8, 9) for r in tx.fixed_windows(docs.where(F.col("size") == n), n, n - 2).collect()}
    assert got == want and {x[0] for x in got} == {*range(12), 91}


def test_papers_are_classified_and_records_made_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # what a customer's records are made of isn't made again for the papers without records
    assert "Generate" not in plan(e.queries()["financial_answer"](spark, SF))
