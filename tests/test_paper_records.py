"""Records of papers in Arrow batches are those of the SQL, on odd texts too, and read a text once."""

import duckdb
import pytest

from loomspark.functions import rules as ru
from loomspark.operators import paper_records as pr
from loomspark.plans import documents, registry
from loomspark.sources import fixtures as fx
from tests import harness

registry.load()
LONG = "\n".join(f"Vendor: Firm {i % 7} Ltd.\nDate: 2020-01-{i % 28 + 1:02}\nEUR {i % 3},50 for the flight {'x' * (i % 90)}" for i in range(200))
TEXTS = (
    "Vendor: ACME Ltd.\nDate: 3.4.1999\nSum due EUR 1.234,50\nVendor: Acme Ltd.\n" + "x" * 60 + "\nVendor: aCME Ltd.\nSum due EUR 1.234,50",
    "Sum due EUR 1.125 on 2020-02-29 and $2.375", "on 2021-02-29 $7", "no day, $7", "January 5, 2020: 12,5 €; 3.4.5 USD; £1,234.567; usd 0; CHF 1.2.3", "", None, "\x01on 2020-01-01\x01 we paid \x01$5\x01 to\x01 Bo\x01b Smith\x02",
    "Übername\x0b2020-01-01 an Käufer: $5 und 7 € am 1/2/69 und 1-2-68 to Zoë", "ſ uſd 5, 7 uſd, sept 5, 2020, sep 5 2020", LONG, LONG + " refund", "tax " + LONG,
)
NAMES = ("invoice_1.pdf", "receipt.pdf", "kontoauszug.pdf", "übersicht.pdf", "my book.pdf", "CV_Bob.pdf", "payment confirmation.pdf", "tuition.pdf")


@pytest.fixture(scope="module")
def papers():
    rows = [(len(NAMES) * i + j, i, f"/a/{n}", t, fx.__name__ + str(i)) for i, t in enumerate(TEXTS) for j, n in enumerate(NAMES)]
    # a document that stands there twice, under two names
    return [*rows, (rows[0][0], 1, "/a/receipt.pdf", rows[0][3], rows[0][4])]


@pytest.fixture(scope="module")
def con(papers):
    c = duckdb.connect()
    c.execute("CREATE TABLE given (doc_id BIGINT, customer BIGINT, path VARCHAR, text VARCHAR, checksum VARCHAR)")
    c.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", papers)
    return c


def _docs(spark, papers):
    return spark.createDataFrame(papers, "doc_id long, customer long, path string, text string, checksum string")


def _same(got, cur):
    got, want = harness.rows(got.columns, [tuple(r) for r in got.collect()]), harness.rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(want[1]) > 10
    assert [r for r in got[1] if r not in want[1]] == [] and [r for r in want[1] if r not in got[1]] == [] and len(got[1]) == len(want[1])


def test_records_are_those_of_the_sql(spark, con, papers):
    _same(documents.records(_docs(spark, papers)), con.execute(f"SELECT * FROM {documents.RECORDS.replace(fx.STATEMENTS, 'given')}"))


def test_families_are_those_of_the_rules(spark, papers):
    import pyarrow as pa

    got = pr.families(pa.array([p[2] for p in papers]), pa.array([p[3] or "" for p in papers]))
    want = ru.with_family(ru.with_doc_type(_docs(spark, papers))).select("family").collect()
    assert list(got) == [r[0] for r in want]


def test_a_text_is_read_in_one_pass(spark, papers):
    plan = documents.records(_docs(spark, papers))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan


def _plan(spark, name):
    return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_upserts_read_records_once(spark):
    plan = _plan(spark, "record_upsert_stats")
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_only_linked_documents_are_read(spark):
    plan = _plan(spark, "linked_records_semi")
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("LeftSemi")


def _answers(spark, con, papers, monkeypatch, name):
    """A query and its SQL over the odd papers; the query's rows and its plan."""
    monkeypatch.setattr(documents.fx, "statements", lambda spark, sf: _docs(spark, papers))
    got = registry.QUERIES[name](spark, "")
    cur = con.execute(registry.SQL[name].replace(fx.STATEMENTS, "given"))
    got_rows, want = harness.rows(got.columns, [tuple(r) for r in got.collect()]), harness.rows([d[0] for d in cur.description], cur.fetchall())
    assert got_rows == want
    return got_rows[1], got._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_of_odd_papers(spark, con, papers, monkeypatch):
    rows, plan = _answers(spark, con, papers, monkeypatch, "answer_coverage")
    assert len(rows) == len(TEXTS) and any(r[-1] for r in rows)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_answers_of_odd_papers(spark, con, papers, monkeypatch):
    rows, plan = _answers(spark, con, papers, monkeypatch, "financial_answer")
    assert len(rows) == 10 and "regexp" not in plan
