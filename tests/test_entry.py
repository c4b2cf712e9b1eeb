"""The driver contract: names, and queries against DuckDB on the smallest tables where they are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
CHECKED = (
    "text_gate", "id_checksum", "id_structural", "dates_numeric", "amount_parse", "amount_words", "fields_struct", "needs_review",
    "cer_eval", "field_totals", "prediction_names", "lines_from_words", "gaps_cuts", "pairing_ratio", "render_document", "bakeoff",
)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKED) <= set(entry.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = db.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert rows(expected.select(*columns).fetchall()) == rows(found.select(*columns).collect())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
