"""Every query against its SQL twin on the smallest tables; those without one only have to run."""

import oracle
import pytest

from statloom import catalog

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
FEW = {"funnel_report", "history_snapshot_debounce"}  # find nothing in so few rows, but do in ten times as many


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(con, catalog.queries()[name](spark, SF), catalog.oracle_sql()[name]) == ""
    found = con if name not in FEW else oracle.connect(LARGER)
    assert found.sql(f"SELECT count(*) FROM ({catalog.oracle_sql()[name]})").fetchall()[0][0] > 0


def test_blends_round_as_sql(spark):
    """Blends that end in a 5 at the seventh digit: few tables hold none."""
    d = "/root/testdata/sf0.1"
    assert oracle.compare(oracle.connect(d), catalog.queries()["cold_start_blend"](spark, d), catalog.oracle_sql()["cold_start_blend"]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
