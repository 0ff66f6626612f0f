"""Every query against its SQL twin; those without one must run and give rows."""

import pytest

from sparkloom.plans import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_result_is_empty(duck):
    """A twin without rows would prove nothing."""
    empty = [name for name, sql in ORACLES.items() if not duck.sql(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]]
    assert empty == []
