"""Every registered query against its SQL."""

import decimal

import duckdb
import pytest

from placeworks.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    told = lambda v: repr(round(float(v), 9)) if isinstance(v, (float, decimal.Decimal)) else str(v)
    return sorted(columns), sorted(tuple(told(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    oracle = duck.sql(catalog.ORACLES[name])
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(oracle.fetchall(), oracle.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chain_of_the_sql_is_long_enough(spark, sf_dir, duck):
    from placeworks.plans import network

    more = network.PATHS + "SELECT count(*) FROM (SELECT site, v AS node, dist + w AS d FROM path JOIN edge ON node = u) x JOIN path p USING (site, node) WHERE x.d < p.dist"
    assert duck.sql(more).fetchall() == [(0,)]
