"""Every query of the library against the SQL it is registered with."""

import datetime
import math

import duckdb
import pytest

from quadrel.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if isinstance(v, int | float) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
