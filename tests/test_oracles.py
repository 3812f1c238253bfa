"""Every registered query of the package's own operators against its DuckDB SQL, over whole tables."""

import datetime
import math
import os

import duckdb
import pytest

from plumbline.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    made = tables.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [[row[i] for i in order] for row in made.fetchall()]
    assert sorted(repr(plain(list(r))) for r in got) == sorted(repr(plain(r)) for r in expected)


def test_queries_without_sql_give_rows(spark):
    assert registry.QUERIES["signed_rank_p"](spark, SF).count() > 0


def test_all_names_of_the_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
