"""Queries against their SQL on small tables made to hold what the driver's small ones do not."""

import duckdb
import pytest
from test_oracles import plain

from plumbline.plans import registry


def differing(spark, name, folder):
    """Rows of the query and of its SQL over the parquet tables in a folder, sorted."""
    con = duckdb.connect()
    for at in folder.iterdir():
        con.execute(f"CREATE VIEW {at.name.removesuffix('.parquet')} AS SELECT * FROM '{at}/*.parquet'")
    made = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in made.description]
    expected = sorted(repr(plain(list(r))) for r in made.fetchall())
    return sorted(repr(plain(list(r))) for r in registry.QUERIES[name](spark, str(folder)).select(*names).collect()), expected


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return tmp_path

    return write


def test_poses_without_a_baseline(spark, table):
    """Customers whose numbers are divisible by 71 all stand at the origin."""
    folder = table("customer", [(k, n) for n, ids in {5: (71, 142, 150), 6: (213, 214)}.items() for k in ids], "c_custkey long, c_nationkey int")
    got, expected = differing(spark, "relative_pose_error", folder)
    assert got == expected and sum("None" in r for r in got) == 1
