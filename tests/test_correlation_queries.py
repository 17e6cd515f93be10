"""Queries of correlations give what their SQL gives where a value doesn't vary."""

import duckdb
import pytest

from assaylake.plans import bindings


@pytest.mark.parametrize("name", ["pearson", "point_biserial", "spearman"])
def test_flat_values_as_in_sql(spark, tmp_path, name):
    rows = [(1, "RARA"[i], 5.0, i) for i in range(4)] + [(2, "RRRR"[i], float(i), i) for i in range(4)] + [(3, "RARA"[i], float(i), 1) for i in range(4)] + [(4, "RAAR"[i], float(i * i), i) for i in range(4)] + [(5, "RA"[i], 2.0, i) for i in range(2)]
    spark.createDataFrame(rows, "l_partkey long, l_returnflag string, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = bindings.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({bindings.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
