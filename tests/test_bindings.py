import math

import duckdb
import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.plans import bindings

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = bindings.QUERIES[name](spark, D)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({bindings.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_t_tail_closed_forms(spark):
    rows = spark.createDataFrame([(t,) for t in (0.0, 0.3, 1.0, -2.5, 12.0)], "t double").select("t", tails.t_two_sided(F.col("t"), F.lit(1.0)).alias("p1"), tails.t_two_sided(F.col("t"), F.lit(2.0)).alias("p2"))
    for r in rows.collect():
        assert r.p1 == pytest.approx(1 - 2 / math.pi * math.atan(abs(r.t)), abs=1e-9)
        assert r.p2 == pytest.approx(1 - abs(r.t) / math.sqrt(2 + r.t * r.t), abs=1e-9)


def test_sql_of_clusters_leaves_no_tie_to_chance():
    """Many equal intervals in many orders: clusters count from 1, and one of two equal intervals opens none."""
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem AS SELECT i % 150000 AS l_orderkey, i // 150000 + 1 AS l_linenumber, CAST(hash(i) % 4 * 10 AS DOUBLE) AS l_quantity, 1.0 AS l_extendedprice FROM range(1050000) t(i)")
    for name in ("overlap_clusters", "components"):
        con.sql(f"CREATE TABLE {name} AS {bindings.ORACLE_SQL[name]}")
    assert con.sql("SELECT count(*) FROM (SELECT o, min(cluster) AS a, max(cluster) AS b, count(DISTINCT start) AS n FROM overlap_clusters GROUP BY 1) WHERE a <> 1 OR b <> n").fetchall() == [(0,)]
    wrong = "SELECT count(*) FROM components c JOIN lineitem x ON c.o = l_orderkey AND c.i = l_linenumber JOIN (SELECT l_orderkey AS p, l_quantity AS q, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) ON p = c.o AND q = x.l_quantity WHERE first <> component"
    assert con.sql(wrong).fetchall() == [(0,)]
