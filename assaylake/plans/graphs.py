"""Queries of intervals, splicing and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import network, splicing
from assaylake.plans.bindings import bound
from assaylake.sources.tables import table


def _spans(spark, d):
    """An order's line numbers as intervals of quantity, 3 wide, with their prices as reads. Line numbers repeat in an order,
    so each counts once, with its least quantity."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"))
    x = x.agg(F.min("l_quantity").cast("long").alias("start"), F.sum("l_extendedprice").alias("reads"))
    return x.select("o", "i", "start", (F.col("start") + 3).alias("end"), "reads")


_SPANS = "SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) i, CAST(min(l_quantity) AS BIGINT) s, CAST(min(l_quantity) AS BIGINT) + 3 AS e, sum(l_extendedprice) AS r FROM lineitem GROUP BY 1, 2"
_CLUSTERS = f"SELECT o, i, s, e, CAST(sum(new) OVER (PARTITION BY o ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY o ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM ({_SPANS}))"


@bound(f'SELECT o, s AS start, e AS "end", cluster FROM ({_CLUSTERS})')
def overlap_clusters(spark, d):
    return splicing.clusters(_spans(spark, d), ["o"]).select("o", "start", "end", "cluster")


@bound(f"""WITH c AS ({_CLUSTERS}), k AS (SELECT o, cluster, s AS p FROM c UNION SELECT o, cluster, e FROM c), r AS (SELECT o, cluster, p AS start, lead(p) OVER w AS "end", row_number() OVER w AS region FROM k WINDOW w AS (PARTITION BY o, cluster ORDER BY p)) SELECT * FROM r WHERE "end" IS NOT NULL""")
def exon_regions(spark, d):
    return splicing.regions(_spans(spark, d), ["o"]).select("o", "cluster", "start", "end", "region")


@bound(f"""WITH a AS ({_SPANS}) SELECT o, i, round(r / (r + x), 6) + 0.0 AS psi FROM (SELECT a.o, a.i, a.r, coalesce(sum(b.r), 0) AS x FROM a LEFT JOIN a b ON a.o = b.o AND a.i <> b.i AND a.s <= b.e AND b.s <= a.e GROUP BY ALL)""")
def overlap_psi(spark, d):
    out = splicing.overlap_psi(_spans(spark, d).select(F.col("o").alias("gene"), F.col("i").alias("junction"), "start", "end", "reads"), 16.0)
    return out.select(F.col("gene").alias("o"), F.col("junction").alias("i"), "psi")


@bound("""SELECT feature, round(p1, 6) + 0.0 AS psi_one, round(p2, 6) + 0.0 AS psi_two, round(p1 - p2, 6) + 0.0 AS dpsi FROM (SELECT feature, i1 / a1 AS p1, i2 / a2 AS p2 FROM (SELECT CAST(l_partkey AS BIGINT) feature,
  coalesce(sum(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = 'R' AND l_linenumber <= 3), 0) i1, coalesce(sum(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = 'R'), 0) a1,
  coalesce(sum(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = 'A' AND l_linenumber <= 3), 0) i2, coalesce(sum(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = 'A'), 0) a2 FROM lineitem GROUP BY 1) WHERE a1 >= 9 AND a2 >= 9) WHERE abs(p1 - p2) > 0.15""")
def delta_psi(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("grp"), (F.col("l_linenumber") <= 3).alias("included"), F.col("l_quantity").cast("double").alias("reads"))
    return splicing.delta_psi(x, "R", "A")


@bound("SELECT gene, round(CASE WHEN a <= 9 THEN NULL WHEN i <= 9 THEN 0.0 ELSE i / a END, 6) + 0.0 AS share FROM (SELECT CAST(l_orderkey AS BIGINT) gene, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) i, sum(CAST(l_quantity AS DOUBLE)) a FROM lineitem GROUP BY 1)")
def intron_share(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene"), F.when(F.col("l_returnflag") == "N", "intron").otherwise("exon").alias("kind"), F.col("l_quantity").cast("double").alias("reads"))
    return splicing.retained(x)


_ISO = "SELECT p_brand AS gene, CAST(p_size AS BIGINT) AS isoform, l_returnflag AS sample, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"


def _isoforms(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_brand").alias("gene"), F.col("p_size").cast("long").alias("isoform"), F.col("l_returnflag").alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


@bound(f"SELECT gene, isoform, sample, round(value / sum(value) OVER (PARTITION BY gene, sample), 6) + 0.0 AS share, row_number() OVER (PARTITION BY gene, sample ORDER BY value DESC, isoform) = 1 AS main FROM ({_ISO})")
def isoform_ratio(spark, d):
    return splicing.predominant(_isoforms(spark, d))


@bound(f"SELECT isoform AS feature, gene, sample, round(log2(value + 1) - avg(log2(value + 1)) OVER (PARTITION BY gene, sample), 6) + 0.0 AS value FROM ({_ISO})")
def splicing_index(spark, d):
    logged = _isoforms(spark, d).withColumn("value", F.log2(F.col("value") + 1))
    genes = logged.groupBy("gene", "sample").agg(F.avg("value").alias("value"))
    return splicing.splicing_index(logged.withColumnRenamed("isoform", "feature"), genes)


@bound(f"SELECT o, i, min(i) OVER (PARTITION BY o, cluster) AS component FROM ({_CLUSTERS})")
def components(spark, d):
    """Overlapping intervals of an order are edges, and every interval has one to itself; a node is its order and line."""
    s = _spans(spark, d)
    met = s.join(s.select("o", F.col("i").alias("j"), F.col("start").alias("s2"), F.col("end").alias("e2")), "o").where("i <= j AND start <= e2 AND s2 <= end")
    found = network.components(met.select(F.struct("o", "i").alias("a"), F.struct("o", F.col("j").alias("i")).alias("b")), "a", "b")
    return found.select("node.o", "node.i", F.col("component.i").alias("component"))


_LINKS = "SELECT 'r' || n_regionkey a, 'n' || n_nationkey b FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


def _links(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s, c = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    return n.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))


@bound(f"""WITH RECURSIVE l AS ({_LINKS}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w AS (SELECT DISTINCT a AS source, a AS node, 0 AS steps FROM e WHERE a LIKE 'r%' UNION SELECT w.source, e.b, w.steps + 1 FROM w JOIN e ON e.a = w.node WHERE w.steps < 4)
  SELECT source, node, CAST(min(steps) AS BIGINT) AS steps FROM w GROUP BY 1, 2""")
def shortest_path(spark, d):
    links = _links(spark, d)
    return network.distances(links, links.where("a LIKE 'r%'").select(F.col("a").alias("node")), 4)


@bound(f"WITH l AS ({_LINKS}), q AS (SELECT 'n' || s_nationkey AS node FROM supplier WHERE s_acctbal > 5000 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000) SELECT a, b, CASE WHEN a = b THEN 'self' WHEN a IN (FROM q) AND b IN (FROM q) THEN 'direct' ELSE 'indirect' END AS kind FROM l WHERE a IN (FROM q) OR b IN (FROM q)")
def interactions(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000")
    q = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node")).union(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    return network.interactions(_links(spark, d), q)
