"""Queries of filters, scalings, joins, markers, calls and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import filters, profiles, stats
from assaylake.plans.bindings import _T, _WIDE, _prices, _wide, bound, r6
from assaylake.plans.hypothesis import _quantities
from assaylake.sources.tables import table

_QTY = "SELECT CAST(l_partkey AS BIGINT) AS feature, l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS value FROM lineitem"


@bound(f"SELECT max(value) > 100 AS non_log, round(CASE WHEN max(value) > 100 AND min(value) <= 1 THEN min(value) + 1 ELSE 0.0 END, 6) + 0.0 AS increment FROM ({_WIDE})")
def scale_sniff(spark, d):
    return filters.scale(_wide(spark, d))


@bound(f"SELECT feature, CAST(sample AS BIGINT) AS sample, round(CASE WHEN value - 500 > 0 THEN log2(value - 500) ELSE log2(1.01) END, 6) + 0.0 AS value FROM ({_WIDE})")
def log_transform(spark, d):
    return filters.to_log(_wide(spark, d), F.lit(-500.0))


@bound(f"SELECT feature, round(CASE WHEN log_fold >= 0 THEN 2 ** log_fold ELSE -(2 ** (-log_fold)) END, 6) + 0.0 AS fold FROM ({_T})")
def signed_fold(spark, d):
    x = stats.pooled_t(_prices(spark, d), "R", "A")
    return x.select("feature", filters.signed_fold(F.col("log_fold")).alias("fold"))


@bound(f"SELECT feature, round(v[len(v) - 2] - v[3], 6) + 0.0 AS spread FROM (SELECT feature, list_sort(list(value)) v FROM ({_QTY}) GROUP BY 1) WHERE len(v) >= 3 AND v[len(v) - 2] - v[3] > 40")
def extreme_fold(spark, d):
    return filters.extreme_fold(_quantities(spark, d), 3, 40.0)


@bound(f"SELECT feature, round(cv, 6) + 0.0 AS cv FROM (SELECT feature, round(stddev_samp(value) / avg(value), 6) AS cv FROM ({_QTY}) GROUP BY 1) WHERE cv IS NOT NULL ORDER BY cv DESC, feature LIMIT 500")
def cv_top(spark, d):
    return filters.most_varied(_quantities(spark, d), 500)


@bound(f"SELECT feature, round(x, 6) + 0.0 AS dispersion FROM (SELECT feature, round((sum(value * value) / count(*) - (sum(value) / count(*)) ** 2) / (sum(value) / count(*)), 6) AS x FROM ({_QTY}) GROUP BY 1 HAVING count(DISTINCT value) > 5) WHERE x IS NOT NULL ORDER BY x DESC, feature LIMIT 500")
def dispersion_top(spark, d):
    return filters.dispersed(_quantities(spark, d), 500)


@bound(f"SELECT feature, count(*) FILTER (p >= 60 AND n >= 3) AS groups FROM (SELECT feature, grp, count(*) FILTER (value > 20) * 100.0 / count(*) p, count(*) FILTER (value > 20) n, min(value) FILTER (value > 20) lo, max(value) FILTER (value > 20) hi FROM ({_QTY}) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (p >= 60 AND n >= 3) > 0 AND max(hi) > min(lo)")
def presence_share(spark, d):
    x = _quantities(spark, d)
    return filters.present_in_group(x.withColumn("value", F.when(F.col("value") > 20, F.col("value"))), 60.0, 3)


@bound("SELECT CAST(l_suppkey AS BIGINT) AS feature, 50 - count(DISTINCT l_quantity) AS missing FROM lineitem GROUP BY 1 HAVING 50 - count(DISTINCT l_quantity) < 50 - 37")
def psi_presence(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_quantity").alias("sample"), F.lit(1.0).alias("value"))
    return filters.detected_in(x, 50, 0.75)


@bound(f"SELECT feature, count(*) FILTER (value / 50 > 0.6) AS high, count(*) FILTER (value / 50 < 0.4) AS low FROM ({_QTY}) GROUP BY 1 HAVING count(*) FILTER (value / 50 > 0.6) >= 10 AND count(*) FILTER (value / 50 < 0.4) >= 10")
def bimodal(spark, d):
    return filters.bimodal(_quantities(spark, d).withColumn("value", F.col("value") / 50), 10)


_COUNTS = "SELECT CAST(l_partkey AS BIGINT) AS feature, CAST(l_suppkey AS BIGINT) AS sample, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2"


def _counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


@bound(f"SELECT sample, count(DISTINCT feature) AS features FROM ({_COUNTS}) WHERE value > 20 GROUP BY 1 HAVING count(DISTINCT feature) > 300")
def rich_samples(spark, d):
    return filters.rich_samples(_counts(spark, d), 20.0, 300)


@bound(f"SELECT feature, sample, round(log2(value * 10000 / sum(value) OVER (PARTITION BY sample) + 1), 6) + 0.0 AS value FROM ({_COUNTS})")
def cptt(spark, d):
    return filters.per_ten_thousand(_counts(spark, d))


@bound(f"SELECT feature, sample, round((value + 1) * 1e9 / (lib * p_size), 6) + 0.0 AS rpkm FROM (SELECT *, sum(value) OVER (PARTITION BY sample) lib FROM ({_COUNTS})) JOIN part ON p_partkey = feature")
def rpkm_gene(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), "p_size")
    return filters.rpkm_offset(_counts(spark, d).join(sizes, "feature"), "p_size").select("feature", "sample", "rpkm")


@bound(f"SELECT feature, v[len(v) * 25 // 100 + 1] AS q1, v[len(v) * 75 // 100 + 1] AS q3, v[len(v) * 75 // 100 + 1] - v[len(v) * 25 // 100 + 1] AS iqr FROM (SELECT feature, list_sort(list(value)) v FROM ({_QTY}) GROUP BY 1)")
def iqr_index(spark, d):
    return filters.quartile_range(_quantities(spark, d))


@bound(f"""WITH x AS ({_QTY}), m AS (SELECT feature, count(*) n, avg(value) m1, avg((value - mu) ** 2) m2, avg((value - mu) ** 3) m3, avg((value - mu) ** 4) m4, stddev_samp(value) sd, count(*) / sum(1 / value) h, exp(avg(ln(value))) g, count(DISTINCT value) u, mad(value) a FROM (SELECT *, avg(value) OVER (PARTITION BY feature) mu FROM x) GROUP BY 1),
  c AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) k FROM x GROUP BY 1, 2)
  SELECT feature, round(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END, 6) + 0.0 AS skew, round(CASE WHEN m2 > 0 THEN m4 / m2 ** 2 - 3 END, 6) + 0.0 AS kurt, round(sd / m1, 6) + 0.0 AS cv, round(h, 6) + 0.0 AS harmonic, round(g, 6) + 0.0 AS geometric, value AS mode, u AS n_distinct, round(a, 6) + 0.0 AS mad FROM m JOIN c USING (feature) WHERE k = 1""")
def shape(spark, d):
    return filters.shape(_quantities(spark, d))


@bound(f"SELECT feature, count(*) AS groups, round(max(m) - min(m), 6) + 0.0 AS span FROM (SELECT feature, grp, avg(value) m FROM ({_QTY}) GROUP BY 1, 2) GROUP BY 1")
def group_span(spark, d):
    return filters.group_span(_quantities(spark, d))


_PARTS = "SELECT p_brand AS gene, month(l_shipdate) AS sample, CAST(l_quantity AS DOUBLE) - 10 AS value, p_size <= 5 AS core FROM lineitem JOIN part ON l_partkey = p_partkey"


@bound(f"SELECT gene, CAST(sample AS BIGINT) AS sample, round(CASE WHEN has THEN c ELSE a END, 6) + 0.0 AS value FROM (SELECT *, bool_or(c IS NOT NULL) OVER (PARTITION BY gene) AS has FROM (SELECT gene, sample, avg(value) FILTER (core AND value > 0) c, avg(value) FILTER (value > 0) a FROM ({_PARTS}) GROUP BY 1, 2)) WHERE CASE WHEN has THEN c ELSE a END IS NOT NULL")
def gene_roll_up(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("part"), F.month("l_shipdate").alias("sample"), (F.col("l_quantity").cast("double") - 10).alias("value"), (F.col("p_size") <= 5).alias("core"))
    return filters.roll_up(x)


@bound(f"SELECT feature, grp AS sample, round(avg(value), 6) + 0.0 AS value FROM ({_QTY}) GROUP BY 1, 2")
def collapse_replicates(spark, d):
    return filters.collapse(_quantities(spark, d).withColumnRenamed("grp", "sample"))


@bound("SELECT CAST(a.l_orderkey AS BIGINT) AS k, CAST(a.l_linenumber AS BIGINT) AS r_line, CAST(b.l_linenumber AS BIGINT) AS n_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N'")
def merge_duplicates(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return filters.merge_rows({g.lower(): x.where(F.col("l_returnflag") == g).select("k", "line") for g in "RN"}, "k")


@bound("WITH a AS (SELECT c_nationkey k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) place FROM customer), b AS (SELECT s_nationkey k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) place FROM supplier) SELECT CAST(k AS BIGINT) AS k, place, CAST(coalesce(c_custkey, -1) AS BIGINT) AS a, CAST(coalesce(s_suppkey, -1) AS BIGINT) AS b FROM a FULL JOIN b USING (k, place)")
def lateral_merge(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return filters.side_by_side(a, b, ["k"], "id").fillna(-1)


@bound("(SELECT 'both' AS part, k FROM (SELECT CAST(o_custkey AS BIGINT) k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%')) UNION ALL (SELECT 'first', k FROM (SELECT CAST(o_custkey AS BIGINT) k FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'))")
def set_ops(spark, d):
    one, five = (table(spark, d, "orders").where(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("k")) for p in "15")
    return one.intersect(five).select(F.lit("both").alias("part"), "k").union(one.subtract(five).select(F.lit("first"), "k"))


@bound("SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) k FROM (SELECT *, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND NOT c_nationkey IN (0, 1) AND c_acctbal > 1000)) WHERE k = 1")
def metadata_rules(spark, d):
    c = table(spark, d, "customer").withColumn("unit", F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    rules = [("restrict", "c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"]), ("exclude", "c_nationkey", [0, 1]), ("above", "c_acctbal", 1000.0), ("unique", "unit", None)]
    return filters.where_metadata(c, rules, "c_custkey").select("c_custkey")


_RHO = f"SELECT feature, g AS grp, count(*) n, corr(value, CASE WHEN grp = g THEN 1.0 ELSE 0.0 END) AS rho, stddev_pop(value) sd FROM ({_QTY}) JOIN (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS feature, l_returnflag AS g FROM lineitem) USING (feature) GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (grp = g)"


@bound(f"SELECT feature, grp, round(CASE WHEN sd > 1e-9 THEN rho END, 6) + 0.0 AS rho FROM ({_RHO})")
def template_rho(spark, d):
    return profiles.template_rho(_quantities(spark, d))


@bound(f"SELECT * FROM (SELECT feature, grp, rho, row_number() OVER (PARTITION BY grp ORDER BY rho DESC, feature) AS place FROM (SELECT feature, grp, round(rho, 6) + 0.0 AS rho FROM ({_RHO}) WHERE sd > 1e-9) WHERE rho > 0.3) WHERE place <= 60")
def topn_markers(spark, d):
    return profiles.top_markers(r6(profiles.template_rho(_quantities(spark, d))), 60, 0.3)


@bound("""WITH v AS (SELECT vec_id, label, unnest(range(len(embedding))) i, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings), c AS (SELECT label, i, avg(x) m FROM v GROUP BY 1, 2), s AS (SELECT vec_id, c.label AS best, round(corr(x, m), 6) r FROM v JOIN c USING (i) GROUP BY 1, 2)
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(best AS BIGINT) AS best, round(r, 6) + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, best) k FROM s) WHERE k = 1""")
def assign_best(spark, d):
    e = table(spark, d, "embeddings")
    return profiles.nearest_profile(e, profiles.centroids(e, "label", "embedding"), "vec_id", "embedding", "label")


@bound("""WITH c AS (SELECT quality a, toxic b, count(*) * 1.0 AS c FROM labels GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) s, sum(c) n FROM c), x AS (SELECT sum(t * (t - 1) / 2) sa FROM (SELECT sum(c) t FROM c GROUP BY a)), y AS (SELECT sum(t * (t - 1) / 2) sb FROM (SELECT sum(c) t FROM c GROUP BY b))
  SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM s, x, y""")
def ari(spark, d):
    return profiles.adjusted_rand(table(spark, d, "labels"), "quality", "toxic")


_TAGS = "SELECT CAST(user_id AS BIGINT) u, event_type t, count(*) AS n FROM events GROUP BY 1, 2"
_CALL = "SELECT u, CASE WHEN count(*) FILTER (s > {1}) >= 2 THEN 'multiplet' WHEN max(s) > 0.6 THEN max_by(t, s) ELSE 'none' END AS call FROM (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY u) s FROM ({0})) GROUP BY 1"
_SCALED = f"SELECT u, t, log2(n * 10000.0 / sum(n) OVER (PARTITION BY t) + 1) AS n FROM ({_TAGS})"


def _tags(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.lit(1).alias("n"))


@bound(_CALL.format(_TAGS, 0.33))
def demultiplex(spark, d):
    return profiles.demultiplex(_tags(spark, d), "u", "t", "n")


@bound(f"SELECT a.u, CASE WHEN a.call = 'multiplet' THEN 'multiplet' ELSE b.call END AS call FROM ({_CALL.format(_TAGS, 0.33)}) a JOIN ({_CALL.format(_SCALED, 0.3)}) b ON a.u = b.u")
def demultiplex_scaled(spark, d):
    return profiles.demultiplex_scaled(_tags(spark, d), "u", "t", "n")


@bound(f"SELECT u, max(t) FILTER (s > 0.3) AS call FROM (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY u) s, sum(n) OVER (PARTITION BY u) total FROM ({_TAGS})) WHERE total > 5 GROUP BY 1 HAVING count(*) FILTER (s > 0.3) = 1")
def guide_call(spark, d):
    return profiles.single_guide(_tags(spark, d), "u", "t", "n", 5)


@bound("SELECT sample, round(diff, 6) + 0.0 AS diff, CASE WHEN diff > 0 THEN 'R' WHEN diff < 0 THEN 'A' ELSE 'unknown' END AS call FROM (SELECT CAST(l_suppkey AS BIGINT) AS sample, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A') AS diff FROM lineitem GROUP BY 1)")
def contrast_call(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_returnflag", F.col("l_quantity").alias("value"))
    return profiles.contrast_call(x, "l_returnflag", "R", "A")


@bound(f"SELECT feature, grp, round(avg(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS freq FROM ({_QTY}) GROUP BY 1, 2")
def state_frequency(spark, d):
    return profiles.state_frequency(_quantities(spark, d), 25.0)
