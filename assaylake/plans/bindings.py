"""Queries: operators of the library bound to the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import assay, enrich, intervals, matrix, network, ranks, stats
from assaylake.plans import tails as sql
from assaylake.sources.tables import table


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Long matrix: feature = brand, sample = ship month, value = sum of prices."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_brand").alias("feature"), F.month("l_shipdate").alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


_WIDE = "SELECT p_brand AS feature, month(l_shipdate) AS sample, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """feature = part, group = return flag, value = log2(price + 1), one row for each order line."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("grp"), F.log2(F.col("l_extendedprice").cast("double") + 1).alias("value"))


_PRICES = "SELECT l_partkey AS feature, l_returnflag AS grp, log2(CAST(l_extendedprice AS DOUBLE) + 1) AS value FROM lineitem"


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


QUERIES, ORACLE_SQL = {}, {}


def bound(sql: str):
    def put(f):
        QUERIES[f.__name__] = lambda spark, d: r6(f(spark, d))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_MOMENTS = f"""SELECT CAST(feature AS BIGINT) feature, count(*) FILTER (grp = 'R') n1, count(*) FILTER (grp = 'A') n2, avg(value) FILTER (grp = 'R') m1, avg(value) FILTER (grp = 'A') m2,
           var_samp(value) FILTER (grp = 'R') v1, var_samp(value) FILTER (grp = 'A') v2 FROM ({_PRICES}) GROUP BY 1"""
_T = f"""SELECT feature, CAST(n1 AS BIGINT) n1, CAST(n2 AS BIGINT) n2, m1 - m2 AS log_fold, CASE WHEN se > 0 THEN (m1 - m2) / se END AS t FROM (
  SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS se FROM ({_MOMENTS}) WHERE n1 > 1 AND n2 > 1)"""
_TP = sql.rounded({"feature": "", "n1": "", "n2": "", "log_fold": "log_fold", "t": "t", "p": sql.t("t", "(n1 + n2 - 2)")}, _T)


@bound(sql.rounded({"feature": "", "n1": "", "n2": "", "log_fold": "log_fold", "t": "t"}, _T))
def de_fold(spark, d):
    return stats.pooled_t(_prices(spark, d), "R", "A").select("feature", "n1", "n2", "log_fold", "t")


@bound(sql.rounded({"feature": "", "p": sql.t("t", "(n1 + n2 - 2)")}, _T))
def t_pvalue(spark, d):
    return stats.pooled_t(_prices(spark, d), "R", "A").select("feature", "p")


@bound(f"SELECT feature, CASE WHEN abs(log_fold) > 0.5 AND (p < 0.3 OR p = 1 AND (SELECT min(p) FROM ({_TP})) = 1) THEN CASE WHEN log_fold > 0 THEN 'up' ELSE 'down' END ELSE 'none' END AS call FROM ({_TP})")
def criterion_split(spark, d):
    return stats.criterion(r6(stats.pooled_t(_prices(spark, d), "R", "A")), 0.5, 0.3).select("feature", "call")


_W = f"SELECT feature, CASE WHEN se > 0 THEN (m1 - m2) / se END AS t, CASE WHEN se > 0 THEN se ** 4 / (a * a / (n1 - 1) + b * b / (n2 - 1)) END AS df FROM (SELECT *, v1 / n1 AS a, v2 / n2 AS b, sqrt(v1 / n1 + v2 / n2) AS se FROM ({_MOMENTS}) WHERE n1 > 1 AND n2 > 1)"


@bound(sql.rounded({"feature": "", "t": "t", "df": "df", "p": sql.t("t", "df")}, _W))
def welch(spark, d):
    return stats.welch(_prices(spark, d), "R", "A").select("feature", "t", "df", "p")


_F = f"""SELECT feature, k, n, CASE WHEN ssw > 0 THEN (greatest(ssb, 0) / (k - 1)) / (ssw / (n - k)) END AS f FROM (
  SELECT CAST(feature AS BIGINT) feature, count(*) k, sum(ng) n, sum(ng * mg * mg) - sum(ng * mg) ** 2 / sum(ng) AS ssb, sum(ssg) AS ssw FROM (
    SELECT feature, grp, count(*) ng, avg(value) mg, var_pop(value) * count(*) AS ssg FROM ({_PRICES}) GROUP BY 1, 2) GROUP BY 1) WHERE k > 1 AND n > k"""


@bound(sql.rounded({"feature": "", "f": "f", "p": sql.f("f", "(k - 1)", "(n - k)")}, _F))
def anova_f(spark, d):
    return stats.anova_f(_prices(spark, d))


def _cheap(spark, d):
    """feature = part, grp = return flag, value = discount in steps of 0.01, so that many values tie."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("grp"), F.col("l_discount").cast("double").alias("value"))


_CHEAP = "SELECT CAST(l_partkey AS BIGINT) AS feature, l_returnflag AS grp, CAST(l_discount AS DOUBLE) AS value FROM lineitem"
_TIED = "SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk, (count(*) OVER (PARTITION BY feature, value)) ** 2 - 1.0 AS tie FROM ({})"
_H = f"""SELECT feature, k, CASE WHEN share > 0 THEN greatest((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / share, 0.0) ELSE 0.0 END AS h FROM (SELECT *, 1 - tie / (n * 1.0 * n * n - n) AS share FROM (
  SELECT feature, sum(ng) n, sum(rs * rs / ng) s, count(*) k, sum(tg) tie FROM (SELECT feature, grp, count(*) ng, sum(rk) rs, sum(tie) tg FROM ({_TIED.format(_CHEAP)}) GROUP BY 1, 2) GROUP BY 1) WHERE k > 1)"""


@bound(sql.rounded({"feature": "", "h": "h", "p": sql.chi("h", "(k - 1)")}, _H))
def kruskal_h(spark, d):
    return stats.kruskal_h(_cheap(spark, d))


_U = f"""SELECT feature, u, CASE WHEN share > 0 THEN abs(u - n1 * n2 / 2.0) / sqrt(share * n1 * n2 * (n1 + n2 + 1) / 12.0) END AS z FROM (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, 1 - tie / ((n1 + n2) * 1.0 * (n1 + n2) * (n1 + n2) - (n1 + n2)) AS share FROM (
  SELECT feature, count(*) FILTER (grp = 'R') n1, count(*) FILTER (grp = 'A') n2, sum(rk) FILTER (grp = 'R') r1, sum(tie) tie FROM ({_TIED.format(_CHEAP + " WHERE l_returnflag IN ('R', 'A')")}) GROUP BY 1) WHERE n1 > 0 AND n2 > 0)"""


@bound(sql.rounded({"feature": "", "u": "u", "z": "z", "p": f"({sql.z('z')}) / 2"}, _U))
def mwu(spark, d):
    return stats.mann_whitney_u(_cheap(spark, d), "R", "A")


@bound("""SELECT feature, p, round(min(least(p * n / rk, 1.0)) OVER (ORDER BY rk DESC), 6) + 0.0 AS q FROM (
  SELECT feature, p, count(*) OVER () n, row_number() OVER (ORDER BY p, feature) rk FROM (
    SELECT l_partkey AS feature, round(count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*), 6) AS p FROM lineitem GROUP BY 1))""")
def step_up(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("p"))
    return stats.step_up(x, "feature", "p")


@bound("""SELECT feature, p, round(least(p * count(*) OVER (), 1.0), 6) + 0.0 AS adjusted FROM (SELECT l_partkey AS feature, round(count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*), 6) AS p FROM lineitem GROUP BY 1)""")
def bonferroni(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("p"))
    return stats.bonferroni(x, "p")


@bound(f"SELECT feature, CAST(sample AS BIGINT) AS sample, round(value - avg(value) OVER (PARTITION BY feature), 6) + 0.0 AS value FROM ({_WIDE})")
def row_center(spark, d):
    return matrix.row_center(_wide(spark, d))


@bound(f"SELECT feature, CAST(sample AS BIGINT) AS sample, round(log2(value) - log2(avg(value) FILTER (sample IN (1, 2)) OVER (PARTITION BY feature)), 6) + 0.0 AS value FROM ({_WIDE})")
def relative_fold(spark, d):
    return matrix.relative_fold(_wide(spark, d), F.col("sample").isin(1, 2))


_SPENT = "SELECT o_custkey AS feature, month(o_orderdate) AS sample, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2"


@bound(f"SELECT CAST(feature AS BIGINT) AS feature, CAST(s.sample AS BIGINT) AS sample, round(coalesce(value, med), 6) + 0.0 AS value FROM (SELECT feature, median(value) med FROM ({_SPENT}) GROUP BY 1) f CROSS JOIN (SELECT DISTINCT sample FROM ({_SPENT})) s LEFT JOIN ({_SPENT}) w USING (feature, sample)")
def missing_fill(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feature"), F.month("o_orderdate").alias("sample")).agg(F.sum("o_totalprice").alias("value"))
    return matrix.fill_missing(m, m.select("sample").distinct())


@bound(f"SELECT feature, round(max(value), 6) + 0.0 AS top FROM ({_WIDE}) GROUP BY 1 HAVING max(value) > 500")
def max_filter(spark, d):
    return matrix.max_filter(_wide(spark, d), 500.0)


@bound(f"SELECT feature, round(list_sort(list(value), 'DESC')[3], 6) + 0.0 AS kth FROM ({_WIDE}) GROUP BY 1 HAVING count(*) >= 3")
def kth_extreme(spark, d):
    return matrix.kth_largest(_wide(spark, d), 3)


@bound(f"SELECT feature, CAST(sample AS BIGINT) AS sample, round(avg(value) OVER (PARTITION BY rk), 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS rk FROM ({_WIDE}))")
def quantile_norm(spark, d):
    return matrix.quantile_normalise(_wide(spark, d))


@bound("SELECT l_orderkey, l_linenumber, round(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0, 6) + 0.0 AS avg_rank FROM lineitem".replace("l_orderkey, l_linenumber, round", "CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round"))
def avg_rank(spark, d):
    return stats.average_rank(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "avg_rank")


@bound("SELECT CAST(l_partkey AS BIGINT) AS feature, count(*) AS n, round(avg(q), 6) + 0.0 AS mean, round(stddev_samp(q), 6) + 0.0 AS sd, round(median(q), 6) + 0.0 AS median, round(min(q), 6) + 0.0 AS low, round(max(q), 6) + 0.0 AS high FROM (SELECT l_partkey, CAST(l_quantity AS DOUBLE) q FROM lineitem) GROUP BY 1")
def descriptives(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_quantity").cast("double").alias("value"))
    return stats.describe(x)


@bound("SELECT feature, round(incl / nullif(incl + excl, 0), 6) + 0.0 AS psi FROM (SELECT CAST(l_partkey AS BIGINT) AS feature, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) incl, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS DOUBLE) END) excl FROM lineitem GROUP BY 1)")
def psi(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), (F.col("l_returnflag") == "R").alias("included"), F.col("l_quantity").cast("double").alias("reads"))
    return assay.percent_spliced_in(x)


@bound("SELECT p, s, round(n * 1e9 / (size * total), 6) + 0.0 AS rpkm FROM (SELECT CAST(l_partkey AS BIGINT) p, CAST(l_suppkey AS BIGINT) s, count(*) n, max(p_size) size, sum(count(*)) OVER (PARTITION BY l_suppkey) total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, l_suppkey)")
def rpkm(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"), F.max("p_size").alias("size"))
    return assay.rpkm(x, "p", "s", "n", "size")


@bound("""WITH e AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) p FROM lineitem), q AS (SELECT DISTINCT l_partkey p FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 45),
 c AS (SELECT p_brand AS gene_set, count(*) n, count(q.p) r FROM e JOIN part ON p_partkey = e.p LEFT JOIN q ON q.p = e.p GROUP BY 1), t AS (SELECT count(*) tn, (SELECT count(*) FROM q) tr FROM e)
 SELECT gene_set, n, r, round(CASE WHEN tn > 1 AND n < tn AND tr > 0 THEN (r - n * tr * 1.0 / tn) / sqrt(n * (tr * 1.0 / tn) * (1 - tr * 1.0 / tn) * (1 - (n - 1.0) / (tn - 1.0))) END, 6) + 0.0 AS z FROM c, t""")
def ora_z(spark, d):
    x, part = table(spark, d, "lineitem"), table(spark, d, "part")
    every = x.select(F.col("l_partkey").alias("element")).distinct()
    hit = x.where("l_discount >= 0.09 AND l_quantity > 45").select(F.col("l_partkey").alias("element")).distinct()
    return enrich.over_representation(every, hit, part.select(F.col("p_partkey").alias("element"), F.col("p_brand").alias("gene_set")))


@bound("SELECT o, CAST(i AS BIGINT) i, CAST(j AS BIGINT) j FROM (SELECT CAST(a.l_orderkey AS BIGINT) o, a.l_linenumber i, b.l_linenumber j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity < b.l_quantity + 3 AND b.l_quantity < a.l_quantity + 3)")
def interval_overlap(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("start"), (F.col("l_quantity").cast("double") + 3).alias("end"))
    return intervals.self_overlaps(x, ["o"], "i", 16.0).select("o", "i", "j")


@bound("SELECT CAST(e.event_id AS BIGINT) event_id FROM events e JOIN (SELECT user_id, min(ts) lo, min(ts) + INTERVAL 7 DAY hi FROM events GROUP BY 1) b ON e.user_id = b.user_id AND e.ts >= b.lo AND e.ts <= b.hi")
def point_in_interval(spark, d):
    e = table(spark, d, "events")
    bands = e.groupBy("user_id").agg(F.min("ts").alias("lo"), (F.min("ts") + F.expr("INTERVAL 7 DAY")).alias("hi"))
    return intervals.points_in(e, bands, ["user_id"], "ts").select("event_id")


@bound("SELECT CAST(event_id AS BIGINT) event_id, CAST(coalesce(lag(event_id) OVER w, -1) AS BIGINT) AS before, CAST(coalesce(lead(event_id) OVER w, -1) AS BIGINT) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbour_gene(spark, d):
    return intervals.neighbours(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id").fillna(-1)


@bound("SELECT CAST(c_custkey AS BIGINT) c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@bound("SELECT CAST(p_partkey AS BIGINT) p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def anti(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40")
    return table(spark, d, "part").join(gone, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@bound("SELECT coalesce(r_name, '') AS r_name, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey GROUP BY 1")
def id_translate(spark, d):
    return matrix.translate_ids(table(spark, d, "nation"), table(spark, d, "region").where("r_name <> 'ASIA'"), "n_regionkey", "r_regionkey", "r_name", "n_name", "names")


def _flag_sums(spark, d, flag):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("feature")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


_SUM = "SELECT CAST(l_partkey AS BIGINT) AS feature, sum(CAST(l_quantity AS DOUBLE)) v FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1"


@bound(f"SELECT feature, round(a.v, 6) AS a, round(b.v, 6) AS b FROM ({_SUM.format('R')}) a FULL JOIN ({_SUM.format('A')}) b USING (feature)")
def merge_union(spark, d):
    return matrix.merge({"a": _flag_sums(spark, d, "R"), "b": _flag_sums(spark, d, "A")}, "outer")


@bound(f"SELECT feature, round(a.v, 6) AS a, round(b.v, 6) AS b FROM ({_SUM.format('R')}) a JOIN ({_SUM.format('A')}) b USING (feature)")
def merge_intersection(spark, d):
    return matrix.merge({"a": _flag_sums(spark, d, "R"), "b": _flag_sums(spark, d, "A")}, "inner")


@bound("WITH a AS (SELECT DISTINCT l_orderkey k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey k FROM lineitem WHERE l_quantity > 45) SELECT CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a' ELSE 'a&b' END AS part, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def venn(spark, d):
    x = table(spark, d, "lineitem")
    return enrich.venn({"a": x.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "b": x.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"))}, "k")


@bound("SELECT CAST(user_id AS BIGINT) user_id, CASE WHEN share >= 0.5 THEN event_type ELSE 'mixed' END AS call FROM (SELECT user_id, event_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) share, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) k FROM events GROUP BY 1, 2) WHERE k = 1")
def hto_call(spark, d):
    return assay.call_by_share(table(spark, d, "events"), "user_id", "event_type", 0.5)


@bound("SELECT CAST(user_id AS BIGINT) user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def presence_filter(spark, d):
    return matrix.presence_filter(table(spark, d, "events"), "user_id", "event_type", 2)


@bound("SELECT CAST(p AS BIGINT) AS p, seg FROM (SELECT l_partkey p, c_mktsegment seg, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, c_mktsegment) k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE k = 1")
def argmax_group(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("v"))
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n = ranks.tasks_for(lines)
    of = orders.repartition(n, "o_custkey").join(customers.repartition(n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("o"), F.col("c_mktsegment").alias("seg"))
    x = lines.repartition(n, "o").join(of.repartition(n, "o"), "o")
    return assay.best_group(x.select("p", "seg", "v").repartition(n, "p"), "p", "seg", "v")


@bound("SELECT CAST(a AS BIGINT) a, CAST(b AS BIGINT) b, round(corr(x, y), 6) + 0.0 AS r FROM (SELECT p.f a, q.f b, p.v x, q.v y FROM m p JOIN m q ON p.s = q.s AND p.f < q.f) GROUP BY 1, 2 HAVING count(*) >= 3".replace("FROM m p JOIN m q", "FROM (SELECT l_suppkey f, l_linenumber || l_returnflag s, avg(CAST(l_quantity AS DOUBLE)) v FROM lineitem GROUP BY 1, 2) p JOIN (SELECT l_suppkey f, l_linenumber || l_returnflag s, avg(CAST(l_quantity AS DOUBLE)) v FROM lineitem GROUP BY 1, 2) q"))
def corr_pairs(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("sample")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    return stats.correlate_pairs(x, 3)


@bound("WITH RECURSIVE e AS (SELECT 'n' || n_nationkey c, 'r' || n_regionkey p FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c AS (SELECT c, p FROM e UNION SELECT c.c, e.p FROM c JOIN e ON e.c = c.p) SELECT c AS child, p AS ancestor FROM c")
def closure(spark, d):
    return network.closure(_tree(spark, d))


def _tree(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return n.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent")))


@bound("WITH e AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem) SELECT CAST(a.s AS BIGINT) a, CAST(b.s AS BIGINT) b, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2")
def two_hop(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return network.shared_neighbours(e, "s", "p")


@bound("SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 6) + 0.0 AS v FROM (SELECT CAST(label AS BIGINT) AS label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def centroid(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return x.groupBy("label", (F.col("k") + 1).alias("i")).agg(F.avg(F.col("x").cast("double")).alias("v"))
