"""Queries of distances, test dispatch, ontology sets, profiles, splicing kinds and batch models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import distances
from assaylake.operators import enrich, hypothesis, models, network, profiles, splicing, stats, tables
from assaylake.plans import tails as sql
from assaylake.plans.bindings import _T, _TP, _W, _prices, _tree, bound
from assaylake.plans.hypothesis import _FISHER, _LC, _RS, _quantities, _sets
from assaylake.sources.tables import table

_VECTORS = "SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)"
_NEXT = f"SELECT a.vec_id, a.v AS x, b.v AS y, len(a.v) AS n FROM ({_VECTORS}) a JOIN ({_VECTORS}) b ON a.vec_id + 1 = b.vec_id"


def _over(term: str) -> str:
    return f"list_sum(list_transform(range(1, len(x) + 1), lambda i: {term}))"


def _neighbours(spark, d):
    """Each whole vector beside the next one, of those as long as the table's longest; and that length."""
    t = table(spark, d, "embeddings")
    n = t.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = t.where(F.size("embedding") == n).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return x.join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id"), n


_WT = "(0.9 + i / 10.0)"
_REAL = {
    "euclidean": f"sqrt({_over('(x[i] - y[i]) ** 2')})",
    "manhattan": _over("abs(x[i] - y[i])"),
    "chebyshev": "list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])))",
    "minkowski": f"{_over('abs(x[i] - y[i]) ** 3')} ** (1 / 3.0)",
    "weighted": f"{_over(f'(abs(x[i] - y[i]) * {_WT}) ** 3')} ** (1 / 3.0)",
    "standardised": f"sqrt({_over(f'(x[i] - y[i]) ** 2 / {_WT}')})",
    "mahalanobis": f"sqrt({_over(f'(x[i] - y[i]) ** 2 * {_WT}')})",
    "canberra": _over("CASE WHEN abs(x[i]) + abs(y[i]) > 0 THEN abs(x[i] - y[i]) / (abs(x[i]) + abs(y[i])) ELSE 0 END"),
    "bray_curtis": f"{_over('abs(x[i] - y[i])')} / {_over('abs(x[i] + y[i])')}",
    "cosine": f"1 - {_over('x[i] * y[i]')} / sqrt({_over('x[i] * x[i]')} * {_over('y[i] * y[i]')})",
    "correlation": f"1 - {_over('(x[i] - list_avg(x)) * (y[i] - list_avg(y))')} / sqrt({_over('(x[i] - list_avg(x)) ** 2')} * {_over('(y[i] - list_avg(y)) ** 2')})",
    "hamming": _over("CASE WHEN x[i] <> y[i] THEN 1 ELSE 0 END") + " / len(x)",
    "haversine": "2 * asin(sqrt(sin((x[1] - y[1]) / 2) ** 2 + cos(x[1]) * cos(y[1]) * sin((x[2] - y[2]) / 2) ** 2))",
}


@bound("SELECT CAST(vec_id AS BIGINT) AS vec_id, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _REAL.items()) + f" FROM ({_NEXT})")
def vector_distances(spark, d):
    x, y = F.col("x"), F.col("y")
    pairs, n = _neighbours(spark, d)
    weights = [1.0 + i / 10 for i in range(n)]
    diagonal = [[w if i == j else 0.0 for j in range(n)] for i, w in enumerate(weights)]
    own = {
        "euclidean": distances.euclidean(x, y), "manhattan": distances.manhattan(x, y), "chebyshev": distances.chebyshev(x, y), "minkowski": distances.minkowski(x, y, 3.0), "weighted": distances.weighted_minkowski(x, y, weights, 3.0),
        "standardised": distances.standardised_euclidean(x, y, weights), "mahalanobis": distances.mahalanobis(x, y, diagonal), "canberra": distances.canberra(x, y), "bray_curtis": distances.bray_curtis(x, y),
        "cosine": distances.cosine(x, y), "correlation": distances.correlation(x, y), "hamming": distances.hamming(x, y), "haversine": distances.haversine(x, y),
    }
    return pairs.select("vec_id", *[c.alias(name) for name, c in own.items()])


_BIN = f"SELECT vec_id, {_over('CASE WHEN x[i] > 0 AND y[i] > 0 THEN 1 ELSE 0 END')} AS tt, {_over('CASE WHEN x[i] > 0 AND NOT y[i] > 0 THEN 1 ELSE 0 END')} AS tf, {_over('CASE WHEN NOT x[i] > 0 AND y[i] > 0 THEN 1 ELSE 0 END')} AS ft, n FROM ({_NEXT})"
_SETS_BY = {
    "jaccard": "CASE WHEN ne = 0 THEN 0 ELSE ne * 1.0 / (tt + ne) END", "matching": "ne * 1.0 / n", "dice": "CASE WHEN ne = 0 THEN 0 ELSE ne / (2.0 * tt + ne) END", "kulsinski": "CASE WHEN ne = 0 THEN 0 ELSE (ne - tt + n * 1.0) / (ne + n) END",
    "rogers_tanimoto": "2.0 * ne / (n + ne)", "russellrao": "CASE WHEN ne = 0 THEN 0 ELSE (n - tt) * 1.0 / n END", "sokal_michener": "2.0 * ne / (n + ne)", "sokal_sneath": "CASE WHEN ne = 0 THEN 0 ELSE ne / (0.5 * tt + ne) END",
    "yule": "CASE WHEN tf = 0 OR ft = 0 THEN 0 ELSE 2.0 * tf * ft / (tt * (n - tt - ne) + tf * ft) END",
}


@bound("SELECT CAST(vec_id AS BIGINT) AS vec_id, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _SETS_BY.items()) + f" FROM (SELECT *, tf + ft AS ne FROM ({_BIN}))")
def binary_distances(spark, d):
    sign = lambda c: F.transform(c, lambda v: F.when(v > 0, 1.0).otherwise(0.0))
    return _neighbours(spark, d)[0].select("vec_id", *[c.alias(n) for n, c in distances.binary(sign(F.col("x")), sign(F.col("y"))).items()])


_DISPATCH = {"unpaired t-test": f"SELECT feature, {sql.t('t', '(n1 + n2 - 2)')} AS p FROM ({_T})", "Welch": f"SELECT feature, {sql.t('t', 'df')} AS p FROM ({_W})", "Rank Sums": f"SELECT feature, {sql.z('z')} AS p FROM ({_RS})"}
_SIZES = "SELECT CAST(l_partkey AS BIGINT) feature, least(count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'A')) AS n FROM lineitem GROUP BY 1"


@bound(" UNION ALL ".join(f"SELECT '{n}' AS test, s.feature, round(CASE WHEN s.n > 1 THEN coalesce(p, 1.0) ELSE 1.0 END, 6) + 0.0 AS p FROM (SELECT * FROM ({_SIZES}) WHERE n > 0) s LEFT JOIN ({e}) x ON x.feature = s.feature" for n, e in _DISPATCH.items()))
def comparison_tests(spark, d):
    m = _prices(spark, d)
    return tables.appended({n: hypothesis.compare(m, "R", "A", n) for n in _DISPATCH}, "test")


@bound("")
def moderated_welch(spark, d):
    return hypothesis.moderated_welch(_prices(spark, d), "R", "A")


_GROUPS = "SELECT CAST(l_partkey AS BIGINT) feature, l_returnflag grp, count(*) n, avg(CAST(l_quantity AS DOUBLE)) m, var_samp(CAST(l_quantity AS DOUBLE)) v FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
_AF = """SELECT feature, k, n, CASE WHEN ssw > 0 THEN (greatest(ssb, 0) / (k - 1)) / (ssw / (n - k)) END AS f FROM (SELECT feature, count(*) k, sum(ng) n, sum(ng * mg * mg) - sum(ng * mg) ** 2 / sum(ng) AS ssb, sum(ssg) AS ssw FROM (
  SELECT CAST(l_partkey AS BIGINT) feature, l_returnflag, count(*) ng, avg(CAST(l_quantity AS DOUBLE)) mg, var_pop(CAST(l_quantity AS DOUBLE)) * count(*) AS ssg FROM lineitem GROUP BY 1, 2) GROUP BY 1) WHERE k > 1 AND n > k"""
_AFP = f"SELECT feature, f, {sql.f('f', '(k - 1)', '(n - k)')} AS p FROM ({_AF})"


@bound(f"""WITH g AS ({_GROUPS}), e AS (SELECT a.feature, a.grp g1, b.grp g2, a.n + b.n - 2 AS df, a.m - b.m AS away, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS se FROM g a JOIN g b ON a.feature = b.feature AND a.grp < b.grp),
  d AS (SELECT *, CASE WHEN se > 0 THEN away / se END AS t FROM e WHERE abs(away) > 1), h AS (SELECT feature, unnest([g1, g2]) AS grp FROM (SELECT *, {sql.t('t', 'df')} AS p FROM d) WHERE p < 0.2), c AS (SELECT feature, grp, count(*) hits FROM h GROUP BY 1, 2)
  SELECT w.feature, round(w.p, 6) + 0.0 AS p, grp AS driver, hits FROM ({_AFP}) w JOIN (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY hits DESC, grp) k FROM c) x ON x.feature = w.feature AND x.k = 1 WHERE w.p < 0.2""")
def driving_groups(spark, d):
    return hypothesis.pairwise_groups(_quantities(spark, d), 1.0, 0.2)


@bound(f"SELECT gene, round(f, 6) + 0.0 AS f, feature FROM (SELECT p_brand AS gene, f, feature, row_number() OVER (PARTITION BY p_brand ORDER BY f DESC, feature) k FROM ({_AFP}) JOIN part ON p_partkey = feature WHERE p < 0.2 AND f IS NOT NULL) WHERE k = 1")
def best_part(spark, d):
    return hypothesis.best_part(_quantities(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("feature")), 0.2)


_DRAWS = "SELECT CAST(l_suppkey AS BIGINT) feature, CAST(l_discount AS DOUBLE) * 10 - CAST(l_quantity AS DOUBLE) / 50 AS d FROM lineitem"


@bound(f"""WITH x AS ({_DRAWS}), s AS (SELECT feature, avg(abs(d)) a, stddev_samp(d) sd FROM x GROUP BY 1)
  SELECT feature, round(CASE WHEN max(a) <= 0.009 OR max(sd) IS NULL OR max(sd) = 0 THEN 0.0 ELSE least(coalesce(1.0 / nullif(avg(exp(-d * d / (2 * (sd * 0.3) ** 2)) / (sd * 0.3 * sqrt(2 * pi()))), 0), 1e12), 1e12) END, 6) + 0.0 AS bayes_factor FROM x JOIN s USING (feature) GROUP BY 1""")
def bayes_factor(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feature"), (F.col("l_discount").cast("double") * 10).alias("one"), (F.col("l_quantity").cast("double") / 50).alias("two"))
    return hypothesis.bayes_factor(x)


@bound("")
def label_permutation(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_returnflag").alias("grp"), F.col("l_discount").cast("double").alias("value"))
    return hypothesis.label_permutation(m, "R", "A", 100)


_TREE = "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS ancestor FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_INHERITED = f"""WITH t AS ({_TREE}), m0 AS (SELECT DISTINCT l_partkey e, 's' || l_suppkey g FROM lineitem WHERE l_quantity > 45), m AS (SELECT e, g FROM m0 UNION SELECT e, ancestor FROM m0 JOIN t ON child = g), e AS (SELECT DISTINCT l_partkey e FROM lineitem), q AS (SELECT DISTINCT l_partkey e FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 45),
  o AS (SELECT g AS gene_set, count(*) n, count(q.e) r FROM m JOIN e USING (e) LEFT JOIN q USING (e) GROUP BY 1), c AS (SELECT count(*) tn, (SELECT count(*) FROM q) tr FROM e), z AS (SELECT gene_set, n, r, CASE WHEN tn > 1 AND n < tn AND tr > 0 THEN (r - n * tr * 1.0 / tn) / sqrt(n * (tr * 1.0 / tn) * (1 - tr * 1.0 / tn) * (1 - (n - 1.0) / (tn - 1.0))) END AS z FROM o, c)"""


def _terms(spark, d):
    x, tree = table(spark, d, "lineitem"), network.closure(_tree(spark, d))
    every = x.select(F.col("l_partkey").alias("element")).distinct()
    hit = x.where("l_discount >= 0.09 AND l_quantity > 45").select(F.col("l_partkey").alias("element")).distinct()
    members = x.where("l_quantity > 45").select(F.col("l_partkey").alias("element"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("gene_set")).distinct()
    return enrich.over_representation(every, hit, enrich.inherited(members, tree)), tree, hit, members


@bound(_INHERITED + " SELECT gene_set, n, r, round(z, 6) + 0.0 AS z FROM z")
def ontology_ora(spark, d):
    return _terms(spark, d)[0]


@bound(_INHERITED + """, s AS (SELECT gene_set, n, r, round(z, 6) + 0.0 AS z FROM z WHERE z IS NOT NULL), b AS (SELECT ancestor g, max(s.z) best FROM t JOIN s ON s.gene_set = child GROUP BY 1), w AS (SELECT gene_set FROM s LEFT JOIN b ON g = gene_set WHERE best IS NULL OR z >= best)
  SELECT * FROM s WHERE gene_set IN (SELECT gene_set FROM w) AND gene_set NOT IN (SELECT child FROM t JOIN w ON w.gene_set = ancestor)""")
def pruned_terms(spark, d):
    terms, tree, *_ = _terms(spark, d)
    return enrich.pruned(terms.where("z IS NOT NULL").withColumn("z", F.round("z", 6)), tree, "z")


@bound(_INHERITED + " SELECT CAST(e AS BIGINT) AS element, count(DISTINCT g) AS n, string_agg(DISTINCT g, '|' ORDER BY g) AS terms FROM q JOIN m0 USING (e) WHERE g IN (SELECT gene_set FROM z WHERE z > 1) GROUP BY 1")
def genes_of_terms(spark, d):
    terms, _, hit, members = _terms(spark, d)
    return enrich.genes_of_terms(hit, members, terms.where("z > 1"))


_MUT = "WITH a AS (SELECT DISTINCT a, s FROM (SELECT l_returnflag || l_linenumber AS a, l_partkey s FROM lineitem WHERE l_quantity > 48)), b AS (SELECT p_brand b, p_partkey s FROM part), o AS (SELECT a, b, count(*) r FROM a JOIN b USING (s) GROUP BY 1, 2), x AS (SELECT a, b, r, (SELECT count(*) FROM b y WHERE y.b = o.b) n, (SELECT count(*) FROM a y WHERE y.a = o.a) tr, (SELECT count(*) FROM part) tn FROM o)"
_MLN = f"({_LC.format('tr', '{0}')} + {_LC.format('(tn - tr)', '(n - {0})')} - {_LC.format('tn', 'n')})"


@bound(f"""{_MUT}, k AS (SELECT *, unnest(range(greatest(0, n + tr - tn), least(n, tr) + 1)) AS i FROM x), f AS (SELECT a, b, r, n, tr, tn, round(least(sum(exp({_MLN.format('i')})) FILTER ({_MLN.format('i')} <= {_MLN.format('r')} + 1e-7), 1.0), 6) AS p FROM k GROUP BY ALL),
  g AS (SELECT *, count(*) OVER (PARTITION BY a) m, row_number() OVER (PARTITION BY a ORDER BY p, b) rk FROM f)
  SELECT a, b, r, n, tr, round(r * 1.0 / tr, 6) + 0.0 AS sensitivity, round((tn - tr - n + r) * 1.0 / (tn - tr), 6) + 0.0 AS specificity, p + 0.0 AS p, round(min(least(p * m / rk, 1.0)) OVER (PARTITION BY a ORDER BY rk DESC), 6) + 0.0 AS q FROM g""")
def mutation_enrichment(spark, d):
    x, part = table(spark, d, "lineitem").where("l_quantity > 48"), table(spark, d, "part")
    one = x.select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("sample"))
    s = enrich.set_by_set(one, part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("sample")), part.select(F.col("p_partkey").alias("sample")))
    f = hypothesis.fisher_two_sided(s).withColumn("p", F.round("p", 6))
    return hypothesis.step_up_by(f, "a", "b", "p").select("a", "b", "r", "n", "tr", "sensitivity", "specificity", "p", "q")


@bound(_FISHER + " SELECT gene_set, n, r, tr, round(z, 6) + 0.0 AS z FROM (SELECT gene_set, n, r, tr, (r - n * tr / 80000.0) / sqrt(n * (tr / 80000.0) * (1 - tr / 80000.0) * (1 - (n - 1.0) / 79999.0)) AS z FROM o) WHERE z > 1.96 AND r > 2")
def fixed_universe(spark, d):
    return enrich.fixed_universe(_sets(spark, d).select("gene_set", "n", "r", "tr"), 80000, 1.96, 2)


_CO = "SELECT event_type AS feature, CAST(user_id AS BIGINT) AS sample, 'g' || CAST(user_id // 10 % 7 AS VARCHAR) AS grp, max(value) AS value FROM events GROUP BY 1, 2, 3"


@bound(f"""WITH m AS ({_CO}), h AS (SELECT * FROM m WHERE value > 60), p AS (SELECT DISTINCT x.feature a, y.feature b FROM m x JOIN m y ON x.feature < y.feature), r AS (SELECT a, b, x.grp, count(*) r FROM p JOIN h x ON x.feature = a JOIN h y ON y.feature = b AND y.sample = x.sample GROUP BY 1, 2, 3),
  n AS (SELECT grp, count(DISTINCT sample) n FROM m GROUP BY 1), s AS (SELECT *, sum(r) OVER (PARTITION BY a, b) tr, (SELECT sum(n) FROM n) tn FROM r JOIN n USING (grp)), z AS (SELECT a, b, grp, r, (r - n * tr / tn) / nullif(sqrt(greatest(n * (tr / tn) * (1 - tr / tn) * (1 - (n - 1.0) / nullif(tn - 1.0, 0)), 0)), 0) AS z FROM s)
  SELECT a, b, grp, r, round(z, 6) + 0.0 AS z FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY z DESC, grp) k FROM z WHERE z > 0.2 AND r > 1) WHERE k = 1""")
def coincident(spark, d):
    e = table(spark, d, "events")
    m = e.groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("sample"), F.concat(F.lit("g"), (F.floor(F.col("user_id") / 10) % 7).cast("string")).alias("grp")).agg(F.max("value").alias("value"))
    kinds = e.select(F.col("event_type").alias("a")).distinct()
    pairs = kinds.join(kinds.withColumnRenamed("a", "b")).where("a < b")  # of event types
    return enrich.coincident(m, pairs, 60.0, 0.2, 1)


_PROFILES = "SELECT CAST(label AS BIGINT) AS label, i, avg(v) AS y FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2"
_RHO = f"SELECT CAST(vec_id AS BIGINT) AS vec_id, c.label, corr(v, y) AS r FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e JOIN ({_PROFILES}) c USING (i) GROUP BY 1, 2"


def _rhos(spark, d):
    x = table(spark, d, "embeddings")
    return profiles.profile_rhos(x, profiles.centroids(x, "label", "embedding"), "vec_id", "embedding", "label")


@bound(f"WITH r AS ({_RHO}), t AS (SELECT avg(r) m, stddev_samp(r) sd FROM (SELECT r, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC) k FROM r) WHERE k <= 2) SELECT vec_id, label, round(r, 6) + 0.0 AS r, round((r - m) / sd, 6) + 0.0 AS z FROM r, t")
def profile_z(spark, d):
    return profiles.profile_z(_rhos(spark, d), "vec_id", "r")


@bound(f"WITH RECURSIVE p AS ({_PROFILES}), e AS (SELECT a.label a, b.label b FROM p a JOIN p b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2 HAVING corr(a.y, b.y) > 0.02), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT DISTINCT label n, label r FROM p UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.n) SELECT n AS label, min(r) AS merged FROM c GROUP BY 1")
def merged_clusters(spark, d):
    c = profiles.centroids(table(spark, d, "embeddings"), "label", "embedding")
    found = network.components(profiles.like_profiles(c, "label", 0.02), "a", "b")
    return c.select("label").join(found, F.col("label") == F.col("node"), "left").select(F.col("label").cast("long").alias("label"), F.coalesce("component", "label").cast("long").alias("merged"))


_ROWS = "SELECT CAST(l_partkey + 1 AS BIGINT) AS place, l_linenumber || l_returnflag AS sample, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2"


@bound(f"""WITH m AS ({_ROWS}), c AS (SELECT a.place, corr(a.value, b.value) r, count(*) n, var_pop(a.value) va, var_pop(b.value) vb FROM m a JOIN m b ON a.place = b.place + 1 AND a.sample = b.sample GROUP BY 1), p AS (SELECT place, CASE WHEN n > 1 AND va > 0 AND vb > 0 THEN coalesce(r, 0) ELSE 0 END AS r FROM (SELECT DISTINCT place FROM m) LEFT JOIN c USING (place))
  SELECT place, CAST(block AS BIGINT) AS block, round(r, 6) + 0.0 AS r FROM (SELECT place, r, sum(CASE WHEN r > 0.2 THEN 0 ELSE 1 END) OVER (ORDER BY place) AS block FROM p) WHERE r <= 0.95""")
def row_blocks(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).alias("place"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("sample")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    return profiles.row_blocks(m, "place", 0.2, 0.95)


_EV = "SELECT CAST(l_partkey AS BIGINT) AS feature, l_linenumber || l_returnflag AS sample, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2"


def _events(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("sample")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))


@bound(f"""WITH m AS ({_EV}), s AS (SELECT p_brand AS name, sample, avg(value) y FROM m JOIN part ON p_partkey = feature WHERE p_size < 25 GROUP BY 1, 2), r AS (SELECT feature, name, CASE WHEN count(*) > 1 AND var_pop(value) > 0 AND var_pop(y) > 0 THEN corr(value, y) ELSE 0 END AS r FROM m JOIN s USING (sample) GROUP BY 1, 2)
  SELECT feature, round(max(abs(r)), 6) + 0.0 AS closest FROM r GROUP BY 1 HAVING max(abs(r)) < 0.4""")
def depleted(spark, d):
    names = table(spark, d, "part").where("p_size < 25").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("feature"))
    return profiles.depleted(_events(spark, d), names, 0.4)


@bound(f"""WITH m AS ({_EV}), y AS (SELECT p_brand AS g, sample, avg(value) y FROM m JOIN part ON p_partkey = feature GROUP BY 1, 2), r AS (SELECT feature, g, round(CASE WHEN count(*) > 15 AND var_pop(value) > 0 AND var_pop(y) > 0 THEN corr(value, y) ELSE 0 END, 6) AS r FROM m JOIN y USING (sample) GROUP BY 1, 2)
  SELECT feature, g AS regulator, r + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(r) DESC, g) k FROM r WHERE abs(r) > 0.3) WHERE k = 1""")
def best_regulator(spark, d):
    m = _events(spark, d)
    brands = m.join(table(spark, d, "part"), F.col("feature") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), "sample").agg(F.avg("value").alias("value"))
    return profiles.best_regulator(m, brands, 0.3, 15)


_SIDE = "sum(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = '{}' AND l_linestatus = '{}')"
_LEVELS = f"SELECT CAST(l_partkey AS BIGINT) AS feature, {_SIDE.format('R', 'O')} a, {_SIDE.format('R', 'F')} b, {_SIDE.format('A', 'O')} c, {_SIDE.format('A', 'F')} d FROM lineitem GROUP BY 1"


@bound(f"SELECT feature, round((((rout - 1) - (rout - 1) * rin) / nullif(rout - rin, 0) + (b / (b + d) - a / (a + c))) / 2, 6) + 0.0 AS change FROM (SELECT *, a / b AS rin, c / d AS rout FROM ({_LEVELS})) WHERE abs(coalesce(rout - rin, 1)) > 1e-9")
def aspire(spark, d):
    side = lambda f, s: F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), F.col("l_quantity").cast("double")))
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(side("R", "O").alias("a"), side("R", "F").alias("b"), side("A", "O").alias("c"), side("A", "F").alias("d"))
    x = x.where(F.abs(F.coalesce(F.col("c") / F.col("d") - F.col("a") / F.col("b"), F.lit(1.0))) > 1e-9)
    return x.select("feature", splicing.aspire(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("change"))


@bound("""SELECT o, n, CASE WHEN n = q AND s = s2 THEN CASE WHEN f = f2 THEN 'alt-3''' ELSE 'alt-5''' END WHEN n = q THEN 'cassette-exon' WHEN s = s2 THEN CASE WHEN n = 1 THEN 'altPromoter' ELSE 'cassette-exon' END WHEN n = 1 OR q = 1 AND f2 = 1 THEN 'altPromoter' ELSE 'cassette-exon' END AS kind FROM (
  SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, l_linenumber % 3 + 1 AS q, l_suppkey % 4 + 2 AS s, l_partkey % 3 + 2 AS s2, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS f, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS f2 FROM lineitem)""")
def event_kinds(spark, d):
    x = table(spark, d, "lineitem")
    text = lambda c: c.cast("string")
    flag = lambda c, v: F.when(F.col(c) == v, "1").otherwise("2")
    one = F.concat(F.lit("E"), text(F.col("l_linenumber")), F.lit("."), flag("l_returnflag", "R"), F.lit("-E"), text(F.col("l_suppkey") % 4 + 2), F.lit(".3"))
    two = F.concat(F.lit("E"), text(F.col("l_linenumber") % 3 + 1), F.lit("."), flag("l_linestatus", "O"), F.lit("-E"), text(F.col("l_partkey") % 3 + 2), F.lit(".4"))
    return x.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), splicing.event_kind(one, two).alias("kind"))


_TWO = "SELECT CAST(l_partkey AS BIGINT) AS feature, CAST(l_suppkey AS BIGINT) AS s, sum(CAST(l_quantity AS DOUBLE)) AS one, sum(CAST(l_linenumber AS DOUBLE)) AS two FROM lineitem GROUP BY 1, 2"


@bound(f"SELECT feature, s, round(one - low, 6) + 0.0 AS one, round(two - low, 6) + 0.0 AS two FROM (SELECT *, min(least(one, two)) OVER (PARTITION BY feature) low FROM ({_TWO}))")
def uncovered(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("s")).agg(F.sum(F.col("l_quantity").cast("double")).alias("one"), F.sum(F.col("l_linenumber").cast("double")).alias("two"))
    return splicing.uncover(x, "one", "two", "feature")


@bound(f"""WITH r AS (SELECT x.*, CAST(e.label AS BIGINT) AS grp FROM ({_RHO}) x JOIN embeddings e ON e.vec_id = x.vec_id), s AS (SELECT vec_id, grp, max(r) FILTER (label = grp) own, max(r) FILTER (label <> grp) other FROM r GROUP BY 1, 2), b AS (SELECT *, 2 ** (median(own) OVER (PARTITION BY grp) - median(other) OVER (PARTITION BY grp)) AS bound FROM s WHERE own IS NOT NULL AND other IS NOT NULL)
  SELECT vec_id, grp, round(own, 6) + 0.0 AS own, round(other, 6) + 0.0 AS other, 2 ** (own - other) > bound AND 2 ** (own - other) > 1 AS singlet FROM b WHERE abs(2 ** (own - other) - bound) > 1e-9""")
def singlets(spark, d):
    r = _rhos(spark, d).withColumnRenamed("label", "state").join(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("grp")), "vec_id")
    s = profiles.own_and_other(r, "vec_id", "grp", "state", "r")
    w = W.partitionBy("grp")
    near = F.abs(F.pow(F.lit(2.0), F.col("own") - F.col("other")) - F.pow(F.lit(2.0), F.median("own").over(w) - F.median("other").over(w)))
    return s.withColumn("_near", near).where("_near > 1e-9").select("vec_id", "grp", "own", "other", "singlet")  # a value at the bound itself is a matter of rounding


@bound("")
def combat(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_returnflag").alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_quantity").cast("double").alias("value"))
    return models.combat(x)


@bound("")
def rank_estimate(spark, d):
    return spark.createDataFrame([(models.rank_estimate(table(spark, d, "embeddings"), "embedding"),)], "rank int")


@bound("")
def nmf(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))
    return models.nmf(x, 3, 10)


@bound("")
def network_permutation(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    name = lambda t, k, p: table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("node"), "*")
    wanted = name("part", "p_partkey", "p").where("p_size < 10").select("node").union(name("supplier", "s_suppkey", "s").where("s_acctbal > 5000").select("node"))
    return network.edge_permutation(e, nodes, wanted, 200)


@bound(f"SELECT feature, p_brand, log_fold, p, round(min(least(p * n / rk, 1.0)) OVER (ORDER BY rk DESC), 6) + 0.0 AS q FROM (SELECT feature, log_fold, p, count(*) OVER () n, row_number() OVER (ORDER BY p, feature) rk FROM (SELECT feature, log_fold, coalesce(p, 1.0) AS p FROM ({_TP}))) LEFT JOIN part ON p_partkey = feature")
def dataset_summary(spark, d):
    t = stats.pooled_t(_prices(spark, d), "R", "A").select("feature", F.round("log_fold", 6).alias("log_fold"), F.coalesce(F.round("p", 6), F.lit(1.0)).alias("p"))
    notes = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), "p_brand")
    return tables.annotated(stats.step_up(t, "feature", "p"), notes, "feature").select("feature", "p_brand", "log_fold", "p", "q")
