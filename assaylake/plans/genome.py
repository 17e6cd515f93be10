"""Queries of genes, intervals, junctions and graphs of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import enrich, hypothesis, intervals, models, network, splicing
from assaylake.plans.advanced import _MLN, _MUT
from assaylake.plans.bindings import bound
from assaylake.sources.tables import table

_GENES = "SELECT p_partkey AS gene, ['R', 'A', 'N'][p_partkey % 3 + 1] AS chr, p_partkey * 30 AS s, p_partkey * 30 + 100 AS e FROM part"
_SEGMENTS = "SELECT l_orderkey * 10 + l_linenumber AS key, l_returnflag AS chr, l_orderkey AS s, l_orderkey + l_linenumber * 20 AS e FROM lineitem"


def _genes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("gene"), k.alias("key"), F.array(F.lit("R"), F.lit("A"), F.lit("N"))[(k % 3).cast("int")].alias("chr"), (k * 30).alias("start"), (k * 30 + 100).alias("end"))


def _segments(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("chr"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber") * 20).alias("end"))


@bound(f"""WITH g AS ({_GENES}), s AS ({_SEGMENTS}), m AS (SELECT key, min({{'s': g.s, 'g': gene}}) FILTER (g.s <= s.s AND g.e >= s.e) b, min({{'s': g.s, 'g': gene}}) FILTER (g.s <= s.s AND g.e >= s.s) l, min({{'s': g.s, 'g': gene}}) FILTER (g.s <= s.e AND g.e >= s.e) r FROM s JOIN g ON g.chr = s.chr AND g.s <= s.e AND g.e >= s.s GROUP BY 1)
  SELECT CAST(s.key AS BIGINT) AS key, CAST(coalesce(b.g, l.g, r.g) AS BIGINT) AS gene, CAST(CASE WHEN b IS NULL AND l.g IS NOT NULL AND r.g IS NOT NULL AND l.g <> r.g THEN r.g END AS BIGINT) AS other FROM (SELECT key FROM s) s LEFT JOIN m ON m.key = s.key""")
def genes_of_segments(spark, d):
    return intervals.genes_of(_segments(spark, d), _genes(spark, d), 64)


@bound(f"WITH g AS ({_GENES}), s AS (SELECT DISTINCT key || chr AS key, chr, s, e FROM ({_SEGMENTS})) SELECT s.key, count(gene) AS n, CAST(min(gene) AS BIGINT) AS least FROM s LEFT JOIN g ON g.chr = s.chr AND g.s <= s.e AND s.s <= g.e GROUP BY 1")
def matched_intervals(spark, d):
    one = _segments(spark, d).withColumn("key", F.concat(F.col("key").cast("string"), "chr")).distinct()
    return intervals.matched(one, _genes(spark, d), ["chr"], 64)


_J = "SELECT DISTINCT l_partkey AS gene, l_linenumber AS s, l_linenumber + 1 + l_suppkey % 5 AS e, l_linenumber || '-' || (l_linenumber + 1 + l_suppkey % 5) AS j FROM lineitem"


@bound(f"WITH j AS ({_J}) SELECT CAST(a.gene AS BIGINT) AS gene, a.j AS \"outer\", b.j AS \"inner\", 'left' AS side FROM j a JOIN j b ON a.gene = b.gene AND a.s = b.s AND a.e > b.e UNION ALL SELECT a.gene, a.j, b.j, 'right' FROM j a JOIN j b ON a.gene = b.gene AND a.e = b.e AND a.s < b.s")
def reciprocal_junctions(spark, d):
    x = table(spark, d, "lineitem")
    end = (F.col("l_linenumber") + 1 + F.col("l_suppkey") % 5).cast("long")
    j = x.select(F.col("l_partkey").alias("gene"), F.col("l_linenumber").cast("long").alias("left"), end.alias("right"), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), end.cast("string")).alias("junction")).distinct()
    return splicing.reciprocal(j)


@bound("""WITH x AS (SELECT p_brand AS gene, l_orderkey AS isoform, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem JOIN part ON l_partkey = p_partkey), y AS (SELECT *, gene || isoform AS iso FROM x), z AS (SELECT gene, iso, e AS l, lead(s) OVER (PARTITION BY iso ORDER BY s, e) AS r FROM y),
  c AS (SELECT iso, count(*) AS reads FROM y GROUP BY 1) SELECT gene, CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", CAST(sum(reads) AS BIGINT) AS reads FROM z JOIN c USING (iso) WHERE r IS NOT NULL GROUP BY 1, 2, 3""")
def isoform_junctions(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = x.select(F.col("p_brand").alias("gene"), F.concat("p_brand", F.col("l_orderkey").cast("string")).alias("isoform"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return splicing.isoform_junctions(e, e.groupBy("isoform").agg(F.count("*").alias("reads")))


@bound("SELECT gene, feature, round(top, 6) + 0.0 AS top, CAST(row_number() OVER (PARTITION BY gene ORDER BY top DESC, feature) AS BIGINT) AS place FROM (SELECT p_brand AS gene, CAST(l_partkey AS BIGINT) AS feature, max(CAST(l_quantity AS DOUBLE)) AS top FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) FILTER (l_quantity > 40) > 6)")
def novel_ranked(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return splicing.novel_ranked(x.select(F.col("p_brand").alias("gene"), F.col("l_partkey").alias("feature"), F.col("l_quantity").cast("double").alias("value")), 40.0, 6)


@bound("SELECT event, kind, one, two FROM (SELECT CAST(l_partkey AS BIGINT) AS event, l_returnflag AS kind, count(*) FILTER (l_linestatus = 'O') AS one, count(*) FILTER (l_linestatus = 'F') AS two FROM lineitem GROUP BY 1, 2) WHERE one + two >= CASE kind WHEN 'R' THEN 12 WHEN 'A' THEN 10 ELSE 0 END")
def counted_kinds(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("event"), F.col("l_returnflag").alias("kind")).agg(F.count_if(F.col("l_linestatus") == "O").alias("one"), F.count_if(F.col("l_linestatus") == "F").alias("two"))
    return splicing.counted_kinds(x, {"R": 12, "A": 10})


@bound(f"""{_MUT}, k AS (SELECT *, unnest(range(greatest(0, n + tr - tn), least(n, tr) + 1)) AS i FROM x), f AS (SELECT a, b, round(least(sum(exp({_MLN.format('i')})) FILTER ({_MLN.format('i')} <= {_MLN.format('r')} + 1e-7), 1.0), 6) AS p FROM k GROUP BY a, b),
  s AS (SELECT *, max(-log10(greatest(p, 1e-300))) OVER (PARTITION BY a) + log10(greatest(p, 1e-300)) AS below FROM f) SELECT a, b, p + 0.0 AS p, row_number() OVER (PARTITION BY a ORDER BY p, b) AS place FROM s WHERE below < 0.5""")
def best_terms(spark, d):
    x, part = table(spark, d, "lineitem").where("l_quantity > 48"), table(spark, d, "part")
    one = x.select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("sample"))
    s = enrich.set_by_set(one, part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("sample")), part.select(F.col("p_partkey").alias("sample")))
    return enrich.best_terms(hypothesis.fisher_two_sided(s).select("a", "b", F.round("p", 6).alias("p")), "a", "b", "p", 0.5)


@bound("")
def page_rank(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    return network.page_rank(e, 10)


@bound("")
def expanded_labels(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"))
    return models.expand_labels(x, "vec_id", "embedding", "label")


@bound("")
def first_kept(spark, d):
    """Suppliers whose mean quantities by line and flag correlate above 0.4 with none kept before them."""
    from assaylake.operators import stats

    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("sample")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    return network.first_kept(m.select(F.col("feature").alias("node")), stats.correlate_pairs(m, 3).where("r > 0.4").select("a", "b"))


_RHO = """SELECT feature, grp, c, s, n, t, q FROM (SELECT *, sum(c) OVER w n, sum(s) OVER w t, sum(q0) OVER w q FROM (SELECT feature, grp, count(*) c, sum(value) s, sum(value * value) q0 FROM (SELECT CAST(l_partkey AS BIGINT) feature, {0} AS grp, CAST(l_quantity AS DOUBLE) AS value FROM lineitem) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature)) WHERE c < n"""
_RHOS = "SELECT '{0}' AS grouping, feature, grp, CASE WHEN sqrt(greatest(q / n - (t / n) ** 2, 0)) > 1e-9 THEN (s / c - t / n) / sqrt(greatest(q / n - (t / n) ** 2, 0)) * sqrt((c * 1.0 / n) / (1 - c * 1.0 / n)) END AS rho FROM ({1})"


@bound("SELECT grouping, grp, feature, rho + 0.0 AS rho, place FROM (SELECT grouping, grp, feature, rho, row_number() OVER (PARTITION BY grouping, grp ORDER BY rho DESC, feature) AS place FROM (SELECT grouping, feature, grp, round(rho, 6) AS rho FROM (" + " UNION ALL ".join(_RHOS.format(g, _RHO.format(g)) for g in ("l_returnflag", "l_linestatus")) + ") ) WHERE rho > 0.2) WHERE place <= 20")
def markers_by_grouping(spark, d):
    """The best markers of each group, for one grouping of the samples after the other."""
    from assaylake.operators import profiles, tables

    x = table(spark, d, "lineitem")
    one = lambda g: profiles.template_rho(x.select(F.col("l_partkey").alias("feature"), F.col(g).alias("grp"), F.col("l_quantity").cast("double").alias("value"))).withColumn("rho", F.round("rho", 6))
    found = tables.appended({g: profiles.top_markers(one(g), 20, 0.2) for g in ("l_returnflag", "l_linestatus")}, "grouping")
    return found.select("grouping", "grp", "feature", "rho", "place")


_COV = "SELECT '{0}' AS covariate, feature, m1 - m2 AS log_fold FROM (SELECT CAST(l_partkey AS BIGINT) feature, avg(CAST(l_quantity AS DOUBLE)) FILTER ({1}) m1, avg(CAST(l_quantity AS DOUBLE)) FILTER ({2}) m2, count(*) FILTER ({1}) n1, count(*) FILTER ({2}) n2 FROM lineitem GROUP BY 1) WHERE n1 > 1 AND n2 > 1"
_COVARIATES = {"flag": ("l_returnflag = 'R'", "l_returnflag = 'A'"), "status": ("l_linestatus = 'O'", "l_linestatus = 'F'")}


@bound("SELECT covariate, feature, round(log_fold, 6) + 0.0 AS log_fold FROM (" + " UNION ALL ".join(_COV.format(n, *c) for n, c in _COVARIATES.items()) + ")")
def covariate_folds(spark, d):
    """The comparison of two groups for each covariate, one after the other."""
    from assaylake.operators import stats, tables

    x = table(spark, d, "lineitem")
    one = lambda c: stats.pooled_t(x.select(F.col("l_partkey").alias("feature"), F.when(F.expr(c[0]), "one").when(F.expr(c[1]), "two").alias("grp"), F.col("l_quantity").cast("double").alias("value")), "one", "two").select("feature", "log_fold")
    return tables.appended({n: one(c) for n, c in _COVARIATES.items()}, "covariate").select("covariate", "feature", "log_fold")


@bound("""WITH d AS (SELECT l_partkey p, l_returnflag g, avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) s, avg(CAST(l_quantity AS DOUBLE)) m FROM lineitem GROUP BY 1, 2), k AS (SELECT p FROM d WHERE s >= 0.5 AND m >= 25 GROUP BY 1)
  SELECT p_brand AS gene, CAST(p AS BIGINT) AS feature FROM k JOIN part ON p_partkey = p WHERE p IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def marker_parts(spark, d):
    """Parts that are detected and expressed in some group and are among the results of another analysis, with their gene."""
    from assaylake.operators import tables

    x = table(spark, d, "lineitem")
    m = x.select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").cast("double").alias("value"), F.col("l_discount").alias("p"))
    found = tables.detected(m, 0.05, 0.5, 25.0).join(x.where("l_quantity = 50").select(F.col("l_partkey").alias("feature")), "feature", "left_semi")
    return found.join(table(spark, d, "part"), F.col("feature") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), "feature")
