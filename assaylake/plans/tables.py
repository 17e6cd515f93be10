"""Queries of table operations: ids, annotations, lists, counts and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import hypothesis, tables
from assaylake.plans.bindings import _PRICES, _WIDE, _prices, _wide, bound
from assaylake.plans.hypothesis import _FISHER, _LC, _sets
from assaylake.sources.tables import table


def lines(spark, d):
    return table(spark, d, "lineitem")


@bound(f"SELECT CAST(sample AS BIGINT) AS feature, feature AS sample, round(value, 6) + 0.0 AS value FROM ({_WIDE})")
def transposed(spark, d):
    return tables.transpose(_wide(spark, d))


_PSI_TOTAL = "SELECT CAST(l_partkey AS BIGINT) AS feature, l_returnflag AS sample, sum(CAST(l_quantity AS DOUBLE)) AS total, avg(CAST(l_discount AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2"


@bound(f"SELECT feature, sample, round(total, 6) + 0.0 AS total, round(CASE WHEN total >= 200 THEN value END, 6) + 0.0 AS value FROM ({_PSI_TOTAL})")
def masked_ratio(spark, d):
    m = lines(spark, d).groupBy(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("total"), F.avg(F.col("l_discount").cast("double")).alias("value"))
    return tables.mask_low(m, "total", 200.0)


def _events(spark, d):
    """An id of two junctions for each line: 'gene:E<number>.1-E<quantity>.1=chr<flag>:start-end', the second without its place."""
    x = lines(spark, d)
    g = F.concat(F.lit("G"), F.col("l_partkey").cast("string"))
    q = F.col("l_quantity").cast("int").cast("string")
    one = F.concat(g, F.lit(":E"), F.col("l_linenumber").cast("string"), F.lit(".1-E"), q, F.lit(".2=chr"), "l_returnflag", F.lit(":"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_orderkey") + 7).cast("string"))
    two = F.concat(g, F.lit(":E"), F.col("l_linenumber").cast("string"), F.lit(".1-E"), q, F.lit(".3"))
    return x.select("l_orderkey", "l_linenumber", F.concat(one, F.lit("|"), two).alias("event"))


@bound("""SELECT o, n, CAST(p AS BIGINT) AS place, 'G' || k AS gene, 'E' || n || '.1' AS left_end, 'E' || q || CASE WHEN p = 0 THEN '.2' ELSE '.3' END AS right_end, CASE WHEN p = 0 THEN 'chr' || f END AS chr, CASE WHEN p = 0 THEN o END AS start_at, CASE WHEN p = 0 THEN o + 7 END AS end_at
  FROM (SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, l_partkey k, CAST(l_quantity AS INTEGER) q, l_returnflag f, unnest([0, 1]) p FROM lineitem)""")
def event_parts(spark, d):
    x = tables.both_sides(_events(spark, d), "event")
    names = ["gene", "left_end", "right_end", "chr", "start_at", "end_at"]
    return x.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "place", *[c.alias(n) for c, n in zip(tables.parse_event(F.col("side")), names, strict=True)])


@bound("SELECT DISTINCT p_brand AS key, CAST(l_suppkey AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey")
def inverted(spark, d):
    x = lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return tables.invert(x, "l_suppkey", "p_brand")


@bound("SELECT CAST(l_partkey AS BIGINT) AS feature FROM lineitem WHERE l_extendedprice > 60000 INTERSECT SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING max(l_quantity) > 49")
def both_thresholds(spark, d):
    x = lines(spark, d).withColumnRenamed("l_partkey", "feature")
    return tables.both_thresholds(x.withColumn("value", F.col("l_extendedprice")), x.withColumn("value", F.col("l_quantity")), 60000, 49)


_GROUP_MEANS = f"SELECT CAST(feature AS BIGINT) AS feature, avg(value) FILTER (grp = 'R') a, avg(value) FILTER (grp = 'A') b FROM ({_PRICES}) GROUP BY 1"


@bound(f"SELECT feature, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(CASE WHEN NOT (a < 15 AND b < 15) THEN a - b END, 6) + 0.0 AS log_fold, a < 15 AND b < 15 AS insufficient FROM ({_GROUP_MEANS})")
def insufficient_expression(spark, d):
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    m = _prices(spark, d).groupBy("feature").agg(mean("R").alias("a"), mean("A").alias("b")).withColumn("log_fold", F.col("a") - F.col("b"))
    return tables.insufficient(m, "a", "b", 15.0)


@bound("SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber, CAST(l_partkey AS BIGINT) l_partkey, CAST(place AS BIGINT) AS place FROM lineitem JOIN (SELECT p_partkey, min(row_number) AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS row_number FROM part WHERE p_size < 10) GROUP BY 1) ON l_partkey = p_partkey")
def in_list_order(spark, d):
    from assaylake.operators.ranks import global_rank

    wanted = global_rank(table(spark, d, "part").where("p_size < 10").select("p_brand", F.col("p_partkey").alias("l_partkey")), ["p_brand", "l_partkey"], "place", "_n", "_part").select("l_partkey", "place")
    return tables.in_list_order(lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey"), wanted, "l_partkey", "place")


@bound(_FISHER + " SELECT gene_set, n, r, round(p, 6) + 0.0 AS p, round(z, 6) + 0.0 AS z FROM (SELECT f.*, (f.r - f.n * o.tr * 1.0 / o.tn) / sqrt(f.n * (o.tr * 1.0 / o.tn) * (1 - o.tr * 1.0 / o.tn) * (1 - (f.n - 1.0) / (o.tn - 1.0))) AS z FROM f JOIN o USING (gene_set)) WHERE r > 5 AND p < 0.9 AND n <= 90 AND z > 0")
def enriched_terms(spark, d):
    t = hypothesis.fisher_two_sided(_sets(spark, d))
    share = F.col("tr") / F.col("tn")
    z = (F.col("r") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) * (1 - (F.col("n") - 1.0) / (F.col("tn") - 1.0)))
    return tables.enriched_terms(t.withColumn("z", z).select("gene_set", "n", "r", "p", "z"), 5, 0.9, 90, 0.0)


@bound("SELECT feature, count(*) AS groups FROM (SELECT CAST(l_partkey AS BIGINT) AS feature, l_returnflag, avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) s, avg(CAST(l_quantity AS DOUBLE)) m FROM lineitem GROUP BY 1, 2) WHERE s >= 0.5 AND m >= 25 GROUP BY 1")
def detected(spark, d):
    m = lines(spark, d).select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").cast("double").alias("value"), F.col("l_discount").alias("p"))
    return tables.detected(m, 0.05, 0.5, 25.0)


@bound("SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13') AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def biotype_filter(spark, d):
    x, part = lines(spark, d), table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return x.join(part.where("p_brand = 'Brand#13'"), "l_partkey", "left_semi").join(part.where("p_size < 5"), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@bound("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, m.first_priority, CAST(m.first_key AS BIGINT) AS first_key FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) first_priority, min(o_orderkey) first_key FROM orders WHERE o_totalprice > 200000 GROUP BY 1) m ON o_custkey = c_custkey")
def annotated(spark, d):
    notes = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("first_priority"), F.col("o_orderkey").alias("first_key"))
    return tables.annotated(table(spark, d, "customer").select("c_custkey"), notes, "c_custkey")


@bound("SELECT DISTINCT p_brand, CAST(l_suppkey AS BIGINT) l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 45) JOIN (SELECT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.08) USING (l_suppkey)")
def source_to_gene(spark, d):
    x = lines(spark, d)
    names = x.where("l_discount > 0.08").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand")
    return tables.to_genes(x.where("l_quantity > 45").select("l_suppkey").distinct(), names, "l_suppkey", "p_brand")


@bound("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 250000), a AS (SELECT o_custkey k, min(o_orderkey) v FROM o GROUP BY 1), b AS (SELECT o_orderpriority k, min(o_orderkey) v FROM o GROUP BY 1)
  SELECT CAST(x.o_custkey AS BIGINT) o_custkey, x.o_orderpriority, CAST(coalesce(a.v, b.v) AS BIGINT) AS o_orderkey FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) x LEFT JOIN a ON a.k = x.o_custkey LEFT JOIN b ON b.k = x.o_orderpriority""")
def fallback_join(spark, d):
    o = table(spark, d, "orders")
    return tables.fallback_join(o.select("o_custkey", "o_orderpriority").distinct(), o.where("o_totalprice > 250000").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey")


@bound("SELECT DISTINCT p_brand, piece, CAST(instr(t, piece) AS BIGINT) AS at FROM (SELECT p_brand, p_name AS t FROM part) JOIN (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS piece FROM part) USING (p_brand) WHERE instr(t, piece) > 0 AND piece <> ''")
def contained_pieces(spark, d):
    part = table(spark, d, "part")
    pieces = part.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("piece")).where("piece <> ''").distinct()
    return tables.contained(part.select("p_brand", F.col("p_name").alias("t")), pieces, "p_brand", "t", "piece")


_KIND = "SELECT CAST(l_linenumber AS BIGINT) AS g, '{0}' || l_shipmode AS uid, l_suppkey AS sample, avg(CAST({1} AS DOUBLE)) AS v FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL"


@bound(f"SELECT g AS gene, a, b, n, round(r, 6) + 0.0 AS r FROM (SELECT x.g, x.uid a, y.uid b, count(*) n, corr(x.v, y.v) r, var_pop(x.v) vx, var_pop(y.v) vy FROM ({_KIND.format('x', 'l_quantity')}) x JOIN ({_KIND.format('y', 'l_discount')}) y ON x.g = y.g AND x.sample = y.sample GROUP BY 1, 2, 3) WHERE vx > 0 AND vy > 0 AND n > 2 AND r < -0.1")
def paired_correlation(spark, d):
    x = lines(spark, d).withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    kind = lambda p, c: x.groupBy(F.col("l_linenumber").alias("gene"), F.concat(F.lit(p), "mode").alias("uid"), F.col("l_suppkey").alias("sample")).agg(F.avg(F.col(c).cast("double")).alias("value"))
    return tables.paired_correlation(kind("x", "l_quantity"), kind("y", "l_discount"), "gene", -0.1)


_MARKS = "SELECT DISTINCT p_brand AS gene, l_returnflag || l_linestatus AS cluster FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_discount > 0.06"


@bound(f"WITH m AS ({_MARKS}), p AS (SELECT DISTINCT a.p_brand AS ligand, b.p_brand AS receptor FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey) SELECT DISTINCT ligand, receptor, a.cluster AS source, b.cluster AS target FROM p JOIN m a ON a.gene = ligand JOIN m b ON b.gene = receptor")
def signal_pairs(spark, d):
    x, part = lines(spark, d).where("l_quantity = 50 AND l_discount > 0.06"), table(spark, d, "part")
    marks = x.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("cluster")).distinct()
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("receptor"))
    return tables.signal_pairs(marks, part.join(nxt, "p_partkey").select(F.col("p_brand").alias("ligand"), "receptor").distinct())


@bound("SELECT DISTINCT CAST(a.l_orderkey AS BIGINT) AS l_orderkey, CAST(a.l_partkey % 11 AS BIGINT) AS guide, CAST(b.l_suppkey % 7 AS BIGINT) AS tag FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 11 = a.l_partkey % 11 AND p_size % 7 = b.l_suppkey % 7 AND p_size > 45)")
def paired_barcodes(spark, d):
    x = lines(spark, d)
    side = lambda f, c, n, k: x.where(F.col("l_returnflag") == f).select("l_orderkey", (F.col(c) % k).alias(n))
    known = table(spark, d, "part").where("p_size > 45").select((F.col("p_partkey") % 11).alias("guide"), (F.col("p_size") % 7).cast("long").alias("tag")).distinct()
    return tables.paired_barcodes(side("R", "l_partkey", "guide", 11), side("A", "l_suppkey", "tag", 7), known, "l_orderkey")


_CALLS = "SELECT l_returnflag AS comparison, CASE WHEN avg(l_quantity) > 30 THEN 'up' WHEN avg(l_quantity) < 20 THEN 'down' ELSE 'none' END AS call FROM lineitem GROUP BY l_returnflag, l_partkey"


@bound(f"SELECT comparison, count(*) FILTER (call = 'up') AS up, count(*) FILTER (call = 'down') AS down, count(*) AS n FROM ({_CALLS}) GROUP BY 1")
def regulated_counts(spark, d):
    mean = lines(spark, d).groupBy(F.col("l_returnflag").alias("comparison"), "l_partkey").agg(F.avg("l_quantity").alias("q"))
    return tables.regulated_counts(mean.withColumn("call", F.when(F.col("q") > 30, "up").when(F.col("q") < 20, "down").otherwise("none")), ["comparison"])


@bound("SELECT kind, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down FROM (SELECT DISTINCT l_orderkey, l_returnflag AS kind, CASE WHEN l_quantity > 25 THEN 'up' ELSE 'down' END AS direction FROM lineitem) GROUP BY 1")
def event_types(spark, d):
    return tables.event_types(lines(spark, d).select(F.col("l_orderkey").alias("cluster"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_quantity") > 25, "up").otherwise("down").alias("direction")))


_FREQ = "SELECT event_type AS cluster, count(*) FILTER (user_id % 2 = 0) r, count(*) n, sum(count(*) FILTER (user_id % 2 = 0)) OVER () tr, sum(count(*)) OVER () tn FROM events GROUP BY 1"
_FREQ_LN = f"({_LC.format('tr', '{0}')} + {_LC.format('(tn - tr)', '(n - {0})')} - {_LC.format('tn', 'n')})"


@bound(f"WITH o AS (SELECT cluster, CAST(r AS BIGINT) r, CAST(n AS BIGINT) n, CAST(tr AS BIGINT) tr, CAST(tn AS BIGINT) tn FROM ({_FREQ})), k AS (SELECT *, unnest(range(greatest(0, n + tr - tn), least(n, tr) + 1)) AS i FROM o) SELECT cluster, r, n, tr, tn, round(least(sum(exp({_FREQ_LN.format('i')})) FILTER ({_FREQ_LN.format('i')} <= {_FREQ_LN.format('r')} + 1e-7), 1.0), 6) + 0.0 AS p FROM k GROUP BY ALL")
def group_frequencies(spark, d):
    cells = table(spark, d, "events").select(F.col("event_type").alias("cluster"), F.when(F.col("user_id") % 2 == 0, "one").otherwise("two").alias("dataset"))
    return hypothesis.fisher_two_sided(tables.group_frequencies(cells, "cluster", "one", "two"))


@bound("SELECT CAST(l_suppkey AS BIGINT) l_suppkey, l_returnflag, count(*) AS reads, count(DISTINCT l_partkey) AS molecules FROM lineitem GROUP BY 1, 2")
def molecules(spark, d):
    return tables.molecules(lines(spark, d), "l_suppkey", "l_returnflag", "l_partkey")


@bound("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS \"distinct\", CAST(sum(l_suppkey) AS BIGINT) AS total, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def levels(spark, d):
    return tables.levels(lines(spark, d), ["l_returnflag", "l_linestatus"], "l_suppkey")


@bound(f"SELECT feature, CAST(sample AS BIGINT) AS sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS DOUBLE) AS value FROM ({_WIDE})")
def ordinal_values(spark, d):
    return tables.ordinal_values(_wide(spark, d))


@bound("SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS priority, 'customer' AS source FROM customer UNION ALL SELECT CAST(o_custkey AS BIGINT), NULL, o_orderpriority, 'orders' FROM orders")
def appended(spark, d):
    return tables.appended({"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"))}, "source")


@bound("""WITH p AS (SELECT CAST(l_extendedprice AS DOUBLE) x, CAST(l_discount AS DOUBLE) y FROM lineitem), r AS (SELECT min(x) lo, (max(x) - min(x)) / 25.0 w FROM p)
  SELECT CAST(bin AS BIGINT) AS bin, round(max(lo + (bin + 0.5) * w), 6) + 0.0 AS middle, round(quantile_cont(y, 0.8), 6) + 0.0 AS q, count(*) AS n FROM (SELECT *, least(floor((x - lo) / w), 24) AS bin FROM p, r) GROUP BY 1""")
def binned_quantile(spark, d):
    return tables.binned_quantile(lines(spark, d).select(F.col("l_extendedprice").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y")), "x", "y", 0.8, 25)


@bound("SELECT CAST(event_id AS BIGINT) event_id, round(sum(v) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running, round(avg(v) OVER (w ROWS 3 PRECEDING), 6) + 0.0 AS moving FROM (SELECT *, CAST(value AS DOUBLE) v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def framed(spark, d):
    return tables.framed(table(spark, d, "events").withColumn("v", F.col("value").cast("double")), "user_id", ["ts", "event_id"], "v", 3).select("event_id", "running", "moving")


@bound("SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, l_returnflag || l_linestatus || l_returnflag AS cleaned, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE l_returnflag || '|' || l_linestatus END AS items FROM lineitem")
def cleaned(spark, d):
    t = F.concat(F.lit('"'), "l_returnflag", F.lit("\r"), "l_linestatus", F.lit("\n"), "l_returnflag", F.lit('"'))
    return lines(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), tables.clean(t).alias("cleaned"), tables.unique_items(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_returnflag")).alias("items"))


@bound("""SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, ['Ensembl', 'Affymetrix', 'RefSeq', 'EntrezGene', 'UniGene', 'Symbol', NULL][l_linenumber] AS system FROM lineitem""")
def id_systems(spark, d):
    k = F.col("l_partkey").cast("string")
    ids = F.array(F.concat(F.lit("ENSMUSG000"), k), F.concat(k, F.lit("_at")), F.concat(F.lit("NM_00"), k), k, F.concat(F.lit("Hs."), k), F.concat(F.lit("TP"), k), F.concat(F.lit("?"), k))
    return lines(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), tables.id_system(ids[F.col("l_linenumber").cast("int") - 1]).alias("system"))


@bound("SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, '(-)' || l_returnflag || '|(+)' || l_linestatus AS flipped FROM lineitem")
def flipped_signs(spark, d):
    return lines(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), tables.flip_signs(F.concat(F.lit("(+)"), "l_returnflag", F.lit("|(-)"), "l_linestatus")).alias("flipped"))


@bound("SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linenumber))), ',') AS items FROM lineitem GROUP BY 1")
def nested_items(spark, d):
    x = lines(spark, d).withColumn("e", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    return tables.nested(x, "l_suppkey", "e").select("l_suppkey", F.array_join("items", ",").alias("items"))


@bound("SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE regexp_extract(props, '\"k\": (\\d+)', 1) IN (SELECT CAST(p_size AS VARCHAR) FROM part WHERE p_brand = 'Brand#2')")
def json_filter(spark, d):
    wanted = table(spark, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_size").cast("string").alias("value"))
    return tables.json_where(table(spark, d, "events").select("event_id", "props"), "props", "$.k", wanted).select("event_id")


@bound(f"SELECT sample, round(bin, 6) + 0.0 AS bin, count(*) AS n FROM (SELECT grp AS sample, round(value, 1) AS bin FROM ({_PRICES})) GROUP BY 1, 2")
def histogram(spark, d):
    return tables.moments(_prices(spark, d).select(F.col("grp").alias("sample"), "value"), 1)


_FOLD = "SELECT CAST(l_partkey AS BIGINT) AS feature, avg(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = 'R') - avg(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = '{}') AS f FROM lineitem GROUP BY 1"


@bound(f"SELECT feature, round(a.f, 6) + 0.0 AS a, round(b.f, 6) + 0.0 AS b, a.f * b.f < 0 AS rescued, round(-b.f / a.f, 6) + 0.0 AS share FROM ({_FOLD.format('A')}) a JOIN ({_FOLD.format('N')}) b USING (feature) WHERE a.f <> 0")
def rescued_folds(spark, d):
    mean = lambda g: F.avg(F.when(F.col("l_returnflag") == g, F.col("l_quantity").cast("double")))
    fold = lambda g: lines(spark, d).groupBy(F.col("l_partkey").alias("feature")).agg((mean("R") - mean(g)).alias("log_fold"))
    return tables.opposite_folds(fold("A"), fold("N"))


@bound("WITH m AS (SELECT l_suppkey, l_returnflag f, avg(CAST(l_quantity AS DOUBLE)) v FROM lineitem GROUP BY 1, 2) SELECT gate, CAST(l_suppkey AS BIGINT) AS sample FROM (SELECT l_suppkey, 'high' AS gate FROM m WHERE f = 'R' AND v >= 25.5 UNION ALL SELECT a.l_suppkey, 'both' FROM m a JOIN m b USING (l_suppkey) WHERE a.f = 'A' AND a.v < 25.6 AND b.f = 'N' AND b.v >= 25.2 AND b.v < 26)")
def gated(spark, d):
    m = lines(spark, d).groupBy(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("feature")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    return tables.gated(m, spark.createDataFrame([("high", "R", 25.5, None), ("both", "A", None, 25.6), ("both", "N", 25.2, 26.0)], "gate string, feature string, low double, high double"))


@bound("SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_brand) IN ('brand#12', 'brand#23') OR CAST(p_partkey AS VARCHAR) = '17'")
def matching_features(spark, d):
    m = lines(spark, d).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("feature"))
    names = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_brand").alias("symbol"))
    return tables.matching_features(m, names, ["BRAND#12", "brand#23", "17"]).select("o", "n")


@bound("WITH v AS (SELECT DISTINCT l_suppkey s, l_returnflag || l_linenumber AS v FROM lineitem WHERE l_quantity > 48 AND l_discount > 0.07) SELECT v AS variant, CAST(s AS BIGINT) AS sample, CASE WHEN EXISTS (SELECT 1 FROM v x WHERE x.v = a.v AND x.s = b.s) THEN 1 ELSE 0 END AS value FROM (SELECT DISTINCT v FROM v) a CROSS JOIN (SELECT DISTINCT s FROM v) b")
def incidence(spark, d):
    x = lines(spark, d).where("l_quantity > 48 AND l_discount > 0.07").select(F.col("l_suppkey").alias("sample"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("variant"))
    return tables.incidence(x, "sample", "variant")


@bound("SELECT CAST(l_orderkey AS BIGINT) o, CAST(l_linenumber AS BIGINT) n, 'x' || l_returnflag AS chr, CAST(l_orderkey + 1000 AS BIGINT) AS at FROM lineitem WHERE l_orderkey % 100 >= 20 AND l_orderkey % 100 < 70")
def lifted(spark, d):
    x = lines(spark, d)
    events = x.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("chr"), F.col("l_orderkey").alias("at"))
    start = F.col("k") * 100 + 20
    blocks = x.select(F.col("l_returnflag").alias("chr"), F.floor(F.col("l_orderkey") / 100).alias("k")).distinct().select("chr", start.alias("start"), (start + 50).alias("end"), F.concat(F.lit("x"), "chr").alias("to_chr"), (start + 1000).alias("to_start"))
    return tables.lifted(events, blocks, 64)
