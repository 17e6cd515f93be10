"""Queries of aligned reads and isoforms, which order lines and parts stand for: a part is a gene with three exons, a line a
read of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import isoforms, reads
from assaylake.plans.bindings import bound
from assaylake.sources.tables import table

_READS = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS id, l_partkey AS gene, (l_partkey % 3) AS chrom, l_partkey * 100 + 100 + CAST(l_quantity AS BIGINT) % 20 AS pos, 20 - CAST(l_quantity AS BIGINT) % 20 AS n,
  l_orderkey % 4 AS kind, 5 + l_linenumber AS m FROM lineitem"""
_ALIGNED = f"""SELECT id, gene, chrom, CASE WHEN kind = 0 THEN [[pos, pos + m - 1]] WHEN kind = 1 THEN [[pos, pos + n - 1], [pos + n + 20, pos + n + 19 + m]]
  WHEN kind = 2 THEN [[pos, pos + n - 1], [pos + n + 60, pos + n + 59 + m]] ELSE [[pos, pos + n + m - 1]] END AS b FROM ({_READS})"""
_EXONS = """SELECT p_partkey * 10 + i AS key, p_partkey AS gene, (p_partkey % 3) AS chrom, p_partkey * 100 + 100 + 40 * i AS s, p_partkey * 100 + 100 + 40 * i + 19 AS e FROM part, (SELECT unnest([0, 1, 2]) AS i)"""
_FORMS = """SELECT p_partkey AS gene, (p_partkey % 3) AS chrom, f.name AS isoform, list_transform(f.x, lambda v: [p_partkey * 100 + 100 + v[1], p_partkey * 100 + 100 + v[2]]) AS x FROM part,
  (SELECT unnest([{'name': 'long', 'x': [[0, 19], [40, 59], [80, 99]]}, {'name': 'short', 'x': [[0, 19], [80, 99]]}, {'name': 'kept', 'x': [[0, 59], [80, 99]]}]) AS f) WHERE f.name <> 'kept' OR p_partkey % 2 = 0"""
_FITS = f"""SELECT r.id, f.gene, f.isoform FROM (SELECT r.*, f.gene AS g, f.isoform AS i, list_filter(f.x, lambda v: v[2] >= r.b[1][1] AND v[1] <= r.b[-1][2]) AS own FROM ({_ALIGNED}) r JOIN ({_FORMS}) f ON f.chrom = r.chrom AND f.x[1][1] <= r.b[-1][2] AND f.x[-1][2] >= r.b[1][1]) r
  JOIN ({_FORMS}) f ON f.gene = r.g AND f.isoform = r.i
  WHERE len(own) = len(b) AND own[1][1] <= b[1][1] AND own[-1][2] >= b[-1][2] AND (len(b) = 1 OR (own[1][2] = b[1][2] AND own[-1][1] = b[-1][1] AND b[1][2] - b[1][1] >= 3 AND b[-1][2] - b[-1][1] >= 3))"""


def _reads(spark, d):
    q, key = F.col("l_quantity").cast("long") % 20, F.col("l_orderkey") % 4
    n, m = (20 - q).cast("string"), (5 + F.col("l_linenumber")).cast("string")
    whole = (20 - q + 5 + F.col("l_linenumber")).cast("string")
    cigar = F.when(key == 0, F.concat(m, F.lit("M"))).when(key == 1, F.concat(n, F.lit("M20N"), m, F.lit("M"))).when(key == 2, F.concat(n, F.lit("M60N"), m, F.lit("M"))).otherwise(F.concat(whole, F.lit("M")))
    x = table(spark, d, "lineitem")
    tags = F.lit(None).cast("map<string,string>").alias("tags")
    return x.select(F.lit("lines").alias("file"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string"), F.col("l_quantity").cast("string")).alias("name"), F.lit(0).alias("flag"), (F.col("l_partkey") % 3).cast("string").alias("chrom"), (F.col("l_partkey") * 100 + 100 + q).alias("pos"), cigar.alias("cigar"), F.lit("").alias("seq"), tags)


def _forms(spark, d):
    k = F.col("p_partkey")
    some = {"long": [(0, 19), (40, 59), (80, 99)], "short": [(0, 19), (80, 99)], "kept": [(0, 59), (80, 99)]}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("isoform"), F.array(*(F.struct((k * 100 + 100 + a).alias("start"), (k * 100 + 100 + b).alias("end")) for a, b in xs)).alias("exons")) for name, xs in some.items())))
    return table(spark, d, "part").select(k.alias("gene"), (k % 3).cast("string").alias("chrom"), each.alias("f")).select("gene", "chrom", "f.*").where("isoform <> 'kept' or gene % 2 = 0")


@bound(f"""SELECT CAST(key AS BIGINT) AS key, count(id) AS reads FROM ({_EXONS}) x LEFT JOIN ({_ALIGNED}) r ON r.chrom = x.chrom AND r.b[1][1] <= e AND r.b[-1][2] >= s AND (len(b) = 1
  OR b[1][1] BETWEEN s AND e OR b[-1][2] BETWEEN s AND e OR b[1][2] = e OR b[-1][1] = s) GROUP BY 1""")
def exon_reads(spark, d):
    k = F.col("p_partkey")
    exons = table(spark, d, "part").select(k, (k % 3).cast("string").alias("chrom"), F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("i"))
    exons = exons.select((k * 10 + F.col("i")).alias("key"), "chrom", (k * 100 + 100 + 40 * F.col("i")).alias("start"), (k * 100 + 100 + 40 * F.col("i") + 19).alias("end"), F.lit("+").alias("strand"))
    return reads.exon_reads(_reads(spark, d), exons)


@bound(f"SELECT CAST(gene AS BIGINT) AS gene, isoforms, count(*) AS reads FROM (SELECT id, gene, string_agg(isoform, ',' ORDER BY isoform) AS isoforms FROM ({_FITS}) GROUP BY 1, 2) GROUP BY 1, 2")
def isoform_reads(spark, d):
    x = reads.read_classes(reads.compatible(_reads(spark, d), _forms(spark, d), 4))
    return x.select("gene", F.array_join("isoforms", ",").alias("isoforms"), "reads")


@bound("")
def isoform_psi(spark, d):
    classes = reads.read_classes(reads.compatible(_reads(spark, d), _forms(spark, d), 4))
    x = isoforms.sampled(classes, isoforms.lengths(_forms(spark, d), 25, 4))
    return x.select("gene", "isoform", "psi", "low", "high", "reads")
