"""Table operations on ids, annotations, lists and counts: filters, joins, summaries and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.operators.stats import correlation


def transpose(m: DataFrame) -> DataFrame:
    """(feature, sample, value) with samples as features: in long form the two change names."""
    return m.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")


def mask_low(m: DataFrame, total: str, least: float) -> DataFrame:
    """value is null where what it is a share of is below least."""
    return m.withColumn("value", F.when(F.col(total) >= least, F.col("value")))


def parse_event(event: Column) -> list[Column]:
    """Of 'gene:E1.1-E2.1=chr:start-end': gene, left, right, chr, start and end; null for a part that isn't there."""
    part = lambda i: F.nullif(F.regexp_extract(event, r"^([^:]+):([^=|]*?)-([^=|-]*)(?:=([^:]+):(\d+)-(\d+))?$", i), F.lit(""))
    return [part(1).alias("gene"), part(2).alias("left"), part(3).alias("right"), part(4).alias("chr"), part(5).cast("long").alias("start"), part(6).cast("long").alias("end")]


def both_sides(events: DataFrame, event: str) -> DataFrame:
    """A row for each of the ids that a bar joins, with its place."""
    return events.select("*", F.posexplode(F.split(event, r"\|")).alias("place", "side"))


def invert(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """The multimap the other way round."""
    return pairs.select(F.col(value).alias("key"), F.col(key).alias("value")).distinct()


def both_thresholds(m: DataFrame, counts: DataFrame, value: float, count: float) -> DataFrame:
    """Features with a value over one threshold in some sample, and a count over the other."""
    return m.where(F.col("value") > value).select("feature").distinct().intersect(counts.where(F.col("value") > count).select("feature").distinct())


def insufficient(folds: DataFrame, one: str, two: str, least: float) -> DataFrame:
    """folds with log_fold null and insufficient true where both groups' means are below least."""
    low = (F.col(one) < least) & (F.col(two) < least)
    return folds.withColumn("insufficient", low).withColumn("log_fold", F.when(~low, F.col("log_fold")))


def in_list_order(rows: DataFrame, wanted: DataFrame, key: str, place: str) -> DataFrame:
    """rows whose key is on an ordered list, with its place there; a key that repeats on the list has its first place."""
    return rows.join(wanted.groupBy(key).agg(F.min(place).alias(place)), key)


def enriched_terms(terms: DataFrame, changed: int, most_p: float, most_size: int, z: float) -> DataFrame:
    """Terms of more than that many changed elements, of p below a bound, not larger than a size, and of z over the bound (or, for
    a negative one, under it)."""
    far = F.col("z") > z if z >= 0 else F.col("z") < z
    return terms.where((F.col("r") > changed) & (F.col("p") < most_p) & (F.col("n") <= most_size) & far)


def detected(m: DataFrame, most_p: float, least_share: float, least_mean: float) -> DataFrame:
    """(feature, grp, value, p): features with a group in which the share of p below a bound is least_share or more, and whose
    mean value is least_mean or more."""
    g = m.groupBy("feature", "grp").agg(F.avg(F.when(F.col("p") < most_p, 1.0).otherwise(0.0)).alias("_s"), F.avg("value").alias("_m"))
    return g.where((F.col("_s") >= least_share) & (F.col("_m") >= least_mean)).groupBy("feature").agg(F.count("*").alias("groups"))


def annotated(m: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """m with the notes of its key; a key without any has nulls, one with several the smallest of each."""
    one = notes.groupBy(key).agg(*[F.min(c).alias(c) for c in notes.columns if c != key])
    return m.join(one, key, "left")


def to_genes(ids: DataFrame, names: DataFrame, source: str, gene: str) -> DataFrame:
    """Distinct (gene, source) of the ids that a table of names knows; an id of several genes counts for each."""
    return ids.join(names, source).select(gene, source).distinct()


def fallback_join(rows: DataFrame, other: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """rows with the value that other has under the first key, or else under the second; the smallest of several."""
    by = lambda k, n: other.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(value).alias(n))
    return rows.join(by(first, "_1"), first, "left").join(by(second, "_2"), second, "left").withColumn(value, F.coalesce("_1", "_2")).drop("_1", "_2")


def contained(whole: DataFrame, parts: DataFrame, key: str, text: str, piece: str) -> DataFrame:
    """(key, piece, at): pieces that are in a text of their key, and where from 1."""
    at = F.expr(f"locate(`{piece}`, `{text}`)")
    return whole.join(parts, key).where(at > 0).select(key, piece, at.alias("at")).distinct()


def paired_correlation(one: DataFrame, two: DataFrame, gene: str, most: float) -> DataFrame:
    """(gene, uid, sample, value) of two kinds: pairs of ids of one gene whose values over shared samples correlate below most."""
    a = one.select(gene, F.col("uid").alias("a"), "sample", F.col("value").alias("x"))
    b = two.select(gene, F.col("uid").alias("b"), "sample", F.col("value").alias("y"))
    r = a.join(b, [gene, "sample"]).groupBy(gene, "a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("r"), F.var_pop("x").alias("_x"), F.var_pop("y").alias("_y"))
    return r.where((F.col("_x") > 0) & (F.col("_y") > 0) & (F.col("n") > 2) & (F.col("r") < most)).drop("_x", "_y")


def signal_pairs(markers: DataFrame, pairs: DataFrame) -> DataFrame:
    """markers (gene, cluster) and pairs (ligand, receptor): distinct (ligand, receptor, source, target) clusters."""
    a = markers.select(F.col("gene").alias("ligand"), F.col("cluster").alias("source"))
    b = markers.select(F.col("gene").alias("receptor"), F.col("cluster").alias("target"))
    return pairs.join(a, "ligand").join(b, "receptor").select("ligand", "receptor", "source", "target").distinct()


def paired_barcodes(guides: DataFrame, tags: DataFrame, known: DataFrame, unit: str) -> DataFrame:
    """Distinct units with a guide and a tag that a lookup table has as a pair."""
    return guides.join(tags, unit).join(known, ["guide", "tag"], "left_semi").select(unit, "guide", "tag").distinct()


def regulated_counts(calls: DataFrame, by: list[str]) -> DataFrame:
    """How many features a comparison calls up and down."""
    return calls.groupBy(*by).agg(F.count_if(F.col("call") == "up").alias("up"), F.count_if(F.col("call") == "down").alias("down"), F.count("*").alias("n"))


def event_types(events: DataFrame) -> DataFrame:
    """(cluster, kind, direction): clusters by kind and direction, one that has several events of a kind and direction once."""
    return events.select("cluster", "kind", "direction").distinct().groupBy("kind").agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"))


def group_frequencies(cells: DataFrame, cluster: str, one: str, two: str) -> DataFrame:
    """(cluster, r, n, tr, tn) of the first of two datasets: what fisher_two_sided takes for a cluster's share in both."""
    own = cells.where(F.col("dataset").isin(one, two))
    whole = own.agg(F.count_if(F.col("dataset") == one).alias("tr"), F.count("*").alias("tn"))
    c = own.groupBy(cluster).agg(F.count_if(F.col("dataset") == one).alias("r"), F.count("*").alias("n"))
    return c.join(F.broadcast(whole))


def molecules(reads: DataFrame, barcode: str, tag: str, umi: str) -> DataFrame:
    """Reads and distinct molecules of each tag in each barcode."""
    return reads.groupBy(barcode, tag).agg(F.count("*").alias("reads"), F.countDistinct(umi).alias("molecules"))


def levels(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts, distinct values and sums for every level of a roll-up; level says how many of the keys are summed over."""
    out = rows.rollup(*by).agg(F.count("*").alias("n"), F.countDistinct(value).alias("distinct"), F.sum(value).alias("total"), F.grouping_id().alias("_g"))
    return out.withColumn("level", F.bit_count("_g")).drop("_g")


def ordinal_values(m: DataFrame) -> DataFrame:
    """Values replaced by their places in the order of their sample; equal values by feature."""
    return m.withColumn("value", F.row_number().over(W.partitionBy("sample").orderBy("value", "feature")).cast("double"))


def appended(parts: dict[str, DataFrame], source: str) -> DataFrame:
    """Result tables one after the other, each row with its table's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn(source, F.lit(n)) for n, p in parts.items()])


def binned_quantile(points: DataFrame, x: str, y: str, p: float, bins: int) -> DataFrame:
    """The quantile of y in each of `bins` equal stretches of x, and the stretch's middle."""
    r = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(r)).withColumn("bin", b.cast("long"))
    return rows.groupBy("bin").agg(F.max(F.col("_lo") + (F.col("bin") + 0.5) * width).alias("middle"), F.percentile(y, F.lit(p)).alias("q"), F.count("*").alias("n"))


def framed(rows: DataFrame, by: str, order: list[str], value: str, before: int) -> DataFrame:
    """value's running sum and its mean over a row and that many before it."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("running", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("moving", F.avg(value).over(w.rowsBetween(-before, 0)))


def clean(text: Column) -> Column:
    """Without line ends and double quotes."""
    return F.regexp_replace(text, '[\\r\\n"]', "")


def unique_items(text: Column, separator: str = "|") -> Column:
    """The distinct items of a joined list, in their order."""
    return F.array_join(F.array_distinct(F.split(text, f"\\{separator}")), separator)


def id_system(text: Column) -> Column:
    """The id system that a pattern tells, or null."""
    return (
        F.when(text.rlike("^(ENS[A-Z]*[GTP][0-9]+|FBgn[0-9]+)"), "Ensembl").when(text.rlike("_at$"), "Affymetrix").when(text.rlike(r"^[NX][MRP]_[0-9]+"), "RefSeq")
        .when(text.rlike("^[0-9]+$"), "EntrezGene").when(text.rlike("^[A-Za-z]+[0-9]*[.][0-9]+$"), "UniGene").when(text.rlike("^[A-Z][A-Z0-9]+$"), "Symbol")
    )


def flip_signs(text: Column) -> Column:
    """'+' in an item's text as '-'; where there is none, '-' as '+'; item by item of a joined list."""
    return F.array_join(F.transform(F.split(text, r"\|"), lambda x: F.when(x.contains("+"), F.replace(x, F.lit("+"), F.lit("-"))).otherwise(F.replace(x, F.lit("-"), F.lit("+")))), "|")


def nested(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values under each key, as an array."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("items"))


def json_where(rows: DataFrame, text: str, path: str, wanted: DataFrame) -> DataFrame:
    """Rows whose JSON text has at a path a value of the wanted ones (column value)."""
    return rows.withColumn("value", F.get_json_object(text, path)).join(wanted.distinct(), "value", "left_semi")


def moments(m: DataFrame, digits: int) -> DataFrame:
    """How many values of a sample round to each number: a histogram."""
    return m.where("value IS NOT NULL").groupBy("sample", F.round("value", digits).alias("bin")).agg(F.count("*").alias("n"))


def opposite_folds(one: DataFrame, two: DataFrame) -> DataFrame:
    """(feature, log_fold) of a change and of its treatment: rescued where directions are opposite, and by how much of the change."""
    j = one.select("feature", F.col("log_fold").alias("a")).join(two.select("feature", F.col("log_fold").alias("b")), "feature")
    return j.where("a <> 0").select("feature", "a", "b", (F.signum("a") * F.signum("b") < 0).alias("rescued"), (-F.col("b") / F.col("a")).alias("share"))


def gated(m: DataFrame, gates: DataFrame) -> DataFrame:
    """(sample, feature, value) and gates (gate, feature, low, high): samples whose values are all within a gate's bounds, a null
    bound being none. A feature that a sample lacks is outside."""
    n = gates.groupBy("gate").agg(F.count("*").alias("_of"))
    inside = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high")))
    met = m.join(gates, "feature").where(inside).groupBy("gate", "sample").agg(F.count("*").alias("_n"))
    return met.join(n, "gate").where("_n = _of").select("gate", "sample")


def matching_features(m: DataFrame, names: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of the features whose id or symbol is one of the targets, whatever the case."""
    low = [t.lower() for t in targets]
    hit = names.where(F.lower("feature").isin(*low) | F.lower("symbol").isin(*low)).select("feature").distinct()
    return m.join(hit, "feature", "left_semi")


def incidence(variants: DataFrame, sample: str, name: str) -> DataFrame:
    """(name, sample, 1 or 0): a binary matrix in long form of the variants that some sample has."""
    own = variants.select(sample, name).distinct().withColumn("_has", F.lit(1))
    grid = own.select(name).distinct().join(own.groupBy().agg(F.collect_set(sample).alias("_s"))).select(name, F.explode("_s").alias(sample))
    return grid.join(own, [name, sample], "left").select(name, sample, F.coalesce("_has", F.lit(0)).alias("value"))


def lifted(events: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Positions (chr, at) moved to another assembly by blocks (chr, start, end, to_chr, to_start) that don't overlap; outside of
    all, no row. Blocks and positions meet by stretches of `width` positions."""
    b = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    j = events.withColumn("_bin", F.floor(F.col("at") / width)).join(b, ["chr", "_bin"]).where("at >= start AND at < end")
    return j.select(*[F.col(c) for c in events.columns if c not in ("chr", "at")], F.col("to_chr").alias("chr"), (F.col("to_start") + F.col("at") - F.col("start")).alias("at"))
