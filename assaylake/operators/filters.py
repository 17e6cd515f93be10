"""Row filters, scalings and joins of long matrices (feature, sample, value) and of grouped values (feature, grp, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scale(m: DataFrame) -> DataFrame:
    """One row: whether the largest value tells that the matrix isn't in logarithms, and the increment to add before taking
    them (the least value plus 1 where that is 1 at most, else 0)."""
    s = m.agg(F.max("value").alias("top"), F.min("value").alias("low"))
    return s.select((F.col("top") > 100).alias("non_log"), F.when((F.col("top") > 100) & (F.col("low") <= 1), F.col("low") + 1).otherwise(0.0).alias("increment"))


def to_log(m: DataFrame, increment: Column) -> DataFrame:
    """log2 of value + increment; what isn't positive then counts as 1.01."""
    v = F.col("value") + increment
    return m.withColumn("value", F.when(v > 0, F.log2(v)).when(v <= 0, F.log2(F.lit(1.01))))


def signed_fold(log_fold: Column) -> Column:
    """2^x of rises, -1/2^x of falls."""
    return F.when(log_fold >= 0, F.pow(F.lit(2.0), log_fold)).otherwise(-F.pow(F.lit(2.0), -log_fold))


def log_fold(signed: Column) -> Column:
    return F.when(signed > 0, F.log2(signed)).when(signed < 0, -F.log2(-signed))


def extreme_fold(m: DataFrame, k: int, least: float) -> DataFrame:
    """Features whose k-th largest value is over the k-th smallest by more than least."""
    w = W.partitionBy("feature")
    r = m.where("value IS NOT NULL").withColumn("_k", F.row_number().over(w.orderBy("value"))).withColumn("_n", F.count("*").over(w))
    s = r.groupBy("feature").agg((F.max(F.when(F.col("_k") == F.col("_n") - (k - 1), F.col("value"))) - F.max(F.when(F.col("_k") == k, F.col("value")))).alias("spread"))
    return s.where(F.col("spread") > least)


def widen(m: DataFrame, k: int, fold: float, most: int, fewest: int, step: float = 1.0, rounds: int = 200) -> tuple[DataFrame, int, float]:
    """extreme_fold() with its two limits moved until between fewest and most features stay: up by one while too many do,
    fold down by 0.2 and k by one while too few do, until k is 1 or fold 1.2. Where every limit
    keeps too many or too few it ends after `rounds` counts, with the limits of the last. Only counts come to the driver."""
    while True:
        kept = extreme_fold(m, k, fold)
        n = kept.count()
        rounds -= 1
        if n > most and rounds > 0:
            k, fold = k + 1, fold + step
        elif n < fewest and k > 1 and fold - 0.2 >= 1.2 and rounds > 0:
            k, fold = k - 1, fold - 0.2
        else:
            return kept, k, fold


def most_varied(m: DataFrame, n: int) -> DataFrame:
    """The n features of the largest coefficients of variation; ties by feature. Rounded, so that ties are ties."""
    s = m.groupBy("feature").agg(F.round(F.try_divide(F.stddev_samp("value"), F.avg("value")), 6).alias("cv")).where("cv IS NOT NULL")
    return s.orderBy(F.desc("cv"), "feature").limit(n)


def dispersed(m: DataFrame, n: int, distinct: int = 5, leave_out: str = "") -> DataFrame:
    """The n features of the largest variance over mean among those of more than that many distinct values; a pattern
    leaves features out by name."""
    if leave_out:
        m = m.where(~F.col("feature").rlike(leave_out))
    s = m.groupBy("feature", "value").agg(F.count("*").alias("c")).groupBy("feature").agg(
        F.count("*").alias("_d"), F.sum("c").alias("_n"), F.sum(F.col("c") * F.col("value")).alias("_s"), F.sum(F.col("c") * F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    s = s.where(F.col("_d") > distinct).select("feature", F.round(F.try_divide(F.col("_q") / F.col("_n") - mean * mean, mean), 6).alias("dispersion"))
    return s.where("dispersion IS NOT NULL").orderBy(F.desc("dispersion"), "feature").limit(n)


def present_in_group(m: DataFrame, percent: float, least: int) -> DataFrame:
    """Features with a group of that many values of which that percentage is present, and with values that differ."""
    g = m.groupBy("feature", "grp").agg((F.count("value") * 100.0 / F.count("*")).alias("_p"), F.count("value").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    s = g.groupBy("feature").agg(F.count_if((F.col("_p") >= percent) & (F.col("_n") >= least)).alias("groups"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return s.where("groups > 0 AND _hi > _lo").select("feature", "groups")


def detected_in(m: DataFrame, n_samples: int, share: float) -> DataFrame:
    """Features missing in fewer than n_samples - int(share * n_samples) samples."""
    s = m.where("value IS NOT NULL").groupBy("feature").agg((F.lit(n_samples) - F.countDistinct("sample")).alias("missing"))
    return s.where(F.col("missing") < n_samples - int(share * n_samples))


def bimodal(m: DataFrame, least: int, low: float = 0.4, high: float = 0.6) -> DataFrame:
    s = m.groupBy("feature").agg(F.count_if(F.col("value") > high).alias("high"), F.count_if(F.col("value") < low).alias("low"))
    return s.where((F.col("high") >= least) & (F.col("low") >= least))


def rich_samples(m: DataFrame, over: float, features: int) -> DataFrame:
    """Samples with more than that many features over the threshold."""
    return m.where(F.col("value") > over).groupBy("sample").agg(F.countDistinct("feature").alias("features")).where(F.col("features") > features)


def per_ten_thousand(m: DataFrame) -> DataFrame:
    """log2(10,000 v / total of the sample + 1); zero stays zero."""
    total = F.sum("value").over(W.partitionBy("sample"))
    return m.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.log2(F.col("value") * 10000.0 / total + 1.0)))


def rpkm_offset(m: DataFrame, size: str) -> DataFrame:
    """1e9 (count + 1) / (length * library size), zero counts against the average library size."""
    lib = m.groupBy("sample").agg(F.sum("value").alias("_lib"))
    lib = lib.join(F.broadcast(lib.agg(F.avg("_lib").alias("_mean"))))
    n = F.col("value")
    return m.join(lib, "sample").withColumn("rpkm", F.when(n == 0, F.lit(1e9) / (F.col("_mean") * F.col(size))).otherwise((n + 1) * 1e9 / (F.col("_lib") * F.col(size)))).drop("_lib", "_mean")


def quartile_range(m: DataFrame) -> DataFrame:
    """The values at 0-based places n * 75 div 100 and n * 25 div 100 of the sorted values, and their difference."""
    w = W.partitionBy("feature")
    r = m.where("value IS NOT NULL").withColumn("_k", F.row_number().over(w.orderBy("value")) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("_k") == F.floor(F.col("_n") * p / 100), F.col("value")))
    return r.groupBy("feature").agg(at(25).alias("q1"), at(75).alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))


def shape(m: DataFrame) -> DataFrame:
    """Skewness, excess kurtosis, coefficient of variation, harmonic and geometric means, mode (the smallest), distinct
    values and the median absolute deviation."""
    v = F.col("value")
    spread = F.var_pop(v) > 0
    s = m.groupBy("feature").agg(
        F.when(spread, F.skewness(v)).alias("skew"), F.when(spread, F.kurtosis(v)).alias("kurt"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"),
        F.when(F.min(v) > 0, F.count(v) / F.sum(F.when(v > 0, 1 / v))).alias("harmonic"), F.when(F.min(v) > 0, F.exp(F.avg(F.when(v > 0, F.ln(v))))).alias("geometric"))
    counts = m.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("_c"))
    modes = counts.groupBy("feature").agg(F.min(F.struct(-F.col("_c"), "value"))["value"].alias("mode"), F.count("*").alias("n_distinct"))
    away = m.withColumn("_d", F.abs(v - F.median("value").over(W.partitionBy("feature")))).groupBy("feature").agg(F.median("_d").alias("mad"))
    return s.join(modes, "feature").join(away, "feature")


def group_span(m: DataFrame) -> DataFrame:
    """The largest less the smallest group mean, and how many groups there are."""
    g = m.groupBy("feature", "grp").agg(F.avg("value").alias("mean"))
    return g.groupBy("feature").agg(F.count("*").alias("groups"), (F.max("mean") - F.min("mean")).alias("span"))


def roll_up(x: DataFrame) -> DataFrame:
    """(gene, part, sample, value, core): the mean of a gene's expressed core parts, of all expressed parts where none of its
    core parts is expressed in any sample."""
    v, expressed = F.col("value"), F.col("value") > 0
    s = x.groupBy("gene", "sample").agg(F.avg(F.when(F.col("core") & expressed, v)).alias("_core"), F.avg(F.when(expressed, v)).alias("_all"))
    has = F.max(F.col("_core").isNotNull()).over(W.partitionBy("gene"))
    return s.select("gene", "sample", F.when(has, F.col("_core")).otherwise(F.col("_all")).alias("value")).where("value IS NOT NULL")


def collapse(m: DataFrame) -> DataFrame:
    return m.groupBy("feature", "sample").agg(F.avg("value").alias("value"))


def merge_rows(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join that keeps every pair of duplicates; columns carry their table's name."""
    return reduce(lambda a, b: a.join(b, key), [p.select(key, *[F.col(c).alias(f"{n}_{c}") for c in p.columns if c != key]) for n, p in parts.items()])


def side_by_side(one: DataFrame, two: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of the same place in each group's order beside each other; a longer side has nulls."""
    w = W.partitionBy(*by).orderBy(order)
    a, b = (t.select(*by, F.row_number().over(w).alias("place"), F.col(order).alias(n)) for t, n in ((one, "a"), (two, "b")))
    return a.join(b, [*by, "place"], "full_outer")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def where_metadata(rows: DataFrame, rules: list[tuple[str, str, object]], order: str) -> DataFrame:
    """Rules by field: ('restrict', f, values), ('exclude', f, values), ('above' or 'below', f, number; what is no number
    goes), and ('unique', f, None), which keeps each value's first row in the given order. All but unique are one filter."""
    tests, unique = [], []
    for kind, field, arg in rules:
        if kind == "restrict":
            tests.append(F.col(field).isin(*arg))
        elif kind == "exclude":
            tests.append(~F.coalesce(F.col(field).isin(*arg), F.lit(False)))
        elif kind in ("above", "below"):
            number = F.col(field).cast("string").try_cast("double")
            tests.append(number > arg if kind == "above" else number < arg)
        elif kind == "unique":
            unique.append(field)
        else:
            raise ValueError(f"no such rule: {kind}")
    if tests:
        rows = rows.where(reduce(lambda a, b: a & b, tests))
    for field in unique:
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(field).orderBy(order))).where("_k = 1").drop("_k")
    return rows
