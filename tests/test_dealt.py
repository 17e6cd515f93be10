"""Tasks that sort or gather rows by key get more in number with the table, not larger."""

from pyspark.sql import functions as F

from assaylake.operators import hypothesis, linear, ranks


def tasks(df):
    return df.rdd.getNumPartitions()


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", 100)
    monkeypatch.setattr(ranks.tasks_for, "__defaults__", (100,))
    monkeypatch.setattr(ranks.dealt, "__defaults__", (100,))
    for n in (2000, 6000):
        xy = spark.range(n).select((F.col("id") % 300).alias("feature"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        assert tasks(ranks.dealt(xy, ["feature"])) == n // 100 + 1
        assert tasks(hypothesis.spearman(xy)) == n // 100 + 1


def test_few_samples_are_no_keys_of_a_shuffle(spark):
    cells = spark.range(600).select((F.col("id") % 50).alias("feature"), (F.col("id") % 3).alias("sample"), F.rand(3).alias("value"))
    design = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "sample long, x array<double>")
    plan = linear.contrasts(cells, design, {"b": [0, 1]})._jdf.queryExecution().toString()
    assert "hashpartitioning(feature" in plan and "hashpartitioning(sample" not in plan
