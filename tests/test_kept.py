"""Rounds leave no shuffle files behind, and page_rank's edges are dealt out once in some rounds."""

import os
import time

import pytest
from pyspark.sql import functions as F

from assaylake.operators import network
from assaylake.sources import kept as module


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for d in dirs for _, _, names in os.walk(d.toString()) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_a_written_round_leaves_no_shuffle_files(spark):
    before = shuffled(spark), spark.conf.get(module.CLEANED, None)
    out = module.kept(spark.range(10_000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    assert spark.conf.get(module.CLEANED, None) == before[1]
    end = time.time() + 20
    while shuffled(spark) - before[0] and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before[0]
    assert out.agg(F.sum("n")).first()[0] == 10_000


def test_page_rank_reads_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(network, "kept", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or module.kept(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("a", "b"), (None, "a")], "a string, b string")
    got = {r.node: r["rank"] for r in network.page_rank(edges, 10).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["b"] > got["a"] == pytest.approx(got["c"])
    assert len(written) == 4 and sum("FileScan" not in p for p in written) == 1
    assert not any("BroadcastExchange" in p for p in written[1:])
