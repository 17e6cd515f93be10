"""What explode makes is never broadcast on Spark's estimate, which takes the rows before it."""

import pytest
from pyspark.sql import functions as F

from assaylake.llm import near, setsketch, simhash


def exploded_broadcasts(plan: str) -> list[str]:
    """The broadcast exchanges right over a Generate, no other exchange or join between them."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if "Exchange" in below or "Join" in below:
                    break
                if "Generate" in below:
                    found.append(line)
                    break
    return found


@pytest.fixture
def plans(monkeypatch):
    out = []

    def noting(keep):
        def of(df):
            out.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df)

        return of

    for module in (simhash, near, setsketch):
        monkeypatch.setattr(module, "keep", noting(module.keep))
    return out


def texts(spark):
    base = " ".join(f"w{i % 83}x{i % 7}" for i in range(120))
    return spark.createDataFrame([(i, f"{base} tail{i % 9}" if i < 30 else " ".join(f"v{i}k{j}" for j in range(40))) for i in range(60)], "doc_id long, text string")


@pytest.mark.parametrize("of", [lambda d: simhash.near_duplicates(d), lambda d: near.near_copies(d, "doc_id"), lambda d: setsketch.near_duplicates(d)], ids=["simhash", "near", "setsketch"])
def test_exploded_rows_are_not_broadcast(spark, plans, of):
    out = of(texts(spark))
    assert out.count() == 60
    bad = [b for p in plans for b in exploded_broadcasts(p)]
    assert not bad, bad


def test_split_segments_are_not_broadcast(spark, plans):
    fps = spark.range(40).select(F.col("id").bitwiseOR(F.lit(7 << 40)).alias("fp"))
    found = simhash.links(fps, split=4)
    want = sum(bin(a ^ b).count("1") <= 2 for a in range(40) for b in range(a))
    assert found.count() == want
    assert not exploded_broadcasts(found._jdf.queryExecution().executedPlan().toString())
