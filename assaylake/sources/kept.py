"""Results kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Spark's switch for deleting a query's shuffle files when it ends. Else they stay until the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_root: dict[str, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back: lineage ends there, so an iterative operator plans each
    round afresh and a lost executor loses nothing. Where that is unset, a temporary folder serves if all runs on this machine;
    on a cluster it is an error. What the write shuffled is deleted when it ends: its rows are in the files then, and no other query has
    those shuffles."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="assaylake-")
        _own_root[app] = root
    path = f"{root}/round-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what kept() wrote for df, which no later plan may read."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
