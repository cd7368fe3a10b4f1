"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset, as in local tests."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sourcelake.sharedDir", None)
    if not found:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="sourcelake-")
        spark.conf.set("spark.sourcelake.sharedDir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a thousand rows at a time unless the session says otherwise: both sides hold a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ from all ``columns`` (Spark tells no cases apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


class Workspace:
    """Tables of one run. ``keep`` writes a DataFrame and reads it again, which cuts its lineage durably; ``drop`` deletes tables that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
