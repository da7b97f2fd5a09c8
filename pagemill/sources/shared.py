"""Tables in the folder that all executors share: cut lineage that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a fresh local one only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CONF} has to name a folder that all executors share")
        named = getattr(spark, "_shared_folder", None) or "file://" + tempfile.mkdtemp(prefix="shared-")
        spark._shared_folder = named
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
