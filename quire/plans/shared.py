"""Tables in the folder that all executors share: they cut lineage, and a lost executor rereads them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    cached = getattr(shared_dir, "_local", None)
    if cached is None:
        cached = shared_dir._local = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, cached, ignore_errors=True)
    return cached


class Stages:
    """Writes tables under a folder of its own and reads them back."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
