"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for local masters that leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="keyloom-")
    return _OWN[sc.applicationId]


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Written tables of one run. A table cuts the lineage and survives lost executors.

    ``drop`` removes a table that nothing reads any more; the others go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, fs = _path(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing refers to any more, which it finds by garbage
        collection only."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = _path(self.spark, f"{self.root}/{name}")
            fs.delete(path, True)
