"""Tables written to the shared folder, which cut lineage without a machine's own disk."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session that has none gets one of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="aerograph-")  # driver and executors are one process here; removed with it
        atexit.register(shutil.rmtree, made, True)
        known = f"file://{made}"
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """(``df`` as written to the shared folder and read back, its path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aerograph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written to the shared folder; the table stays there for whoever reads the result."""
    return write(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Cuts lineage as ``cut`` does, and removes its tables at the end of a ``with`` block: what leaves it must be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        out, path = write(df, label)
        self.paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
