"""Written tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only where ``spark.checkpoint.dir`` is unset (local tests) is one made here."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/loomtext-{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder under :func:`scratch_dir`, which goes when the driver's JVM ends."""
    fs, path = _folder(spark)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all written tables of this application now. Results that still read them must have been stored before."""
    fs, path = _folder(spark)
    fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later use neither recomputes it nor depends on any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
