"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may go without the setting: all of it runs in
    one process, and a temporary folder will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larder-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows are told apart by so many hashes of their ids where it matters whether an id repeats.
BUCKETS = 1 << 18


def by_own_ids(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """rows whose id no other row has, and the rest: those with the hash of an id that repeats."""
    bucket = F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)).alias("__bucket")
    # BUCKETS numbers at most, whatever repeats
    repeated = F.broadcast(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(bucket).distinct())
    own, shared = (rows.withColumn("__bucket", bucket).join(repeated, "__bucket", how).drop("__bucket") for how in ("left_anti", "left_semi"))
    return own, shared
