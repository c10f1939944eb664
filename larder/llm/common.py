"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch that reaches Python: whole texts are long, and both sides hold a batch.
BATCH = "1000"
#: Rows of a range whose sums are taken in one task.
RANGE = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus. The session's Arrow batches, where nobody has set their size, are made smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only where neither the setting nor the context names a folder and all runs in one process
    (a local master, as in tests) a temporary one is used; a cluster without a shared folder is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larder-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nobody holds any more: it does so once the driver's garbage is
    collected, which without a word may be long after a job."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_cache(kind: str = "") -> dict:
    """A dict that lives as long as the Python worker, for loaded vocabularies and the like of one kind.

    Functions are shipped by value, so their module globals are new in each task; this isn't. Workers
    serve one operator after another: what another kind has left is dropped and its memory given back.
    """
    kept = sys.modules.setdefault("_larder_worker", types.ModuleType("_larder_worker")).__dict__
    if kept.get("kind") != kind:
        import ctypes
        import gc

        kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        kept["kind"] = kind
    return kept


def broadcast_if_small(df: DataFrame, n_bytes: int, bound: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the measured size is under the bound."""
    return F.broadcast(df) if n_bytes <= bound else df


def few(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """The rows of df, which are short; broadcast if they are counted to be few, shuffled beyond that."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= bound else df


def row_key(text):
    """A number for a row's text; with the id it tells rows apart where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def without_rows(docs: DataFrame, lost: DataFrame, every: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that aren't in lost, one of each id and text. lost, every: (id, row_key) of the
    rows that go and of all rows. Texts stay where they are unless very many rows go."""
    names = [f"__larder_{i}" for i in range(3)]
    own = docs.select("*", docs[id_col].cast("long").alias(names[0]), row_key(docs[text_col]).alias(names[1]))
    same = lambda other: own[names[0]].eqNullSafe(other["__i"]) & (own[names[1]] == other["__k"])
    lost = few(lost.toDF("__i", "__k").distinct())
    repeated = materialize(every.toDF("__i", "__k").groupBy("__i", "__k").count().filter("count > 1").select("__i", "__k"))
    if not repeated.isEmpty():  # rows that repeat id and text: one of each
        again = few(repeated)
        once = own.join(again, same(again), "left_semi").dropDuplicates(names[:2])
        own = own.join(again, same(again), "left_anti").unionByName(once)
    return own.join(lost, same(lost), "left_anti").drop(*names[:2])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    materialize(spark.range(1))  # names the shared folder where nothing has
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sums(values: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), [0] * len(values)
        for batch in batches:
            cols = list(batch.columns)
            for i, name in enumerate(values):
                n = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.cumsum(n)
                cols.append(pa.array(total - n + before[i], pa.int64()))
                before[i] += int(total[-1]) if len(n) else 0
            cols.append(pa.array(np.full(batch.num_rows, part), pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *(f"before_{v}" for v in values), "__part"])

    return run


def running(rows: DataFrame, order: Sequence[str], values: list[str], n_rows: int) -> DataFrame:
    """rows with before_<value> for each of values (longs): its sum over all rows that come before, by `order`.

    Ranges of the order are summed in their tasks; the sums of ranges, one row each, meet in a window.
    Rows that tie in the whole order are in one range.
    """
    kind = T.StructType([*rows.schema.fields, *(T.StructField(f"before_{v}", T.LongType()) for v in values), T.StructField("__part", T.LongType())])
    dealt = rows.repartitionByRange(max(1, -(-n_rows // RANGE)), *order).sortWithinPartitions(*order)
    own = materialize(dealt.mapInArrow(_sums(values), kind))
    sums = own.groupBy(F.col("__part").alias("__p")).agg(*(F.sum(v).alias(f"__{v}") for v in values))
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sums = materialize(sums.select("__p", *(F.coalesce(F.sum(f"__{v}").over(w), F.lit(0)).alias(f"__{v}") for v in values)))
    met = own.join(sums, F.col("__part") == F.col("__p"))
    return met.select(*rows.columns, *((F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values))
