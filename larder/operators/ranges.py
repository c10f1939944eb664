"""Numbers of rows in an order over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize


def _numbers(batches):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        own = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(own)], names=[*batch.schema.names, "__part", "__n"])


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """rows with `name`, their number from 0 in the order: ranges of the order are numbered in their tasks, and the
    ranges' sizes, one row each, are added up. Rows that tie in the order are in one range, numbered in no set order."""
    kind = T.StructType([*rows.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__n", T.LongType())])
    own = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbers, kind))
    sizes = own.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    before = sizes.select("__p", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"))
    met = own.join(before, F.col("__part") == F.col("__p"))
    return met.select(*rows.columns, (F.col("__before") + F.col("__n")).alias(name))
