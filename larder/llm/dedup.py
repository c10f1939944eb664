"""Exact deduplication by 128-bit content hash with a comparison of the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, row_key, without_rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=ascii_lower) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash (MD5) of the normalised text. The hash only decides where
    a row is compared: the aggregation's key is hash *and* text, so Spark compares the bytes
    inside a hash group and two texts with one hash stay apart. Copies are combined before the
    shuffle, so a group that holds a third of all rows crosses it once per task. The second join
    carries fingerprints only (MD5, SHA-256), no texts; groups of one row aren't in its small side.

    A null text counts as empty; of tied ids (repeated rows) all rows with the kept id are one
    kept row and the others copies: the row order among equal ids is not defined, `kept` is true
    on each row whose id is keep_id. A null id is never the kept one unless its whole group has
    null ids. Texts of any length are hashed and compared whole. An empty table gives no rows. Other
    columns are ignored.
    """
    found = _groups(docs, id_col, text_col, keep, normalise)
    return found.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("first.id")).alias("kept"), "text_sha256")


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise) -> DataFrame:
    """Per row doc_id, key (of its text as it is), first (its group's kept row: id, key), group_size, text_sha256."""
    pick = F.max if keep == "max" else F.min
    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("key"), text.alias("__text"))
    rows = rows.select("*", F.md5(F.col("__text").cast("binary")).alias("__md5"))
    told = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()  # so that a null id comes last
    own = F.struct(told.alias("told"), F.col("doc_id").alias("id"), "key")
    groups = rows.groupBy("__md5", "__text").agg(F.count(F.lit(1)).alias("group_size"), pick(own).alias("first")).filter(F.col("group_size") > 1)
    groups = groups.select(F.col("__md5").alias("__g"), F.sha2(F.col("__text").cast("binary"), 256).alias("__s"), "first", "group_size")
    marks = rows.select("doc_id", "key", "__md5", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"), own.alias("__own"))
    joined = marks.join(groups, (F.col("__md5") == F.col("__g")) & (F.col("text_sha256") == F.col("__s")), "left")
    return joined.select("doc_id", "key", F.coalesce("first", "__own").alias("first"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, with docs' columns: the one whose id is smallest (or
    largest, by `keep`); null ids come after all others. Rows with equal id and text are one row;
    rows that share an id but not their text are told apart. Null and empty texts are one group; very
    long ones are compared whole. An empty table gives no rows; other columns, whatever their names, are kept.
    """
    rows = materialize(_groups(docs, id_col, text_col, keep, ascii_lower).drop("text_sha256"))  # short rows
    lost = rows.filter(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))).select("doc_id", "key")
    return without_rows(docs, lost, rows.filter("group_size > 1").select("doc_id", "key"), id_col, text_col)
