"""Facets, sorts, grouped lists and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import numbered
from .store import materialize


def distinct_values(df: DataFrame, array_col: str) -> DataFrame:
    """Sorted distinct values, trimmed and lower-cased, without blanks."""
    return df.select(F.explode(array_col).alias("v")).select(F.lower(F.trim("v")).alias("value")).filter("value <> ''").distinct().orderBy("value")


def facet_counts(df: DataFrame, array_col: str, top: int = 15) -> DataFrame:
    """The most common values of a facet, by count, then value."""
    return df.select(F.explode(array_col).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def all_facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several facets in one pass and one shuffle."""

    def tagged(name):
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    pairs = F.concat(*map(tagged, columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def matching_options(options: DataFrame, part: str, value_col: str = "value") -> DataFrame:
    """Options that hold what was typed, in any case; all of them for nothing."""
    return options.filter(F.contains(F.lower(value_col), F.lit(part.lower())))


def shortest_name(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Each id's canonical name: the shortest, then the first in order."""
    return df.groupBy(id_col).agg(F.min(F.struct(F.length(name_col).alias("l"), F.col(name_col).alias("name"))).alias("m")).select(id_col, F.col("m.name").alias("name"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int = 5) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def sort_recipes(df: DataFrame, by: str, id_col: str = "doc_id") -> DataFrame:
    """rating (best first, missing 0), time_asc (missing or 0 last, as 999), time_desc, title, date (newest first)."""
    total = F.col("times.total")
    keys = {
        "rating": lambda: F.desc(F.coalesce(F.col("ratings.rating").try_cast("double"), F.lit(0.0))),
        "time_asc": lambda: F.coalesce(F.nullif(total, F.lit(0)), F.lit(999)),
        "time_desc": lambda: F.desc(F.coalesce(total, F.lit(0))),
        "title": lambda: F.lower("title"),
        "date": lambda: F.desc(F.coalesce(F.try_to_timestamp(F.nullif("date_published", F.lit(""))), F.lit("1970-01-01").cast("timestamp"))),
    }
    return df.orderBy(keys[by](), id_col)


def neighbours(df: DataFrame, id_col: str, order: list, group: list[str] | None = None) -> DataFrame:
    """Each row's id with the one before and after it, round the ends of its group, or of the whole table: there rows are
    numbered by ranges of the order and meet those with the next numbers, so no task sees them all."""
    if not group:
        rows = materialize(numbered(df, order, "__at").select(id_col, "__at"))
        n = max(1, rows.count())
        beside = lambda by, name: rows.select(F.col(id_col).alias(name), ((F.col("__at") + by) % n).alias(f"__{name}"))
        met = rows.join(beside(1, "prev_id"), F.col("__at") == F.col("__prev_id")).join(beside(n - 1, "next_id"), F.col("__at") == F.col("__next_id"))
        return met.select(id_col, "prev_id", "next_id")
    w = W.partitionBy(*group).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag(id_col).over(w), F.last(id_col).over(whole))
    after = F.coalesce(F.lead(id_col).over(w), F.first(id_col).over(whole))
    return df.select(*group, id_col, before.alias("prev_id"), after.alias("next_id"))


def success_stats(df: DataFrame, ok) -> DataFrame:
    """One row: total, success, failed, rate."""
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return df.agg(n.alias("total"), good.alias("success"), (n - good).alias("failed"), F.when(n > 0, good / n).otherwise(0.0).alias("rate"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def distribution(df: DataFrame, columns: list[str], targets: dict[str, int] | None = None) -> DataFrame:
    """(dimension, value, n, progress): counts of each column's values, in one pass by grouping sets,
    with the share of a target that is reached (null without one)."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dims, values = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        only = ((1 << len(columns)) - 1) & ~(1 << (len(columns) - 1 - i))
        dims = F.when(F.col("g") == only, F.lit(c)).otherwise(dims)
        values = F.when(F.col("g") == only, F.col(c).cast("string")).otherwise(values)
    goal = F.lit(None).cast("double")
    for name, target in (targets or {}).items():
        goal = F.when(values == name, F.lit(float(target))).otherwise(goal)
    return sets.select(dims.alias("dimension"), values.alias("value"), "n", (F.col("n") / goal * 100).alias("progress"))
