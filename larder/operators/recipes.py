"""The recipe shape: its schema, and the view of a plain document table in that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_A = T.ArrayType(_S)


def _struct(names: str, kind=_S):
    return T.StructType([T.StructField(n, kind) for n in names.split()])


NUTRITION = "calories fat saturated_fat cholesterol sodium carbohydrates carbs fiber sugar protein serving_size calories_from_fat"
LINK = T.StructType([*_struct("surface wiki_title type norm abstract").fields, T.StructField("categories", _A)])
#: All columns of a recipe; readers declare it, nothing is inferred.
SCHEMA = T.StructType([
    *_struct("id url title description").fields,
    T.StructField("ingredients", _A), T.StructField("instructions", _A),
    T.StructField("times", _struct("prep cook total", T.IntegerType())),
    *(T.StructField(n, _A) for n in ("cuisine", "category", "tools")),
    *_struct("yield author author_bio author_location").fields,
    T.StructField("author_stats", _struct("recipes followers", T.IntegerType())),
    T.StructField("keywords", _A),
    *_struct("date_published publication_date image").fields,
    T.StructField("all_images", _A),
    *_struct("difficulty serving_size").fields,
    T.StructField("nutrition", _struct(NUTRITION)),
    T.StructField("ratings", _struct("average rating score review_count count")),
    T.StructField("wiki_links", T.ArrayType(LINK)),
])


def complete(df: DataFrame) -> DataFrame:
    """df with every column of SCHEMA: missing ones are null, ids become strings."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as recipes: line 1 is the title, line 2 the ingredients, the rest instructions; the
    facets come from lang, source and n_chars, ratings from the id. doc_id stays a long."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"),
        F.element_at(lines, 1).alias("title"),
        F.slice(lines, 2, 1).alias("ingredients"),
        F.when(F.size(lines) > 2, F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("instructions"),
        F.array("lang").alias("cuisine"), F.array("source").alias("category"), F.array("lang", "source").alias("keywords"),
        F.lit("").alias("description"), F.col("source").alias("author"),
        F.struct((F.col("n_chars") % 60).cast("int").alias("prep"), (F.col("n_chars") % 180).cast("int").alias("cook"), (F.col("n_chars") % 240).cast("int").alias("total")).alias("times"),
        F.struct(((F.col("doc_id") % 50) / 10.0).cast("string").alias("rating"), (F.col("doc_id") % 200).cast("string").alias("review_count")).alias("ratings"),
        F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "medium").otherwise("hard").alias("difficulty"),
        F.struct((F.col("n_chars") % 900).cast("string").alias("calories"), (F.col("n_chars") % 50).cast("string").alias("protein"), (F.col("n_chars") % 70).cast("string").alias("fat")).alias("nutrition"),
        F.concat((F.col("doc_id") % 12).cast("string"), F.lit(" servings")).alias("yield"),
        F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("img/"), F.col("doc_id").cast("string"))).alias("image"),
    )
