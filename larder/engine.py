"""One object over an index and a recipe table: what a search service or command line calls."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boolean, facets, filters, recipes, search
from .operators.boolean import PositionalIndex, build_positional_index
from .operators.index import FieldIndex, Index, build_field_index, build_index
from .sources import files


class Engine:
    def __init__(self, spark: SparkSession, table: DataFrame, index: Index | None = None, id_col: str = "doc_id"):
        self.spark, self.table, self.id_col = spark, table, id_col
        self.index = index or build_index(table, id_col)
        self.fields: FieldIndex | None = None  # built with the first boosted-field query, or loaded
        self.positions: PositionalIndex | None = None  # with the first Boolean one
        self.asked: list[tuple[int, float]] = []

    @classmethod
    def from_recipes(cls, spark: SparkSession, path: str) -> Engine:
        rows = files.read_recipes(spark, path).filter("_corrupt is null").drop("_corrupt")
        return cls(spark, rows.withColumn("doc_id", F.col("id").cast("long")))

    @classmethod
    def from_documents(cls, spark: SparkSession, path: str) -> Engine:
        return cls(spark, recipes.from_documents(spark.read.parquet(path)))

    def cache(self) -> Engine:
        """Keep the index, with the terms' impacts in order, in memory for interactive queries."""

        def keep(name):
            df = getattr(self.index, name).cache()
            df.count()
            setattr(self.index, name, df)

        for name in ("postings", "docmeta", "terms", "stats"):
            keep(name)
        if self.index.impacts is None:
            self.index = self.index.with_impacts()
            self.index.impacts = self.index.impacts.sortWithinPartitions("term")
        keep("impacts")
        return self

    def allowed(self, settings: dict | None) -> DataFrame | None:
        return filters.apply_filters(self.table, settings).select(F.col(self.id_col).alias("doc_id")) if settings and any(settings.values()) else None

    def search(self, query: str, metric: str = "bm25", k: int = 10, settings: dict | None = None, offset: int = 0) -> DataFrame:
        if k <= 0:
            raise ValueError("k must be positive")
        return search.search(self.index, query, metric, k, self.allowed(settings), offset)

    def field_search(self, query: str, k: int = 10, similarity: str = "bm25", settings: dict | None = None) -> DataFrame:
        kept = filters.apply_index_filters(self.table, settings or {}).select(F.col(self.id_col).alias("doc_id")) if settings else None
        if self.fields is None:
            self.fields = build_field_index(self.table, self.id_col)
            for name in ("postings", "fields"):
                setattr(self.fields, name, getattr(self.fields, name).cache())
        return search.field_search(self.fields, query, k, similarity, kept)

    def boolean_search(self, query: str, k: int = 10, settings: dict | None = None, tree=None) -> DataFrame:
        """The k best as wide rows (boolean.hits), all that is asked adding to the score; or what a clause tree matches."""
        if self.positions is None:
            self.positions = build_positional_index(self.table, self.id_col)
            for name in ("postings", "fields", "docs"):
                setattr(self.positions, name, getattr(self.positions, name).cache())
        return boolean.hits(self.positions, boolean.search(self.positions, tree or boolean.settings_clause(query, settings or {}), k))

    def render(self, hits: DataFrame, quiet: bool = False) -> list[str]:
        """A line a hit, of k rows at most: id and score for other programs, or rank, title, minutes, cuisine and URL for people."""
        rows = hits.orderBy("rank").collect()
        if quiet:
            return [f"{r['docId']}\t{r['score']:.4f}" for r in rows]
        return [" | ".join(str(x) for x in (f"{r['rank']}.", r["title"] or f"Document {r['docId']}", f"{r['total_minutes']} min" if r["total_minutes"] else "", r["cuisine"], r["url"]) if x) for r in rows]

    def page(self, query: str, page: int = 1, per_page: int = 10, metric: str = "bm25", settings: dict | None = None) -> dict:
        """A service's answer: hits with the recipes' columns, total and pages. One page reaches the driver."""
        began = time.time()
        total = self.count(query, settings)
        numbers = search.page_numbers(total, page, per_page)
        hits = self.search(query, metric, per_page, settings, numbers["offset"])
        rows = self.table.withColumn("doc_id", F.col(self.id_col)).join(F.broadcast(hits), "doc_id").orderBy("rank")
        found = [r.asDict(recursive=True) for r in rows.collect()]
        self.asked.append((len(found), time.time() - began))
        return {"results": found, "total": total, "page": page, "per_page": per_page, "total_pages": numbers["total_pages"]}

    def count(self, query: str, settings: dict | None = None) -> int:
        return search.count_hits(self.index, query, self.allowed(settings)).first()["total"]

    def recipe(self, doc_id) -> DataFrame:
        return self.table.filter(F.col(self.id_col) == doc_id).limit(1)

    def stats(self) -> DataFrame:
        """One row: documents, terms, postings, average length; and what was asked so far."""
        counts = self.index.terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
        n = len(self.asked)
        return self.index.stats.crossJoin(counts).select("*", F.lit(n).alias("queries_processed"), F.lit(sum(a for a, _ in self.asked)).alias("total_results"))

    def cuisines(self) -> DataFrame:
        return facets.distinct_values(self.table, "cuisine")

    def categories(self) -> DataFrame:
        return facets.all_facets(self.table, [c for c in ("cuisine", "category", "keywords") if c in self.table.columns])

    def health(self) -> dict:
        return {"status": "healthy", "spark": self.spark.version}
