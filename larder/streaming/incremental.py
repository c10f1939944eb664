"""An index that grows by micro-batches: each batch of recipes adds its postings once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import STOPWORDS
from ..operators.index import Index, _stats, build_index


def stream_index(recipes: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id") -> StreamingQuery:
    """Append each micro-batch's postings and lengths under path, in a folder of the batch's number:
    a batch that is run again after a failure replaces its own rows, so each counts once."""

    def add(batch: DataFrame, number: int) -> None:
        index = build_index(batch, id_col)
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.docmeta.write.mode("overwrite").parquet(f"{path}/docmeta/batch={number}")

    return recipes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> Index:
    """The index of all batches so far; a document that came again counts as its last batch has it."""
    last = spark.read.parquet(f"{path}/docmeta").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    keep = lambda name: spark.read.parquet(f"{path}/{name}").join(last, ["doc_id", "batch"], "left_semi").drop("batch")
    postings, docmeta = keep("postings"), keep("docmeta")
    stats = _stats(docmeta)
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats.select("n_docs")))
    return Index(postings, docmeta, terms.select("term", "df", F.round(F.ln(F.col("n_docs") / F.col("df")), 6).alias("idf")), stats, STOPWORDS)


def dedupe_stream(urls: DataFrame, time_col: str, url_col: str = "url", late: str = "1 day") -> DataFrame:
    """The first arrival of each URL within the watermark."""
    return urls.withWatermark(time_col, late).withColumn("sha1", F.sha1(F.col(url_col).cast("binary"))).dropDuplicatesWithinWatermark(["sha1"])
