"""The corpus pipeline: toxicity, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents for the rows that stay, whatever other columns there are and however they are
called. Rows are told apart by id and text: where ids repeat each text is judged by itself, and of rows
with equal id and text one stays. Null texts count as empty; the empty texts of a table are copies of
each other. A null id counts as the largest. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import common, decontamination, dedup, jaccard, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; the classifier learns from labels of these docs. Empty texts stay."""
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, A-Z lower-cased: the one with the smallest id."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles, similarity 0.8 or more; the smallest id of each group stays. Texts without words stay."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, within the edits that its length allows."""
    return decontamination.drop_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece (see packing.pack); an empty text is its end id alone, a null id stays null."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Classifier, alignment and tokenizer can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again for the next."""
    folder = common.shared_folder(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return common.materialize(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        common.remove_folder(spark, folder)
