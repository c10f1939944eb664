"""Precision, recall, average precision and nDCG of ranked runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evaluate(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """run (qid, rank, doc_id), qrels (qid, doc_id, rel) -> one row a query that has hits and
    judgements: qid, p_<k>, r_<k>, ndcg_<k>, ap. Relevant is rel >= 1; gains are 2^rel - 1."""
    judged = qrels.groupBy("qid").agg(F.sum((F.col("rel") >= 1).cast("int")).alias("n_rel"))
    gain, ranked = F.pow(F.lit(2.0), "rel") - 1, W.partitionBy("qid").orderBy("rank")
    rows = run.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).join(judged, "qid")
    rows = rows.withColumn("hit", (F.col("rel") >= 1).cast("int")).withColumn("so_far", F.sum("hit").over(ranked.rowsBetween(W.unboundedPreceding, 0)))
    best = qrels.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    within = lambda col, k, value: F.sum(F.when(F.col(col) <= k, value).otherwise(0.0))
    ideal = best.groupBy("qid").agg(*(within("place", k, gain / F.log2(F.col("place") + 1)).alias(f"idcg_{k}") for k in ks))
    sums = rows.groupBy("qid", "n_rel").agg(
        *(within("rank", k, F.col("hit")).alias(f"h_{k}") for k in ks),
        *(within("rank", k, gain / F.log2(F.col("rank") + 1)).alias(f"dcg_{k}") for k in ks),
        F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("sum_p"),
    ).join(ideal, "qid")
    per = lambda value, by: F.when(by > 0, value / by).otherwise(0.0)
    return sums.select(
        "qid", *((F.col(f"h_{k}") / k if k else F.lit(0.0)).alias(f"p_{k}") for k in ks), *(per(F.col(f"h_{k}"), F.col("n_rel")).alias(f"r_{k}") for k in ks),
        *(per(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias(f"ndcg_{k}") for k in ks), per(F.col("sum_p"), F.col("n_rel")).alias("ap"),
    )


def with_macro(metrics: DataFrame) -> DataFrame:
    """The rows and one more, qid ALL, of their averages."""
    names = [c for c in metrics.columns if c != "qid"]
    rows = metrics.withColumn("qid", F.col("qid").cast("string"))
    return rows.unionByName(rows.agg(*(F.avg(c).alias(c) for c in names)).withColumn("qid", F.lit("ALL")))


def export_tsv(metrics: DataFrame, path: str) -> None:
    names = [c for c in metrics.columns if c != "qid"]
    out = metrics.select("qid", *(F.format_string("%.4f", c).alias(c) for c in names)).orderBy(F.col("qid") == "ALL", "qid")
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
