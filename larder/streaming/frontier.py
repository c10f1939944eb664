"""A crawl frontier over a stream of events: which URLs are queued, known, taken or given up, with recovery."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How often a failed URL is tried again.
RETRIES = 3
_STATE = "source string, priority int, seq long, queued boolean, retries int, failed boolean"
_OUT = f"url string, {_STATE}, events long, accepted long, outcome string"


def transitions(rows: list[tuple], state: tuple | None, retries: int = RETRIES) -> tuple[tuple | None, int, str]:
    """(state, accepted, last outcome) of one URL after its events (seq, kind, source, priority) in order.

    enqueue: queued, unless the URL is known (queued before, or given up). take: no more queued. fail: a queued URL is
    tried again up to `retries` times, then given up; one that isn't queued is given up at once.
    """
    accepted, outcome = 0, "known"
    for seq, kind, source, priority in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind == "enqueue":
            fresh = state is None
            if fresh:
                state, accepted = (source, priority or 0, seq, True, 0, False), accepted + 1
            outcome = "queued" if fresh else "known"
        elif kind == "take":
            if state and state[3]:
                state, outcome = (*state[:3], False, *state[4:]), "taken"
        elif kind == "fail":
            own = state or (source, priority or 0, seq, False, 0, False)
            tried = own[4] + own[3]
            over = not own[3] or tried > retries
            state, outcome = (*own[:4], tried, own[5] or over), "failed" if over else "retry"
    return state, accepted, outcome


def _update(retries: int):
    def run(key, frames: Iterator, state):
        import pandas as pd

        rows = [tuple(r) for f in frames for r in f[["seq", "kind", "source", "priority"]].itertuples(index=False)]
        rows = [(int(s), k, None if x != x else x, 0 if p is None or p != p else int(p)) for s, k, x, p in rows]
        before = tuple(state.get) if state.exists else None
        after, accepted, outcome = transitions(rows, before, retries)
        if after is not None:
            state.update(after)
            yield pd.DataFrame([(*key, *after, len(rows), accepted, outcome)], columns=["url", "source", "priority", "seq", "queued", "retries", "failed", "events", "accepted", "outcome"])

    return run


def run_frontier(events: DataFrame, path: str, checkpoint: str, retries: int = RETRIES) -> StreamingQuery:
    """Keep the frontier of a stream of events (url, kind, source, priority, seq), kind enqueue, take or fail.

    Each URL has its own keyed state in Spark's state store, so no task holds all that has been seen. What a micro-batch changes
    is written to a folder of the batch's number: a batch that is run again after a failure replaces its own rows.
    """
    changes = events.groupBy("url").applyInPandasWithState(_update(retries), _OUT, _STATE, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_frontier(spark: SparkSession, path: str, max_size: int = 1_000_000) -> DataFrame:
    """(url, source, priority, seq, queued, retries, failed, offered): each URL as its last batch left it. offered is the
    number of its events. Only the first max_size URLs that were accepted, by seq, are in a full frontier; others were dropped."""
    rows = spark.read.parquet(path)
    fields = ["source", "priority", "seq", "queued", "retries", "failed"]
    last = rows.groupBy("url").agg(F.max(F.struct("batch", *fields)).alias("s"), F.sum("events").alias("offered"), F.sum("accepted").alias("accepted"))
    last = last.select("url", *(F.col(f"s.{f}").alias(f) for f in fields), "offered", "accepted")
    seen = last.filter("accepted > 0").orderBy("seq", "url").limit(max_size)
    return seen.unionByName(last.filter("accepted = 0")).drop("accepted")


def next_tasks(frontier: DataFrame, n: int) -> DataFrame:
    """The n tasks that are next: sources in turn, a source's by priority and then by arrival; none that was given up."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy(F.desc("priority"), "seq", "url")
    ready = frontier.filter("queued and not failed").withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)  # no source needs more
    return ready.orderBy("turn", "source").limit(n)


def frontier_counts(frontier: DataFrame) -> DataFrame:
    """Per source: seen, queued, taken, failed."""
    seen = F.col("queued") | ~F.col("failed") | (F.col("retries") > 0)
    return frontier.groupBy("source").agg(F.count_if(seen).alias("seen"), F.count_if("queued").alias("queued"), F.count_if(seen & ~F.col("queued")).alias("taken"), F.count_if("failed").alias("failed"))
