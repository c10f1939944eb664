"""Mixing sources to target weights: a van der Corput schedule over blocks of equally many words."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running

#: Words of a block; a source that would have fewer than LEAST_BLOCKS of them has shorter ones.
BLOCK = 2048
LEAST_BLOCKS = 512
#: Slots that one row is exploded to.
SEGMENT = 50_000
#: Sources up to which their table, some 100 bytes a row, is broadcast.
FEW_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# -- targets -------------------------------------------------------------------------------------


def _targets(sources: DataFrame, total: int, most: int) -> DataFrame:
    """sources (name, size, weight) with target: shares of the total by weight; a source stops at `most` times its
    size, and what it leaves is shared again by weight, until none is above. Each turn is two sums on the driver."""
    above = F.lit(False)
    stopped, rest, weight, target = -1, 0, 1, F.lit(0.0)
    while total:
        wide = "decimal(20,0)"
        row = sources.select(above.alias("above"), "size", "weight").agg(F.count_if("above").alias("n"), F.sum(F.when(F.col("above"), F.col("size"))).alias("full"), F.sum(F.when(~F.col("above"), F.col("weight"))).alias("w")).first()
        if row["n"] == stopped:
            break
        stopped, rest, weight = row["n"], total - most * (row["full"] or 0), row["w"]
        above = F.col("weight").cast(wide) * F.lit(rest).cast(wide) > (F.col("size") * most).cast(wide) * F.lit(weight).cast(wide)
    if total:
        target = F.when(above, (F.col("size") * most).cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight)))
    return sources.withColumn("target", target)


# -- blocks and slots ------------------------------------------------------------------------------


def _block_of(word: Column) -> Column:
    """Number of the block that holds a source's word: `long` blocks of width + 1 words come first."""
    edge = F.col("long") * (F.col("width") + 1)
    return F.when(word < edge, F.floor(word / (F.col("width") + 1))).otherwise(F.col("long") + F.floor((word - edge) / F.col("width"))).cast("long")


def _block_start(block: Column) -> Column:
    return block * F.col("width") + F.least(block, F.col("long"))


def slot_ranks(points, low, high, bits: int):
    """For each point p in [low, high): how many points of that interval the van der Corput sequence visits before p.

    The sequence visits p at the number that p's bits make in reverse. Those that come earlier share some lower bits with p
    and have 0 where p's next bit is 1: an arithmetic progression for each set bit, counted in the interval.
    """
    import numpy as np

    out = np.zeros(len(points), np.int64)
    for m in range(bits):
        first, step = points & ((1 << m) - 1), 1 << (m + 1)
        count = lambda x: np.clip((x - first + step - 1) // step, 0, 1 << (bits - 1 - m))  # noqa: E731, B023
        out += ((points >> m) & 1) * (count(high) - count(low))
    return out


def _slots(bits: int, n_slots: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            no, low, slots, blocks, point = (batch.column(c).to_numpy() for c in ("no", "low", "slots", "blocks", "point"))
            rank = slot_ranks(point, low, low + slots, bits)
            position = slot_ranks(point, np.zeros_like(point), np.full_like(point, n_slots), bits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (no, position, rank // blocks, rank % blocks)], names=["slot_no", "position", "pass", "slot_block"])

    return run


@dataclass
class Mix:
    """docs (doc_id, name, size, no, at, ...): each row's place in its source's shuffled words. sources: a row
    each with source_size, weight, target, blocks, slots. stream: what the mix takes, in pieces of documents:
    position of the slot, source's number, pass over it, block, doc_id, start and length in words."""

    docs: DataFrame
    sources: DataFrame
    stream: DataFrame


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix whole documents so that sources have their targets of words (see _targets).

    A source's documents are shuffled by a hash of their ids and cut into blocks of equally many words; a block is one
    slot of the schedule. Each source owns an interval of points as long as its number of slots; the bits of a point
    reversed are its position, so every stretch of the schedule has nearly the shares of the whole. The rank of a
    slot in its source, by arithmetic, names the block: pass after pass over the source, `most` at most, so no
    document is taken more often. Slots and blocks meet in an equi-join of even keys; what a source takes
    differs from its target by half a block. Only a few sums come to the driver.

    Null texts, and texts without words, are never taken; null sources are one source, the last in order; repeated rows are
    rows; a null id is hashed as an empty one. An empty table gives empty results. Other columns are ignored.
    """
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("name"), words(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sources = materialize(rows.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("one")))
    n_sources, n_rows, total = sources.agg(F.count(F.lit(1)), F.sum("n"), F.sum("size")).first()
    n_rows, total = n_rows or 0, total or 0
    sources = running(sources, ["name"], ["size", "one"], n_sources).withColumnRenamed("before_one", "no")
    turn = F.col("no") % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (turn + 1).cast("int"))
    sources = _targets(sources.withColumn("weight", weight), total, most)
    width = F.greatest(F.least(F.lit(block).cast("long"), F.floor(F.col("size") / least_blocks)), F.lit(1)).cast("long")
    sources = sources.withColumn("blocks", F.ceil(F.col("size") / width).cast("long"))
    sources = sources.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("size") + 0.5).cast("long"), F.col("blocks") * most)).otherwise(F.lit(0).cast("long")))
    count = F.greatest("blocks", F.lit(1))
    sources = sources.withColumns({"width": F.expr("size div greatest(blocks, 1)").cast("long"), "long": (F.col("size") % count).cast("long")})
    sources = running(materialize(sources.drop("n", "one")), ["name"], ["slots"], n_sources).withColumnRenamed("before_slots", "low")
    sources = materialize(sources.select("name", "no", F.col("size").alias("source_size"), F.col("before_size").alias("__from"), "weight", "target", "blocks", "slots", "low", "width", "long"))
    placed = running(rows, ["name", "hash", "doc_id", "size"], ["size"], n_rows)
    known = sources.withColumnRenamed("name", "__name")
    placed = placed.join(F.broadcast(known) if n_sources <= FEW_SOURCES else known, F.col("name") == F.col("__name"))
    placed = materialize(placed.withColumn("at", F.col("before_size") - F.col("__from")).drop("__name", "__from", "before_size", "hash", "low", "slots", "weight"))
    return Mix(placed, sources.drop("__from"), _stream(placed, sources, most))


def _stream(placed: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (n_slots - 1).bit_length())
    last = F.expr(f"(slots - 1) div {SEGMENT}")
    parts = sources.filter("slots > 0").select("no", "low", "slots", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.repartition(max(1, n_slots // (4 * SEGMENT)), "no", "part")
    begin = F.col("part") * SEGMENT
    points = parts.select("no", "low", "slots", "blocks", F.explode(F.sequence(begin, F.least(begin + SEGMENT, F.col("slots")) - 1)).alias("nth"))
    points = points.select("no", "low", "slots", "blocks", (F.col("low") + F.col("nth")).alias("point"))
    slots = points.mapInArrow(_slots(bits, n_slots), "slot_no long, position long, pass long, slot_block long")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(_block_of(F.col("at")), _block_of(F.col("at") + F.col("size") - 1))))
    start = F.greatest(F.col("at"), _block_start(F.col("block")))
    end = F.least(F.col("at") + F.col("size"), _block_start(F.col("block") + 1))
    pieces = pieces.select("no", "block", "doc_id", "at", (start - F.col("at")).alias("start"), (end - start).alias("length"))
    met = pieces.join(slots, (F.col("no") == F.col("slot_no")) & (F.col("block") == F.col("slot_block")))
    return met.select("position", "no", "pass", "block", "doc_id", "at", "start", "length")


def taken_words(mixed: Mix) -> DataFrame:
    """Per row of the documents: doc_id, size, source_size, target, taken (words that the stream takes, repeats counted)."""
    sums = mixed.stream.groupBy(F.col("no").alias("__no"), F.col("at").alias("__at")).agg(F.sum("length").alias("taken"))
    full = mixed.docs.filter("size > 0").join(sums, (F.col("no") == F.col("__no")) & (F.col("at") == F.col("__at")), "left")
    shown = lambda df, taken: df.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
    return shown(full, F.coalesce("taken", F.lit(0)).cast("long")).unionByName(shown(mixed.docs.filter("size = 0"), F.lit(0).cast("long")))
