"""Pareto fronts: layers of non-dominated rows, by type and over all, and the shop's offers in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialize, running

#: Layers that are told apart; rows beyond are layer 0.
LAYERS = 12
#: Rows that one task places.
BLOCK = 16_384
#: Stands for a null measure: worse than all numbers and equal to itself.
WORST = (1 << 63) - 1
#: Newest members of a front that are compared at once.
CHUNK = 512
COSTS = ("k1", "k2", "k3", "k4")
_PLACED = "g string, k1 long, k2 long, k3 long, k4 long, layer int"


# -- sorted insertion ------------------------------------------------------------------------------


class Fronts:
    """Fronts of rows that arrive in lexicographic order, so that a row is dominated by earlier ones only and
    the first cost needs no comparison. Rows are distinct: one that is nowhere worse dominates."""

    def __init__(self, limit: int):
        self.limit, self.columns, self.sizes = limit, [], []

    def add(self, layer: int, row) -> None:
        import numpy as np

        while len(self.columns) < layer:
            self.columns.append(np.empty((3, CHUNK), np.int64))
            self.sizes.append(0)
        own, n = self.columns[layer - 1], self.sizes[layer - 1]
        if n == own.shape[1]:
            own = self.columns[layer - 1] = np.concatenate([own, np.empty_like(own)], axis=1)
        own[:, n] = row[1:]
        self.sizes[layer - 1] = n + 1

    def dominates(self, layer: int, row) -> bool:
        """Whether a member of the layer dominates the row; the newest members are asked first."""
        (a, b, c), end, (_, x, y, z) = self.columns[layer - 1], self.sizes[layer - 1], row
        while end > 0:
            seg = slice(max(0, end - CHUNK), end)
            if ((b[seg] <= y) & (c[seg] <= z) & (a[seg] <= x)).any():
                return True
            end -= CHUNK
        return False

    def beyond(self, rows):
        """Which of the rows a member of the last front dominates: these have no layer."""
        import numpy as np

        out = np.zeros(len(rows), bool)
        if len(self.columns) < self.limit:
            return out
        own, end = self.columns[-1], self.sizes[-1]
        while end > 0:
            seg, left = slice(max(0, end - CHUNK), end), np.flatnonzero(~out)
            if not len(left):
                break
            ahead = own[0, seg] <= rows[left, 1, None]
            for j in (1, 2):
                ahead &= own[j, seg] <= rows[left, j + 1, None]
            out[left] = ahead.any(axis=1)
            end -= CHUNK
        return out

    def layer(self, row, low: int) -> int:
        """The row's layer, at least low, by binary search. Being dominated by front k, or low being above k, is
        monotone in k even where a dominator of front k - 1 isn't here but has raised low."""
        least, most = low - 1, len(self.columns)
        while least < most:
            mid = (least + most + 1) // 2
            if self.dominates(mid, row):
                least = mid
            else:
                most = mid - 1
        return least + 1


def place(rows, low, limit: int = LAYERS, fronts: Fronts | None = None, batch: int = 256):
    """Layers of rows (n x 4, distinct, in lexicographic order), limit + 1 for all beyond. low: the least layer that
    each can have. With fronts given, rows are only held against these, which come before all of them."""
    import numpy as np

    own = fronts or Fronts(limit)
    out = np.minimum(low, limit + 1).astype(np.int32)
    for at in range(0, len(rows), batch):
        part = rows[at : at + batch]
        gone = own.beyond(part) | (out[at : at + batch] > limit)
        out[at : at + batch][gone] = limit + 1
        for i in np.flatnonzero(~gone).tolist():
            layer = own.layer(part[i], int(out[at + i]))
            out[at + i] = min(layer, limit + 1)
            if fronts is None and layer <= limit:
                own.add(layer, part[i])
    return out


def _groups(g, costs):
    """(order, starts): rows by group and then lexicographically, and where each group begins."""
    import numpy as np

    codes = np.unique(g, return_inverse=True)[1] if len(g) else np.zeros(0, np.int64)
    order = np.lexsort((*costs.T[::-1], codes))
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(g) else np.zeros(0, np.int64)
    return order, starts.tolist()


def _columns(frame):
    import numpy as np

    return np.stack([frame[c].to_numpy(np.int64) for c in COSTS], axis=1) if len(frame) else np.zeros((0, 4), np.int64)


def _placed(limit: int, keep_all: bool):
    """A task's rows, some BLOCK of them, each group's placed by itself; without keep_all those beyond go."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        parts = [b.to_pandas() for b in batches if b.num_rows]
        if not parts:
            return
        frame = pd.concat(parts, ignore_index=True)
        costs = _columns(frame)
        low = frame["low"].to_numpy(np.int64) if "low" in frame else np.ones(len(frame), np.int64)
        order, starts = _groups(frame["g"].to_numpy(str), costs)
        layer = np.empty(len(frame), np.int32)
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            own = order[a:b]
            layer[own] = place(costs[own], low[own], limit)
        frame = frame[["g", *COSTS]].assign(layer=layer)
        yield pa.RecordBatch.from_pandas(frame if keep_all else frame[layer <= limit], preserve_index=False)

    return run


def _raised(limit: int):
    """Rows of one group's later block against the group's block that is done."""

    def run(rows, done):
        import numpy as np

        if not len(rows) or not len(done):
            return rows
        fronts = Fronts(limit)
        done = done.sort_values(list(COSTS))
        for row, layer in zip(_columns(done), done["layer"].tolist()):
            fronts.add(layer, row)
        rows = rows.sort_values(list(COSTS))
        low = place(_columns(rows), rows["low"].to_numpy(np.int64), limit, fronts)
        rows = rows.assign(low=low)
        return rows[low <= limit]

    return run


def layers(rows: DataFrame, limit: int = LAYERS, block: int = BLOCK) -> DataFrame:
    """rows: (g, k1, k2, k3, k4), distinct, no nulls, smaller is better -> those of the first `limit` layers of their
    group, with their layer.

    A row's layer is one more than the highest among those that dominate it. Portions of about `block` rows, contiguous
    in (group, hash), are placed by themselves: a row beyond the limit among some rows of its group is
    beyond it among all, and the others lose nothing by its going, as a chain of the limit's length stays. So the union of
    what portions keep is dealt anew, until it fits one portion or hardly shrinks. What is left then, if it is more than
    one portion, is ranked by (group, costs) and cut into blocks: a group's blocks are done one after the other, and each
    raises the least layers of the group's later blocks, all at once. A task holds two blocks at most, whatever the input,
    and no group is gathered. Empty in, empty out.
    """
    rows = materialize(rows.select("g", *COSTS))
    n = rows.count()
    while n > block:
        dealt = rows.repartitionByRange(-(-n // block), "g", F.xxhash64(*COSTS))
        rows = materialize(dealt.mapInArrow(_placed(limit, keep_all=False), _PLACED).drop("layer"))
        before, n = n, rows.count()
        if n > 0.7 * before:
            break
    if n <= block:
        return rows.coalesce(1).mapInArrow(_placed(limit, keep_all=False), _PLACED)
    return _in_order(rows, n, limit, block)


def _in_order(rows: DataFrame, n: int, limit: int, block: int) -> DataFrame:
    rank = running(rows.withColumn("one", F.lit(1).cast("long")), ["g", *COSTS], ["one"], n).drop("one")
    own = materialize(rank.select("g", *COSTS, F.floor(F.col("before_one") / block).cast("int").alias("block"), F.lit(1).alias("low")))
    spans = own.groupBy("g").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    spans = few(spans.select(F.col("g").alias("__g"), "first", "last"), 10_000)
    own = own.join(spans, F.col("g") == F.col("__g")).select("g", *COSTS, "low", (F.col("block") - F.col("first")).alias("nth"), (F.col("last") - F.col("first")).alias("last"))
    own, done, nth = materialize(own), None, 0
    while True:
        part = own.filter(F.col("nth") == nth)
        here = materialize(part.groupBy("g").applyInPandas(_whole(limit), f"{_PLACED}, last int"))
        done = here if done is None else done.unionByName(here)
        rest = own.filter(F.col("nth") > nth)
        if rest.isEmpty():
            return done.drop("last").filter(F.col("layer") <= limit)
        kept = here.filter((F.col("layer") <= limit) & (F.col("last") > nth))
        sent = kept.withColumn("nth", F.explode(F.sequence(F.lit(nth + 1), "last"))).drop("last")
        raised = rest.groupBy("g", "nth").cogroup(sent.groupBy("g", "nth")).applyInPandas(_raised(limit), rest.schema)
        own, nth = materialize(raised), nth + 1


def _whole(limit: int):
    def run(frame):
        import numpy as np

        frame = frame.sort_values(list(COSTS))
        layer = place(_columns(frame), frame["low"].to_numpy(np.int64), limit)
        return frame[["g", *COSTS]].assign(layer=layer, last=frame["last"].astype("int32"))

    return run


# -- offers ----------------------------------------------------------------------------------------


def _whole_hundreds(col: Column) -> Column:
    """floor(100 x + 0.5) as long; null where x isn't a number that has one."""
    x = F.floor(F.col(col).cast("double") * 100 + 0.5) if isinstance(col, str) else F.floor(col.cast("double") * 100 + 0.5)
    raw = F.col(col).cast("double") if isinstance(col, str) else col.cast("double")
    return F.when(~F.isnan(raw) & (F.abs(raw) < 1e13), x).cast("long")


def _floor_div(a: str, b: str) -> Column:
    """a / b rounded down, in longs; null where b is 0 or null."""
    return F.expr(f"CASE WHEN {b} > 0 THEN ({a} - pmod({a}, {b})) div {b} WHEN {b} < 0 THEN (-{a} - pmod(-{a}, -{b})) div (-{b}) END")


def offers(lines: DataFrame, items: DataFrame, sales: DataFrame) -> DataFrame:
    """(item_id, vendor_id, part_type, price, discount, delay, quantity): one row for each distinct pair of ids in lines.

    Lines meet their sale's day in an equi-join that Spark can split at a hot sale, sums are partial before they are
    dealt by (item, vendor), and each offer then meets its item. Of a sale's rows the earliest day counts, of an item's the
    smallest (kind, price). Lines without an item or vendor make no offer; a measure skips lines that lack an
    input, numbers that aren't finite included. A divisor of 0 makes a price null.
    """
    c, d = _whole_hundreds("amount"), _whole_hundreds("discount")
    rows = lines.filter(F.col("item_id").isNotNull() & F.col("vendor_id").isNotNull())
    rows = rows.select("sale_id", "item_id", "vendor_id", F.col("quantity").cast("long").alias("q"), c.alias("c"), d.alias("d"), F.to_date("shipped_at").alias("day"))
    days = materialize(sales.filter(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull()).groupBy(F.col("sale_id").alias("__sale")).agg(F.min(F.to_date("sold_at")).alias("sold")))
    rows = rows.join(days, F.col("sale_id") == F.col("__sale"), "left")
    priced = F.col("c").isNotNull() & F.col("d").isNotNull() & F.col("q").isNotNull()
    delay = F.datediff("day", "sold").cast("long")
    sums = rows.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(priced, F.col("c") * (100 - F.col("d")))).alias("paid"), F.sum(F.when(priced, F.col("q"))).alias("units"),
        F.sum("d").alias("d_sum"), F.count("d").alias("d_n"), F.sum(delay).alias("delay_sum"), F.count(delay).alias("delay_n"), F.max("q").alias("quantity"),
    )
    known = items.filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("__item"))
    known = materialize(known.agg(F.min(F.struct("kind", "price")).alias("x")).select("__item", F.col("x.kind").alias("part_type"), _whole_hundreds(F.col("x.price")).alias("p")))
    met = sums.join(known, F.col("item_id") == F.col("__item"), "left").withColumn("worth", F.when(F.col("p") >= 1, F.col("p") * F.col("units")))
    return met.select(
        "item_id", "vendor_id", "part_type", _floor_div("paid", "worth").alias("price"), _floor_div("d_sum", "nullif(d_n, 0)").alias("discount"),
        _floor_div("delay_sum", "nullif(delay_n, 0)").alias("delay"), "quantity",
    )


def _costs() -> list[Column]:
    """The measures as costs: smaller is better, null the worst."""
    sign = {"price": 1, "discount": -1, "delay": 1, "quantity": -1}
    return [F.coalesce(F.col(m) * s, F.lit(WORST)).alias(k) for k, (m, s) in zip(COSTS, sign.items())]


def offer_layers(lines: DataFrame, items: DataFrame, sales: DataFrame, limit: int = LAYERS, block: int = BLOCK) -> DataFrame:
    """offers() with type_layer, global_layer (0 beyond the limit) and n_equal.

    Offers with the same four measures share a row here, so hot combinations are counted, not compared. The global
    layers are of what the types' layers keep: what is beyond the limit in its type is beyond it among all. Null types are
    one type. Ties share their layer; repeated lines count; an empty table gives no rows; other columns are ignored.
    """
    g = F.coalesce(F.concat(F.lit("t"), "part_type"), F.lit(""))  # no null, and no clash with one
    found = materialize(offers(lines, items, sales).select("*", g.alias("g"), *_costs()))
    typed = materialize(layers(found.select("g", *COSTS).distinct(), limit, block))
    every = layers(typed.select(F.lit("").alias("g"), *COSTS).distinct(), limit, block)
    equal = found.groupBy(*COSTS).agg(F.count(F.lit(1)).alias("n_equal"))
    equal = equal.join(every.select(*COSTS, F.col("layer").alias("global_layer")), list(COSTS), "left")
    rows = found.join(equal, list(COSTS)).join(typed.withColumnRenamed("layer", "type_layer"), ["g", *COSTS], "left")
    told = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("type_layer", "global_layer")]
    return rows.select("item_id", "vendor_id", "part_type", "price", "discount", "delay", F.col("quantity").cast("long").alias("quantity"), *told, "n_equal")
