"""Fronts, mixing schedule and lexical search against brute force, on small tables with odd rows."""

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import common, pareto, schedule, wand

# -- layers --------------------------------------------------------------------------------------


def slow_layers(points, limit):
    """Layer of each distinct point by peeling; 0 beyond the limit."""
    left, out = set(points), {}
    for layer in range(1, limit + 1):
        front = {p for p in left if not any(q != p and all(a <= b for a, b in zip(q, p)) for q in left)}
        out |= dict.fromkeys(front, layer)
        left -= front
    return out


def points(seed, n, top=9):
    r = random.Random(seed)
    value = lambda: r.choice([r.randint(0, top), r.randint(0, 3), pareto.WORST]) if r.random() < 0.1 else r.randint(-top, top)
    return {(value(), value(), value(), value()) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_place(seed):
    rows = sorted(points(seed, 700))
    got = pareto.place(np.array(rows), np.ones(len(rows), np.int64), 5, batch=37)
    want = slow_layers(rows, 5)
    assert [g if g <= 5 else 0 for g in got.tolist()] == [want.get(p, 0) for p in rows]


@pytest.mark.parametrize("block", [60, 100_000])
def test_layers(spark, block):
    """In small portions and blocks, and in one; one group holds half of all rows."""
    groups = {"": points(1, 500), "ta": points(2, 120), "tb": {(0, 0, 0, 0)}, "tc": {(i, -i, 0, 0) for i in range(200)}, "td": {(i, i, i, i) for i in range(90)}}
    df = spark.createDataFrame([(g, *p) for g, own in groups.items() for p in own], "g string, k1 long, k2 long, k3 long, k4 long").repartition(3)
    got = {(r.g, (r.k1, r.k2, r.k3, r.k4)): r.layer for r in pareto.layers(df, 4, block).collect()}
    assert got == {(g, p): n for g, own in groups.items() for p, n in slow_layers(own, 4).items()}


LINES = "sale_id long, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz, price double, layer string"


def shop(seed=0, n=900):
    r, day = random.Random(seed), dt.datetime(2024, 1, 5, 23, 59)
    maybe = lambda x, p=0.05: None if r.random() < p else x
    line = lambda: (maybe(r.choice([0, r.randint(0, 60)])), maybe(r.choice([1, r.randint(0, 30)])), maybe(r.randint(0, 6)), maybe(r.randint(1, 9)), maybe(r.choice([float("nan"), 1.005, round(r.uniform(1, 90), 2)])), maybe(r.randint(0, 10) / 100), maybe(day + dt.timedelta(hours=r.randint(-40, 900))), 1.0, "x")
    lines = [line() for _ in range(n)]
    items = [(i, r.choice(["a", "b", None]), r.choice([None, 0.001, round(r.uniform(1, 9), 2)])) for i in range(25)]
    sales = [(i, maybe(day + dt.timedelta(hours=r.randint(-90, 90)), 0.1)) for i in range(55)]
    return lines + lines[:60], items, sales + sales[:5]


def slow_offers(lines, items, sales):
    hundreds = lambda x: None if x is None or x != x else math.floor(100 * x + 0.5)
    kind, price = {i: k for i, k, _ in items}, {i: hundreds(p) for i, _, p in items}
    sold, groups, out = dict(sales), defaultdict(list), {}
    for x in lines:
        if x[1] is not None and x[2] is not None:
            groups[x[1], x[2]].append(x)
    for (item, vendor), own in groups.items():
        full = [(hundreds(x[4]), hundreds(x[5]), x[3]) for x in own if hundreds(x[4]) is not None and x[5] is not None and x[3] is not None]
        p = price.get(item)
        a = sum(c * (100 - d) for c, d, _ in full) // (p * sum(q for *_, q in full)) if full and p else None
        ds = [hundreds(x[5]) for x in own if x[5] is not None]
        late = [(x[6].date() - sold[x[0]].date()).days for x in own if x[6] and sold.get(x[0])]
        qs = [x[3] for x in own if x[3] is not None]
        out[item, vendor] = (kind.get(item), a, sum(ds) // len(ds) if ds else None, sum(late) // len(late) if late else None, max(qs, default=None))
    return out


@pytest.mark.parametrize("block", [40, 100_000])
def test_offers(spark, block):
    lines, items, sales = shop()
    frames = [spark.createDataFrame(*x) for x in ((lines, LINES), (items, "item_id long, kind string, price double"), (sales, "sale_id long, sold_at timestamp_ntz"))]
    got = {(r.item_id, r.vendor_id): (r.part_type, r.price, r.discount, r.delay, r.quantity, r.type_layer, r.global_layer, r.n_equal) for r in pareto.offer_layers(*frames, limit=3, block=block).collect()}
    want = slow_offers(lines, items, sales)
    w = pareto.WORST
    cost = lambda o: tuple(w if v is None else s * v for s, v in zip((1, -1, 1, -1), o[1:]))
    every = slow_layers({cost(o) for o in want.values()}, 3)
    typed = {t: slow_layers({cost(o) for o in want.values() if o[0] == t}, 3) for t in ("a", "b", None)}
    same = Counter(map(cost, want.values()))
    assert got == {k: (*o, typed[o[0]].get(cost(o), 0), every.get(cost(o), 0), same[cost(o)]) for k, o in want.items()}
    assert any(None in o[1:] for o in want.values())


def test_no_offers(spark):
    frames = [spark.createDataFrame([], k) for k in (LINES, "item_id long, kind string, price double", "sale_id long, sold_at timestamp_ntz")]
    assert pareto.offer_layers(*frames).count() == 0


# -- mixing --------------------------------------------------------------------------------------

SOURCES = "doc_id long, text string, source string, size int, name string, target string"


def corpus(seed=0, n=300):
    r = random.Random(seed)
    rows = [(i, None if r.random() < 0.03 else " ".join(["w"] * r.choice([0, 1, 3, r.randint(1, 200)])), r.choice(["b", "b", "b", "a", "é", "z", None, "c"]), 1, "x", "y") for i in range(n)]
    return [*rows, (n, "one two\tthree\x0bfour ", "tiny", 1, "x", "y"), (n + 1, "w " * 30_000, "b", 1, "x", "y"), (None, "x y", "a", 1, "x", "y"), (5, "w w", "a", 1, "x", "y"), (5, "w w", "a", 1, "x", "y"), (n + 2, "  ", "no words", 1, "x", "y")]


def test_slot_ranks():
    for bits, low, high in ((1, 0, 1), (5, 3, 20), (7, 0, 128), (10, 700, 701), (11, 5, 1999)):
        visits = [p for i in range(1 << bits) if low <= (p := int(f"{i:0{bits}b}"[::-1], 2)) < high]
        at = np.array(visits)
        assert schedule.slot_ranks(at, np.full(len(at), low), np.full(len(at), high), bits).tolist() == list(range(len(at)))


def water(sizes, weights, most):
    """Targets by sharing again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in sizes if s not in open_)
        target |= {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over


@pytest.mark.parametrize("few", [0, 10_000])
def test_mix(spark, few, monkeypatch):
    monkeypatch.setattr(schedule, "FEW_SOURCES", few)
    monkeypatch.setattr(schedule, "SEGMENT", 7)
    monkeypatch.setattr(common, "RANGE", 40)
    rows = corpus()
    df = spark.createDataFrame(rows, SOURCES).repartition(5)
    mixed = schedule.mix(df, block=32, least_blocks=16)
    got = schedule.taken_words(mixed).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((x[0], count(x[1])) for x in rows)
    sizes = Counter()
    for x in rows:
        sizes[x[2]] += count(x[1])
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    for x in rows:
        if x[0] in by:
            assert by[x[0]].source_size == sizes[x[2]] and by[x[0]].target == pytest.approx(target[x[2]])
    taken = Counter()
    for r in mixed.stream.join(mixed.sources.select("name", "no"), "no").groupBy("name").agg(F.sum("length").alias("n")).collect():
        taken[r["name"][1:] if r["name"][0] == "0" else None] = r["n"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(1, min(32, sizes[s] // 16)) + 1, s
    assert sum(r.taken for r in got) == sum(taken.values()) and all(r.taken <= 3 * r["size"] for r in got)
    again = schedule.taken_words(schedule.mix(df.repartition(2), block=32, least_blocks=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even(spark):
    """Positions are gapless, pieces of a slot fill its block, and every stretch has nearly the whole's shares."""
    mixed = schedule.mix(spark.createDataFrame(corpus(3), SOURCES), block=32, least_blocks=16)
    slots, parts = {}, defaultdict(int)
    for r in mixed.stream.collect():
        slots[r.position] = (r.no, r["pass"], r.block)
        parts[r.position] += r.length
    sources = {r.no: r for r in mixed.sources.collect()}
    assert sorted(slots) == list(range(len(slots))) == list(range(sum(r.slots for r in sources.values())))
    assert all(parts[p] - sources[no].width in (0, 1) for p, (no, _, _) in slots.items())
    for no, r in sources.items():
        own = [p for p in sorted(slots) if slots[p][0] == no]
        assert [slots[p][1:] for p in own] == [(i // r.blocks, i % r.blocks) for i in range(r.slots)]
        assert all(abs(i - p * r.slots / len(slots)) < 4 for i, p in enumerate(own))


def test_mix_of_nothing(spark):
    assert schedule.taken_words(schedule.mix(spark.createDataFrame([], SOURCES))).count() == 0
    bare = spark.createDataFrame([(1, None, None, 1, "", ""), (2, " ", "a", 1, "", "")], SOURCES)
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in schedule.taken_words(schedule.mix(bare)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# -- search --------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, top):
    count = {i: Counter(terms(t)) for i, t in enumerate(t for _, t in docs)}
    n, total = sum(bool(c) for c in count.values()), sum(c.total() for c in count.values())
    df = Counter(t for c in count.values() for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked}
        hits = []
        for i, c in count.items():
            m = 100 - 50 + (50 * c.total() * n) // total if total else 0
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked & c.keys())
            if score > 0:
                hits.append((-score, docs[i][0] is None, docs[i][0] or 0))
        out[item] = [(None if null else d, -s) for s, null, d in sorted(hits)[:top]]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("shard, step", [(40, 8), (300, 16), (1_000_000, 1024)])
def test_search(spark, shard, step, monkeypatch):
    monkeypatch.setattr(wand, "STEP", step)
    monkeypatch.setattr(wand, "MERGE", 2)
    r = random.Random(5)
    vocab = ["a", "B", "été", "İX", "x1", "中", "the", "of", "rare", "z9"]
    text = lambda k: "".join(r.choice(vocab[: r.randint(2, 10)]) + r.choice(" ,-\n_{") for _ in range(k))
    docs = [(i // 2 if i % 7 == 0 else i, text(r.choice([0, 1, 3, 30]))) for i in range(400)] + [(None, "a the of"), (900, None), (901, "..."), (902, text(20_000)), (3, "a the"), (3, "a the")]
    items = [(1, "a THE of Of"), (2, "été x1 zz"), (3, None), (4, "..."), (5, "nowhere"), (6, "rare Z9 中 İX b"), (6, "the"), (7, "İx")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(4)
    got = defaultdict(list)
    for x in sorted(wand.search(df, spark.createDataFrame(items, "item_id long, text string"), 20, shard_size=shard).collect(), key=lambda x: (x.item_id, x["rank"])):
        got[x.item_id].append((x.doc_id, x.score))
        assert x["rank"] == len(got[x.item_id])
    assert dict(got) == slow_search(docs, items, 20)


def test_search_blocks_and_empties(spark, monkeypatch):
    monkeypatch.setattr(wand, "QUERY_BYTES", 1)
    docs, items = [(1, "a b"), (2, "b c")], [(1, "a"), (2, "c b"), (2, "a")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = sorted((x.item_id, x["rank"], x.doc_id, x.score) for x in wand.search(d, q).collect())
    assert got == sorted((i, n + 1, *h) for i, hits in slow_search(docs, items, 50).items() for n, h in enumerate(hits))
    assert wand.search(d.limit(0), q).count() == 0 and wand.search(d, q.limit(0)).count() == 0


def test_search_skips(spark):
    """Documents below the threshold aren't scored: a pivot past the common terms leaves only what has a rare one."""
    shard = wand.Shard(np.array([1000, 10]), 100, 200, 2)
    for i in range(3000):
        shard.add(i, 2, np.array([0, 1] if i % 1000 == 0 else [1]), np.array([1, 1] if i % 1000 == 0 else [1]))
    shard.close()
    heap = shard.search(np.array([0, 1]), [])
    assert [d for _, d in heap] == [0, 1000]
    shard.impact[shard.first[1] :] = 10**15  # the common term's impacts aren't read where no document has the rare one
    shard.impact[shard.first[1] :][[0, 1000, 2000]] = 1
    assert shard.search(np.array([0, 1]), heap) == heap
