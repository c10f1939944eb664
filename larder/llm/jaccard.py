"""Exact n-gram Jaccard self-join, answered by set relations.

1. Each text becomes its set of distinct word n-grams (64-bit hashes). Rows with one and the same
   set (64-bit hash) are one class; only the class's smallest row goes on.
2. A set needs a certain number of its n-grams in a partner. Portions of texts send their distinct
   n-grams to buckets of hashes, once a portion, and are told which ones occur elsewhere: a set with
   too few of these has no partner and is done. Unrelated texts end here.
3. The classes that remain ask once more, for how many of them hold each n-gram. Two similar sets
   share one of their few rarest n-grams, which passages that many texts repeat never are; sets of a
   family of sizes that share such a one are candidates. A portion links its own sets first and tells
   one of each group and n-gram, so no list grows with the rows that share an n-gram.
4. Each candidate component is joined in one task; of one that is too large, first all that is like one
   of its members is linked with that, and the others meet in pairs of blocks. In a task index lists
   are ordered by position and read only as far as a partner may be; a set reached from another by a
   link derives its overlaps from that one's answers, by the n-grams in which the two differ.
5. Components of the links found give the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, few, materialize, row_key, without_rows, worker_cache
from .components import components

#: n-grams that one task joins at once; n-grams of a portion of texts; n-grams of a bucket, as many as are expected.
GROUP, PORTION, BUCKET = 500_000, 1_000_000, 1_000_000
#: Members of a large component that may become its pivot, about.
PIVOTS = 8
#: Texts that are in memory at once as text; texts of a portion at most.
ROWS, TEXTS = 500, 50_000


def grams(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the word k-grams; fewer than k words are one gram; no words, none."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, raw), np.uint64, n)
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ w[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def size_bounds(most: int, num: int, den: int) -> list[int]:
    """Lower bounds of the size intervals: partners of a set are in its own interval or a neighbouring one."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * den // num + 1)
    return bounds


def families(n: int, num: int, den: int) -> list[int]:
    """The families of a set of n elements: pairs of its interval with the one below, and above."""
    import bisect

    interval = bisect.bisect_right(size_bounds(n + 1, num, den), n) - 1
    return [f for f in (interval - 1, interval) if f >= 0]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def node_of(own: int, family: int) -> int:
    """A class in a family, as a signed 64-bit number."""
    h = (own * 0x9E3779B97F4A7C15 + (family + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return signed(h ^ (h >> 29))


def class_of(s) -> int:
    from xxhash import xxh3_64_intdigest

    return signed(xxh3_64_intdigest(s.tobytes()))


def least_shared(n, num: int, den: int):
    """Elements that a set of n shares with any partner, at least: the threshold's share of its own."""
    return -(-num * n // den)


# -- the join inside a group ---------------------------------------------------------------------


def join_group(sets: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j), enough to connect all that are connected, among sorted distinct arrays.

    Sets are reached from each other along links, so each is asked about once, against those not
    reached yet. A set asks the lists of its rarest elements. Entries of a list are in the order of
    the element's position in their sets: x with it in place i and y with it in place j as the first
    common element have at most |x| - i in common and at least |x| + j together, so a list is read
    up to the largest j that can do. A set that was reached from another takes over that one's
    overlaps, corrected by the lists of the elements in which the two differ.
    """
    import numpy as np

    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not size.any():
        return []
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if den * both >= num * (int(size.sum()) - both) and both else []
    _, own, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))  # rarest first
    own, member = rank[own], np.repeat(np.arange(n), size)
    own = own[np.lexsort((own, member))]
    starts = np.cumsum(size) - size
    place = np.arange(len(own)) - np.repeat(starts, size)
    width = int(size.max()) + 1
    order = np.argsort(own * width + place, kind="stable")
    lists = {"key": (own * width + place)[order], "set": member[order], "place": place[order]}
    waiting, slot, mark = np.ones(n, bool), np.full(n, -1), np.zeros(len(times), bool)
    of = lambda x: own[starts[x] : starts[x] + size[x]]

    def read(low, high):
        """Places of the lists' entries with low <= key < high, and the number of the range of each."""
        lo = np.searchsorted(lists["key"], low)
        k = np.maximum(np.searchsorted(lists["key"], high), lo) - lo
        return np.arange(int(k.sum())) + np.repeat(lo - np.cumsum(k) + k, k), np.repeat(np.arange(len(k)), k)

    def partners(x):
        """Sets not reached yet that may be partners."""
        i = np.arange(size[x] - least_shared(int(size[x]), num, den) + 1)
        most = (size[x] - i) * den // num - size[x]  # the largest place worth reading
        at, i = read(of(x)[i] * width, of(x)[i] * width + most + 1)
        y, j = lists["set"][at], lists["place"][at]
        return np.unique(y[waiting[y] & ((size[y] - j) * den >= num * (size[y] + i))])

    def overlaps(x, ys):
        mark[of(x)] = True
        k = size[ys]
        ends = np.cumsum(k)
        held = mark[own[np.arange(int(ends[-1])) + np.repeat(starts[ys] - ends + k, k)]]
        mark[of(x)] = False
        return np.add.reduceat(held.astype(np.int64), ends - k)

    def derived(x, z, ys, counts):
        """Overlaps of x from those of z."""
        total, slot[ys] = counts.copy(), np.arange(len(ys))
        for tokens, sign in ((np.setdiff1d(of(z), of(x), assume_unique=True), -1), (np.setdiff1d(of(x), of(z), assume_unique=True), 1)):
            to = slot[lists["set"][read(tokens * width, (tokens + 1) * width)[0]]]
            total += sign * np.bincount(to[to >= 0], minlength=len(ys))
        slot[ys] = -1
        return total

    links, gone = [], 0
    for seed in np.argsort(size, kind="stable").tolist():
        if not waiting[seed] or not size[seed]:
            continue
        waiting[seed] = False
        gone += 1
        stack = [(seed, None)]
        while stack:
            x, known = stack.pop()
            if 2 * gone > n:  # lists of those that wait
                keep = waiting[lists["set"]]
                lists = {k: v[keep] for k, v in lists.items()}
                n, gone = int(waiting.sum()), 0
            ys = partners(x)
            if not len(ys):
                continue
            counts, new = np.zeros(len(ys), np.int64), np.ones(len(ys), bool)
            if known and len(known[1]):
                at = np.minimum(np.searchsorted(known[1], ys), len(known[1]) - 1)
                new = known[1][at] != ys
                if not new.all():
                    counts[~new] = derived(x, known[0], ys[~new], known[2][at[~new]])
            if new.any():
                counts[new] = overlaps(x, ys[new])
            linked = den * counts >= num * (size[ys] + size[x] - counts)
            waiting[ys[linked]] = False
            gone += int(linked.sum())
            answers = (x, ys[~linked], counts[~linked])
            for y in ys[linked].tolist():
                links.append((x, y))
                stack.append((y, answers))
    return links


# -- portions and buckets ------------------------------------------------------------------------


def pack(*arrays) -> bytes:
    """Arrays as one value, byte by byte of their numbers, compressed where that helps."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    head = np.array([len(raw), *map(len, arrays)], "<i8").tobytes()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes, *kinds):
    import numpy as np
    import pyarrow as pa

    length, *lens = np.frombuffer(blob, "<i8", len(kinds) + 1).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 * len(kinds) + 8 :], decompressed_size=length, codec="zstd", asbytes=True) if length else b"", np.uint8)
    out, at = [], 0
    for kind, n in zip(kinds, lens):
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _pieces(batches):
    """The batches in pieces of few rows: what a task holds as Python text doesn't depend on Spark's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _portions(batches, k: int):
    """(portion, ids, keys, number of each row's set, distinct sets, their classes) of the rows (id, key, text)."""
    from pyspark import TaskContext

    worker_cache()
    portion = TaskContext.get().partitionId() << 32
    ids, keys, which, sets, known, held = [], [], [], [], {}, 0
    for batch in _pieces(batches):
        for i, key, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            s = grams(text, k)
            own = class_of(s)
            if own not in known:
                known[own] = len(sets)
                sets.append(s)
                held += len(s)
            ids.append(i), keys.append(key), which.append(known[own])
            if held >= PORTION or len(ids) >= TEXTS:
                yield portion, ids, keys, which, sets, list(known)
                portion += 1
                ids, keys, which, sets, known, held = [], [], [], [], {}, 0
    if ids:
        yield portion, ids, keys, which, sets, list(known)


def _rows(rows):
    """Rows (bucket, portion, kind, data)."""
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "portion", "kind", "data"])


SENT = "bucket long, portion long, kind long, data binary"


def _dealt(hashes, bits: int):
    """(bucket, first, last, the hashes' next 32 bits) of each bucket that sorted hashes fall in."""
    import numpy as np

    edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    rest = ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, int(edges[bucket]), int(edges[bucket + 1]), rest[edges[bucket] : edges[bucket + 1]]


def _ask(k: int, bits: int):
    """Of each portion: its rows, and its distinct n-grams dealt to buckets, each with the number of
    the set that has it, or 0 where several sets of the portion do."""

    def run(batches):
        import numpy as np

        for portion, ids, keys, which, sets, classes in _portions(batches, k):
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            order = np.argsort(every)
            owner = np.repeat(np.arange(len(sets)), size)[order]
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(every)))
            shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
            out = [(-1 - portion, portion, 0, pack(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(keys, "<i8"), np.array(which, "<i4"), size.astype("<i8"), np.array(classes, "<i8"), shared.astype("<i8")))]
            one = np.where(times == 1, owner[first] + 1, 0).astype("<u4")
            for bucket, lo, hi, rest in _dealt(every[first], bits):
                by = np.argsort(one[lo:hi].astype(np.uint16), kind="stable")  # TEXTS fit 16 bits
                out.append((bucket, portion, 1, pack(rest[by], one[lo:hi][by])))
            yield _rows(out)

    return run


def _by_bucket(batches):
    """(bucket, [(portion, kind, data)]) of sorted rows; the rows of a portion itself come one by one."""
    key, held = None, []
    for batch in batches:
        for bucket, portion, kind, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if bucket != key and held:
                yield key, held
                held = []
            key = bucket
            held.append((portion, kind, data))
    if held:
        yield key, held


def _elsewhere(batches):
    """Of each portion that asks: how many n-grams of each of its sets another portion has too."""
    import numpy as np

    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            yield _rows([(bucket, *r) for r in rows])
            continue
        asked = [unpack(data, "<u4", "<u4") for _, _, data in rows]
        every = np.concatenate([a for a, _ in asked])
        order = np.argsort(every)
        same = every[order][1:] == every[order][:-1]
        found = np.zeros(len(every), bool)
        found[order[1:][same]] = found[order[:-1][same]] = True
        at, out = 0, []
        for (portion, _, _), (a, one) in zip(rows, asked):
            sets, times = np.unique(one[found[at : at + len(a)] & (one > 0)], return_counts=True)
            at += len(a)
            if len(sets):
                out.append((bucket, portion, 1, pack((sets - 1).astype("<u4"), times.astype("<u4"))))
        if out:
            yield _rows(out)


def _by_portion(batches):
    """Lists of (kind, data) of each portion, in order of kind."""
    key, held = None, []
    for batch in batches:
        for portion, kind, data in zip(*(batch.column(c).to_pylist() for c in range(1, 4))):
            if portion != key and held:
                yield held
                held = []
            key = portion
            held.append((kind, data))
    if held:
        yield held


def _marks(batches):
    """(id, key, n, class, shared): shared is the number of the set's n-grams that other sets may have."""
    import numpy as np
    import pyarrow as pa

    for rows in _by_portion(batches):
        ids, nulls, keys, which, size, classes, shared = unpack(rows[0][1], "<i8", "u1", "<i8", "<i4", "<i8", "<i8", "<i8")
        shared = shared.copy()
        for _, data in rows[1:]:
            sets, times = unpack(data, "<u4", "<u4")
            shared[sets] += times
        cols = [pa.array(ids, mask=nulls.astype(bool)), *(pa.array(c) for c in (keys, size[which], classes[which], shared[which]))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n", "class", "shared"])


def _count(k: int, bits: int):
    """Of each portion: its sets, and its distinct n-grams with the number of its sets that have them, dealt to buckets."""

    def run(batches):
        import numpy as np

        for portion, _, _, _, sets, classes in _portions(batches, k):
            size, every = np.array([len(s) for s in sets], "<i8"), np.concatenate(sets)
            grams, times = np.unique(every, return_counts=True)
            out = [(-1 - portion, portion, -1, pack(size, np.array(classes, "<i8"), every.astype("<u8")))]
            out += [(bucket, portion, bucket, pack(rest, times[lo:hi].astype("<u4"))) for bucket, lo, hi, rest in _dealt(grams, bits)]
            yield _rows(out)

    return run


def _held(batches):
    """Of each portion that asks: how many sets have each of its n-grams, in the order in which it asked."""
    import numpy as np

    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            yield _rows([(bucket, *r) for r in rows])
            continue
        asked = [unpack(data, "<u4", "<u4") for _, _, data in rows]
        _, where = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
        total = np.bincount(where, np.concatenate([t for _, t in asked])).astype("<u4")[where]
        ends = np.cumsum([len(a) for a, _ in asked])
        yield _rows([(bucket, portion, kind, pack(total[end - len(a) : end])) for (portion, kind, _), (a, _), end in zip(rows, asked, ends)])


def _candidates(num: int, den: int):
    """Rows (kind, a, b): 0, node a and the first of its group in the portion; 1, an n-gram and a family, and the
    first of those that have it; 2, a node and its class."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in _by_portion(batches):
            size, classes, every = unpack(rows[0][1], "<i8", "<i8", "<u8")
            df = np.concatenate([np.zeros(0, "<u4"), *(unpack(data, "<u4")[0] for _, data in rows[1:])]).astype(np.int64)
            _, where, times = np.unique(every, return_inverse=True, return_counts=True)
            df, here = df[where], times[where]
            nodes, keys, only, told = [], [], [], []
            for i, (n, end) in enumerate(zip(size.tolist(), np.cumsum(size).tolist())):
                own, least = df[end - n : end], least_shared(n, num, den)
                if not n or int((own > 1).sum()) < least:
                    continue
                rare = np.argsort(own, kind="stable")[: n - least + 1]  # hashes are in order already
                rare = rare[own[rare] > 1]
                alone, rare = own[rare] == here[end - n : end][rare], every[end - n : end][rare]
                for f in families(n, num, den):
                    h = (rare ^ np.uint64((f + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                    keys.append(h ^ (h >> np.uint64(29))), only.append(alone)
                    nodes.append(np.full(len(rare), node := node_of(int(classes[i]), f)))
                    told.append((2, node, int(classes[i])))
            if not nodes:
                continue
            nodes, keys, only = (np.concatenate(x) for x in (nodes, keys, only))
            order = np.argsort(keys)
            nodes, keys, only = nodes[order], keys[order], only[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent.setdefault(up, up)
                return x

            lead = np.repeat(nodes[first], np.diff(np.append(first, len(keys))))
            for x, y in np.unique(np.stack([nodes, lead], 1), axis=0).tolist():
                if (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
            told += [(0, x, root(x)) for x in list(parent)]
            open_ = first[~only[first]]  # no other portion has the others
            told += [(1, key, root(x)) for key, x in zip(keys[open_].view(np.int64).tolist(), nodes[open_].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], names=["kind", "a", "b"])

    return run


def _links(k: int, num: int, den: int):
    """Links between the classes of each group; rows (group, class, text) come in order."""

    def run(batches):
        import pyarrow as pa

        worker_cache()
        key, ids, sets = None, [], []

        def table():
            found = join_group(sets, num, den)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in _pieces(batches):
            for group, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if group != key:
                    if len(ids) > 1:
                        yield table()
                    key, ids, sets = group, [], []
                if not ids or ids[-1] != own:  # a row that is there twice
                    ids.append(own), sets.append(grams(text, k))
        if len(ids) > 1:
            yield table()

    return run


# -- the join ------------------------------------------------------------------------------------


def _first(prefix: str = ""):
    """What the smallest row of a group is told by: its id, null ids last, and the key of its text."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "key")


def _groups(rows: DataFrame, k: int, num: int, den: int):
    """rows: (id, key, text). (marks: a row each, with its class; classes: the first row of each, and of its component)."""
    spark = rows.sparkSession
    least = spark.sparkContext.defaultParallelism
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def sizes(n_grams: int) -> tuple[int, int]:
        bits = max(4, (n_grams // BUCKET).bit_length())
        return bits, max(least, (1 << bits) // 2)

    bits, parts = sizes(n_bytes // 6)  # more or less as many words
    asked = rows.mapInArrow(_ask(k, bits), SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_elsewhere, SENT).repartition(parts, "portion").sortWithinPartitions("portion", "kind")
    marks = materialize(told.mapInArrow(_marks, "id long, key long, n long, class long, shared long"))
    classes = materialize(marks.filter("n > 0").groupBy("class").agg(F.min(_first()).alias("row"), F.max("n").alias("n"), F.max("shared").alias("shared")))
    left = classes.filter(F.col("shared") * den >= F.col("n") * num)
    n_grams = left.agg(F.sum("n")).first()[0] or 0
    bits, parts = sizes(n_grams)
    # in order, so that a portion is the same if a task runs again
    few_rows = _rows_of(rows, left.select("row")).select("id", "key", "text").sortWithinPartitions("id", "key")
    asked = few_rows.mapInArrow(_count(k, bits), SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_held, SENT).repartition(parts, "portion").sortWithinPartitions("portion", "kind")
    found = materialize(told.mapInArrow(_candidates(num, den), "kind long, a long, b long"))
    lists = found.filter("kind = 1").select("a", "b")
    leads = lists.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("lead"), F.max("b").alias("last")).filter("lead <> last")
    edges = lists.join(leads, F.col("a") == F.col("key")).select("b", "lead").unionByName(found.filter("kind = 0").select(F.col("a").alias("b"), F.col("b").alias("lead")))
    near = components(edges, "b", "lead")
    nodes = found.filter("kind = 2").select("a", F.col("b").alias("own")).distinct()
    # the candidate components' groups: (component, family, block, block)
    # a class is a node in each family of its size, so chains don't run on from one size to the next
    known = nodes.join(near, F.col("a") == F.col("node")).select("own", F.col("component").alias("c"))
    known = materialize(known.join(classes, F.col("own") == F.col("class")).select("class", "row", "n", "c"))
    total = known.groupBy("c").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("c").alias("__c"), "t")
    sized = known.join(total, F.col("c") == F.col("__c"))
    one = sized.filter(F.col("t") <= GROUP).select("class", "row", F.struct("c", F.lit(-1).alias("f"), F.lit(0).alias("x"), F.lit(0).alias("y")).alias("g"))
    groups, sure = one, None
    large = materialize(sized.filter(F.col("t") > GROUP).select("class", "row", "n", "c"))
    if not large.isEmpty():
        sure, others = _split(rows, large, k, num, den)
        groups = groups.unionByName(others)
    groups = materialize(groups)
    n_grams = known.agg(F.sum("n")).first()[0] or 0
    dealt = _rows_of(rows, groups).select(F.to_json("g").alias("g"), "class", "text").repartition(max(least, -(-n_grams // GROUP)), "g").sortWithinPartitions("g", "class")
    links = dealt.mapInArrow(_links(k, num, den), "a long, b long")
    linked = components(links if sure is None else links.unionByName(sure), "a", "b")
    of = materialize(linked.join(classes, F.col("node") == F.col("class")).select("class", "row", "component"))
    first = of.groupBy("component").agg(F.min("row").alias("first")).select(F.col("component").alias("__c"), "first")
    return marks, classes, of.join(first, F.col("component") == F.col("__c")).select("class", "row", "first")


def _rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that wanted.row names, with wanted's columns; texts stay in place where few are wanted."""
    wanted = few(wanted.select(F.col("row.id").alias("__id"), F.col("row.key").alias("__key"), *(c for c in wanted.columns if c != "row")))
    return rows.join(wanted, rows["id"].eqNullSafe(wanted["__id"]) & (rows["key"] == wanted["__key"]))


def similar_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links of
    den * intersection >= num * union).

    Null, empty and white-space texts have the empty set and are linked with nothing; a very long text's
    set is whole. Rows are told
    apart by id and text, so rows that share an id are each linked by their own text. A null id
    counts as the largest: its row has the smallest id of its group, null if there is none. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    marks, classes, linked = _groups(rows, k, num, den)
    whole = classes.select("class", F.col("row.id").alias("own"))
    first = linked.select(F.col("class").alias("__l"), F.col("first.id").alias("first"))
    of = whole.join(first, F.col("class") == F.col("__l"), "left").select(F.col("class").alias("__class"), F.coalesce("first", "own").alias("component_id"))
    marks = marks.select("id", "n", F.when(F.col("n") > 0, F.col("class")).alias("__own"))
    out = marks.join(of, F.col("__own") == F.col("__class"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _with_pivots(k: int):
    """Rows (class, c, n, text, pivots) -> (class, c, n, pivot, common elements, elements of the pivot)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict = {}
        for batch in _pieces(batches):
            out = []
            for own, c, n, text, pivots in zip(*(x.to_pylist() for x in batch.columns)):
                s = grams(text, k)
                for p in pivots:
                    if (c, p["pivot"]) not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[c, p["pivot"]] = grams(p["text"], k)
                    z = known[c, p["pivot"]]
                    out.append((own, c, n, p["pivot"], len(np.intersect1d(s, z, assume_unique=True)), len(z)))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["class", "c", "n", "pivot", "m", "z"])

    return run


def _split(rows: DataFrame, large: DataFrame, k: int, num: int, den: int):
    """Links and groups (class, row, g) that stand for the components that one task can't hold.

    Of some members of each component, told by hash, the one with most links is its pivot. What is
    linked to it is one class of links and needs no comparing inside, so a large group of copies of
    one text costs a pass over its rows. Distances 1 - J obey the triangle's inequality: of the
    others only those within twice the threshold's distance of the pivot can be linked with its
    partners. They meet these, and all others meet each other, in pairs of hashed blocks.
    """
    size = large.groupBy("c").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PIVOTS)).cast("long").alias("every")).withColumnRenamed("c", "__c")
    chosen = large.join(size, F.col("c") == F.col("__c")).filter(F.pmod(F.xxhash64("class", F.lit(7)), F.col("every")) == 0)
    texts = _rows_of(rows, chosen.select("class", "row", "c")).groupBy("c", F.col("class").alias("pivot")).agg(F.min("text").alias("text"))
    pivots = materialize(texts.groupBy(F.col("c").alias("__c")).agg(F.collect_list(F.struct("pivot", "text")).alias("pivots")))  # about PIVOTS each
    n_bytes = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda x, p: x + F.octet_length(p["text"])))).first()[0] or 0
    asked = _rows_of(rows, large).join(broadcast_if_small(pivots, n_bytes), F.col("c") == F.col("__c")).select("class", "c", "n", "text", "pivots")
    seen = materialize(asked.mapInArrow(_with_pivots(k), "class long, c long, n long, pivot long, m long, z long").distinct())
    union = F.col("n") + F.col("z") - F.col("m")
    linked = F.col("m") * den >= num * union
    best = seen.filter(linked).groupBy(F.col("c").alias("__c"), "pivot").agg(F.count(F.lit(1)).alias("k")).groupBy("__c").agg(F.max(F.struct("k", "pivot")).alias("p")).select("__c", F.col("p.pivot").alias("__p"))
    told = materialize(seen.join(best, (F.col("c") == F.col("__c")) & (F.col("pivot") == F.col("__p"))).select("class", "c", "pivot", linked.alias("linked"), (F.col("m") * den >= (2 * num - den) * union).alias("near")))
    sure = told.filter("linked").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    own = large.join(told.select(F.col("class").alias("__o"), F.col("c").alias("__d"), "linked", "near"), (F.col("class") == F.col("__o")) & (F.col("c") == F.col("__d")), "left")
    own = materialize(own.select("class", "row", "n", "c", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("near", F.lit(False)).alias("near")))
    rest = _blocks(own.filter("not linked").select("class", "row", "n", "c"), num, den)
    close = own.filter("near and not linked")
    some = close.groupBy(F.col("c").alias("__c")).agg(F.ceil(F.sum("n") * 2 / GROUP).cast("int").alias("x"))
    many = own.filter("linked").groupBy(F.col("c").alias("__d")).agg(F.ceil(F.sum("n") * 2 / GROUP).cast("int").alias("y"))
    count = materialize(some.join(many, F.col("__c") == F.col("__d")).select("__c", "x", "y"))
    each = own.filter("near").join(count, F.col("c") == F.col("__c"))  # what is linked is near
    mine = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = each.filter("not linked").select("class", "row", "c", mine("x").alias("i"), every("y").alias("j"))
    right = each.filter("linked").select("class", "row", "c", mine("y").alias("j"), every("x").alias("i"))
    across = left.unionByName(right).select("class", "row", F.struct("c", F.lit(-2).alias("f"), F.col("i").alias("x"), F.col("j").alias("y")).alias("g"))
    return sure, rest.unionByName(across)


def _blocks(sized: DataFrame, num: int, den: int) -> DataFrame:
    """Groups of the components that one task can't hold: by families of size, then pairs of hashed
    blocks, so that any two sets that may be partners meet in one group."""
    bounds = F.array(*(F.lit(b) for b in size_bounds(1 << 40, num, den)))
    interval = F.size(F.filter(bounds, lambda b: b <= F.col("n"))) - 1
    sized = sized.withColumn("f", F.explode(F.array(interval, interval - 1))).filter("f >= 0")
    total = sized.groupBy("c", "f").agg(F.ceil(F.sum("n") * 2 / GROUP).cast("int").alias("b")).select(F.col("c").alias("__c"), F.col("f").alias("__f"), F.when(F.col("b") <= 2, 1).otherwise(F.col("b")).alias("b"))
    rows = sized.join(total, (F.col("c") == F.col("__c")) & (F.col("f") == F.col("__f")))
    own = F.pmod(F.xxhash64("class"), F.col("b")).cast("int")
    rows = rows.select("class", "row", "c", "f", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    return rows.select("class", "row", F.struct("c", F.col("f").cast("int").alias("f"), F.least("own", "other").cast("int").alias("x"), F.greatest("own", "other").cast("int").alias("y")).alias("g"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with docs' columns: the one with the smallest id (a null
    id counts as the largest; of several texts with that id, one). Rows with equal id and text are one
    row. Null, empty and white-space texts are similar to nothing: all stay but such repeats. Very long texts
    are read whole. An
    empty table gives no rows; other columns, whatever their names, are kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    marks, classes, linked = _groups(rows, k, num, den)
    own = classes.select(F.col("class").alias("__o"), F.col("row").alias("own"))
    first = linked.select(F.col("class").alias("__l"), "first")
    whole = marks.filter("n > 0").join(own, F.col("class") == F.col("__o")).join(first, F.col("class") == F.col("__l"), "left")
    kept = F.coalesce("first", "own")
    lost = whole.filter(~(F.col("id").eqNullSafe(kept["id"]) & (F.col("key") == kept["key"]))).select("id", "key")
    return without_rows(docs, lost, marks.select("id", "key"), id_col, text_col)
