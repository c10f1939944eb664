"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Bytes of a q-gram; share of an item's bytes that may be edits; least bytes of an item that may have any.
Q, RATE, LEAST = 8, 0.07, 24
#: Bytes of benchmark text in one index, and of document text that is looked at together.
INDEX_BYTES, PART_BYTES = 4 << 20, 1 << 20
HIT = "item_id long, start long, length long, edits long"


def normalise(text: str | None) -> bytes:
    """Lower case, runs of white space as one space, UTF-8."""
    return " ".join((text or "").lower().replace("\0", " ").split()).encode()


def budget(length: int) -> int:
    """Edits allowed for an item: RATE of its bytes from LEAST on, where the lemma's bound is positive; none below."""
    return int(RATE * length) if length >= LEAST else 0


def grams(buf: bytes, n: int):
    """Mixed 64-bit hash of the Q = 8 bytes from each of n places of buf, which is padded by 16 bytes."""
    import numpy as np

    low = np.ndarray((n,), "<u8", buf, 0, (1,))
    return (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def band_edits(item: bytes, text: bytes, first: int, last: int, most: int) -> tuple[int, int]:
    """(fewest edits, end) of item against a stretch of text that begins on a diagonal in [first, last]
    and strays from there by at most `most`; one row of the band for each byte of the item."""
    import numpy as np

    diagonals = np.arange(first - most, last + most + 1)
    t = np.frombuffer(text, np.uint8)
    row = np.where((diagonals >= 0) & (diagonals <= len(t)), 0, 1 << 20)
    steps = np.arange(len(row))
    for i, byte in enumerate(item):
        at = i + diagonals
        ok = (at >= 0) & (at < len(t))
        differs = np.where(ok, t[np.clip(at, 0, max(0, len(t) - 1))] != byte, 1 << 20) if len(t) else np.full(len(row), 1 << 20)
        down = np.append(row[1:], 1 << 20) + 1
        row = np.minimum(row + differs, down)
        row = np.minimum.accumulate(row - steps) + steps
        row = np.where(at + 1 <= len(t), row, 1 << 20)
    best = int(row.argmin())
    return int(row[best]), len(item) + int(diagonals[best])


class Index:
    """Postings (item, offset) of the items' q-grams, in the order of their hashes, and a table that says which hashes may be there."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        import numpy as np

        every = [(i, b) for i, b in ((i, normalise(t)) for i, t in items) if b]
        self.items = [x for x in every if len(x[1]) >= LEAST]
        self.short: dict[str, list[int]] = {}  # bytes as characters
        for i, b in every:
            if len(b) < LEAST:
                self.short.setdefault(b.decode("latin-1"), []).append(i)
        h, item, offset = [], [], []
        for number, (_, b) in enumerate(self.items):
            n = len(b) - Q + 1
            h.append(grams(b + bytes(16), n))
            item.append(np.full(n, number))
            offset.append(np.arange(n))
        h, item, offset = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((h, np.uint64), (item, np.int64), (offset, np.int64)))
        order = np.argsort(h, kind="stable")
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item, self.offset = item[order].astype(np.int64), offset[order].astype(np.int64)
        bucket = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[bucket] = np.arange(len(bucket))  # the last key of a bucket; keys are in order
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[bucket[1:][bucket[1:] == bucket[:-1]]] = True
        self.length = np.array([len(b) for _, b in self.items], np.int64)
        self.most = np.array([budget(len(b)) for _, b in self.items], np.int64)
        self.least = self.length - Q + 1 - Q * self.most
        self.band = int(self.most.max(initial=0)) + 1

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, length, edits) of each item in each text, best place of it."""
        import numpy as np

        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        small = self._short(texts)
        if not self.items:
            return sorted(small)
        overlap = int(self.length.max()) + 2 * self.band + Q
        part, held, own = [], 0, []
        for number, text in enumerate(texts):
            for at in range(0, max(1, len(text) - overlap), PART_BYTES):  # a long text in overlapping parts
                piece = text[at : at + PART_BYTES + overlap]
                part.append(piece), own.append((number, at))
                held += len(piece)
                if held >= PART_BYTES:
                    self._look(part, own, found)
                    part, held, own = [], 0, []
        if part:
            self._look(part, own, found)
        return sorted([*small, *((t, self.items[i][0], *found[t, i]) for t, i in found)])

    def _short(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """Items too short for the lemma: their first verbatim place between characters that aren't letters or digits."""
        if not self.short:
            return []
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for b in self.short:
            automaton.add_word(b, b)
        automaton.make_automaton()
        out = []
        inside = lambda c: c.isascii() and c.isalnum() or c >= "\x80"
        for number, text in enumerate(texts):
            text, first = text.decode("latin-1"), {}
            for end, b in automaton.iter(text):
                start = end + 1 - len(b)
                if (not start or not inside(text[start - 1]) or not inside(b[0])) and (end + 1 == len(text) or not inside(text[end + 1]) or not inside(b[-1])):
                    first.setdefault(b, start)
            out += [(number, i, start, len(b), 0) for b, start in first.items() for i in self.short[b]]
        return out

    def _look(self, parts, own, found) -> None:
        import numpy as np

        buf = b"\0".join(parts) + bytes(16)
        n = len(buf) - 16 - Q + 1
        if n <= 0:
            return
        h = grams(buf, n)
        bucket = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        key = self.table[bucket]
        at = np.flatnonzero(key >= 0)
        key, h, bucket = key[at], h[at], bucket[at]
        same = self.keys[key] == h
        again = np.flatnonzero(~same & self.shared[bucket])
        if len(again):
            other = np.minimum(np.searchsorted(self.keys, h[again]), len(self.keys) - 1)
            key[again] = other
            same[again] = self.keys[other] == h[again]
        at, key = at[same], key[same]
        if not len(at):
            return
        count = self.count[key]
        ends = np.cumsum(count)
        which = np.arange(ends[-1]) - np.repeat(ends - count - self.first[key], count)
        item = self.item[which]
        # diagonals: where the item would begin; each band of width `band` counts with the next one
        diagonal = np.repeat(at, count) - self.offset[which] + (1 << 24)
        bands, hits = np.unique((item << 36) | (diagonal // self.band), return_counts=True)
        following = np.zeros(len(hits), np.int64)
        next_to = np.flatnonzero(np.diff(bands) == 1)
        following[next_to] = hits[next_to + 1]
        before = np.zeros(len(hits), np.int64)
        before[next_to + 1] = hits[next_to]
        need = self.least[bands >> 36]
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        for j in np.flatnonzero((hits + following >= need) | ((hits + before >= need) & (before == 0))):
            number = int(bands[j] >> 36)
            low = int(bands[j] & ((1 << 36) - 1)) * self.band - (1 << 24)
            high = low + 2 * self.band - 1
            name, item_bytes = self.items[number]
            most = int(self.most[number])
            a = max(0, int(np.searchsorted(starts, low - most, "right")) - 1)
            b = min(len(parts) - 1, max(0, int(np.searchsorted(starts, high + most + len(item_bytes), "right")) - 1))
            for k in range(a, b + 1):
                text, shift = own[k]
                old = found.get((text, number))
                if old and old[2] == 0:
                    continue
                begin = int(starts[k])
                first, last = low - begin, high - begin
                exact = parts[k].find(item_bytes, max(0, first), max(0, last + len(item_bytes)))
                if exact >= 0:
                    found[text, number] = (shift + exact, len(item_bytes), 0)
                    continue
                cut = max(0, first - most)
                segment = parts[k][cut : max(0, last + len(item_bytes) + 2 * most)]
                edits, end = band_edits(item_bytes, segment, first - cut, last - cut, most)
                if edits <= most and (not old or edits < old[2]):
                    start = max(0, end - len(item_bytes))
                    found[text, number] = (shift + cut + start, end - start, edits)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The stated items, sorted by id, in blocks of at most INDEX_BYTES (or one item), each read by
    itself: the driver holds one block at a time, whatever the benchmark's size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
    block, held = [], 0
    for row in items.orderBy("i", "t").toLocalIterator():
        if block and held + len(row["t"]) > INDEX_BYTES:
            yield block
            block, held = [], 0
        block.append((row["i"], row["t"]))
        held += len(row["t"])
    yield block


def index_of(block: list[tuple[int, str]]) -> Index:
    """The index of a block of items, built once a Python worker."""
    from xxhash import xxh3_128_intdigest

    cache, key = worker_cache("leaks"), xxh3_128_intdigest(repr(block).encode("utf-8", "surrogatepass"))
    if cache.get("leaks", (None,))[0] != key:
        cache["leaks"] = (key, Index(block))
    return cache["leaks"][1]


def _search(block):
    def run(batches):
        import pyarrow as pa

        index = index_of(block)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            hits = index.find([normalise(t) for t in batch.column(1).to_pylist()])
            cols = [[docs[h[0]] for h in hits], *([h[i] for h in hits] for i in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "length", "edits"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (row of docs, benchmark item) where the document holds the item: doc_id, item_id,
    start and length in bytes of the normalised text, edits.

    An item is held if some stretch of the normalised text is within budget(bytes of the item)
    byte edits of it. By the q-gram lemma such a stretch shares at least length - Q + 1 - Q * edits
    q-grams with the item, all on diagonals within `edits` of each other, so counting hits in
    overlapping bands of diagonals loses none; bands that reach the bound are aligned.

    The benchmark is the stated query set: it is indexed in blocks of bounded size and each block
    is held against all rows; no document is shuffled. Items under LEAST bytes, where the lemma says
    nothing, are held where they stand verbatim, as whole words. Null texts are empty and hold
    nothing; very long ones are searched whole; items that are null or empty once normalised are left out; items with one text are each found;
    repeated rows and tied ids each get their rows; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(benchmark):
        part = rows.mapInArrow(_search(block), "doc_id long, " + HIT)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item (see find_leaks), with docs' columns, whatever their
    names. Null and empty texts stay, very long ones are searched whole; repeated rows and tied ids go by their own text;
    an empty table gives no rows, an empty benchmark takes none.
    """
    for block in item_blocks(benchmark):

        @F.pandas_udf("boolean")
        def holds(texts, block=block):
            import pandas as pd

            hits = {h[0] for h in index_of(block).find([normalise(t) for t in texts])}
            return pd.Series([i in hits for i in range(len(texts))], dtype=bool)

        docs = docs.filter(~holds(F.col(text_col)))
    return docs
