"""Bounded-space online packing of token ids into sequences of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence numbers of one task's share.
STRIDE = 1 << 33


class Packer:
    """A fixed number of open windows; a piece goes to the fullest window that has room for it
    (best fit); if none has, the fullest is emitted and a new one opened."""

    def __init__(self, size: int, windows: int, emit):
        self.size, self.windows, self.emit = size, windows, emit
        self.room: list[tuple[int, int]] = []  # (free, window), sorted
        self.open: dict[int, list] = {}
        self.n = 0

    def put(self, length: int, piece) -> None:
        from bisect import bisect_left, insort

        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, w = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                self.emit(self.open.pop(self.room.pop(0)[1]))
            free, w = self.size, self.n
            self.n += 1
            self.open[w] = []
        self.open[w].append(piece)
        if free == length:
            self.emit(self.open.pop(w))
        else:
            insort(self.room, (free - length, w))


def _pack(path: str, size: int, end_id: int, windows: int):
    def run(batches):
        import struct
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(path), struct.pack("<I", end_id)
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        made = 0

        def emit(pieces, left=False):
            nonlocal made
            at, seq = 0, task * STRIDE + made
            made += 1
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, seq, at, ids if left else None))
                at += n

        def table():
            cols = list(zip(*rows)) if rows else [()] * 8
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return out

        packer = Packer(size, windows, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                whole = total // size * size
                for start in range(0, whole, size):
                    emit([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                if whole < total:
                    packer.put(total - whole, (doc, whole, ids[4 * whole :], total))
            if rows:
                yield table()
        # the open windows go on, with their ids, to be merged
        for _, w in packer.room:
            emit(packer.open[w], left=True)
        if rows:
            yield table()

    return run


def _merge(size: int, base: int):
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        made = (base + TaskContext.get().partitionId()) * STRIDE
        rows: list[tuple] = []
        tail: list[tuple] = []
        fill = 0

        def emit(pieces):
            nonlocal made
            at = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, made, at))
                at += len(ids) // 4
            made += 1

        def take(n):
            """The first n ids of the tail."""
            nonlocal fill
            out = []
            fill -= n
            while n:
                doc, start, total, ids = tail.pop(0)
                if len(ids) // 4 > n:
                    tail.insert(0, (doc, start + n, total, ids[4 * n :]))
                    ids = ids[: 4 * n]
                out.append((doc, start, total, ids))
                n -= len(ids) // 4
            return out

        def table():
            cols = list(zip(*rows)) if rows else [()] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                tail.append((doc, start, total, ids))
                fill += len(ids) // 4
                while fill >= size:
                    emit(take(size))
            if rows:
                yield table()
        while fill:  # a power of two needs no padding
            emit(take(1 << (fill.bit_length() - 1)))
        yield table()

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, windows: int = 64, fan_in: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows' token ids (each row's ids end with end_id) into sequences of `size` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A text
    longer than a sequence is cut into whole sequences and a rest. Each task packs its rows online
    in bounded space (`windows` open windows); no ids are shuffled for that. The windows still
    open at a task's end, at most `windows` * `size` ids, go with their ids to one of
    tasks / `fan_in` merging tasks, which lays them end to end, so all but its last sequences are
    full; the last ids are laid out in powers of two, which need no padding. Full-length windows
    that were emitted with room left are padded.

    A null or empty text is the single end id. Repeated rows and tied ids are packed like any
    other; a null id stays null. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = materialize(rows.mapInArrow(_pack(path, size, end_id, windows), PIECE + ", ids binary"))
    tasks = max(1, out.rdd.getNumPartitions())
    done = out.filter(F.col("ids").isNull()).drop("ids")
    left = out.filter(F.col("ids").isNotNull())
    group = F.floor(F.col("sequence_id") / F.lit(STRIDE * fan_in)).cast("int")
    left = left.repartition(-(-tasks // fan_in), group).sortWithinPartitions("sequence_id", "offset")
    merged = left.mapInArrow(_merge(size, tasks), PIECE)
    return done.unionByName(merged)
