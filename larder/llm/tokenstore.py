"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

A store is a folder with two Parquet tables, written by Spark's own committer, so lost executors
leave no partial files:

* `codebook` (id, bits): the code length of each id that occurs. Codes are canonical: ordered by
  (bits, id), each one more than the one before, so lengths are all a reader needs.
* `blocks`: file, block, start (ids in this file before the block), doc_ids, doc_lens, n_ids,
  checkpoints (unsigned 32-bit bit offset of each EVERYth id) and payload (big-endian bits). A
  block needs nothing of another to be decoded, and a reader can enter it at any checkpoint.

Blocks are in ascending order of document id: file by file, block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, materialize, remove_folder, shared_folder
from .tokens import encoder, tokenizer

#: Ids between checkpoints, a multiple of 4; ids from which a block is closed; limit of a code's bits.
EVERY, BLOCK, LIMIT = 128, 1 << 18, 16
RAW = "doc_ids array<long>, doc_lens array<long>, ids binary, counts binary"
STORED = "file int, block int, start long, n_ids long, doc_ids array<long>, doc_lens array<long>, checkpoints binary, payload binary"


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n <= 1:
        return {s: 1 for s in symbols}
    limit = max(limit, (n - 1).bit_length())
    leaves = [(counts[s], i) for i, s in enumerate(symbols)]
    # each level keeps its items in order; an item is a leaf or a package of two below
    levels = [leaves]
    for _ in range(limit - 1):
        below = levels[-1]
        packages = [(below[i][0] + below[i + 1][0], -1) for i in range(0, len(below) - 1, 2)]
        levels.append(sorted(leaves + packages, key=lambda x: x[0]))
    bits = [0] * n
    take = 2 * n - 2
    for level in reversed(levels):
        packages = 0
        for _, leaf in level[:take]:
            if leaf < 0:
                packages += 1
            else:
                bits[leaf] += 1
        take = 2 * packages
    return {s: bits[i] for i, s in enumerate(symbols)}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """(ids, bits, codes) in canonical order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, codes, code, last = [lengths[s] for s in order], [], 0, 0
    for b in bits:
        code <<= b - last
        codes.append(code)
        code, last = code + 1, b
    return order, bits, codes


def encode_block(ids, code, length):
    """(payload, checkpoints) of a block: codes are joined two and two to at most 64 bits, then laid into words."""
    import numpy as np

    v, n = code[ids], length[ids]
    pad = -len(v) % 4
    v, n = np.pad(v, (0, pad)), np.pad(n, (0, pad))
    for _ in range(2):
        v, n = (v[0::2] << n[1::2]) | v[1::2], n[0::2] + n[1::2]
    ends = np.cumsum(n.astype(np.int64))
    if not len(ends):
        return b"", b""
    at = ends - n.astype(np.int64)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    left = np.where(n > 0, v << ((np.uint64(64) - n) & np.uint64(63)), np.uint64(0))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(left >> off, first)
    spill = np.where(off > 0, left << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    over = np.flatnonzero(spill)
    out[word[over] + 1] |= spill[over]  # one item at most runs over a word's end
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at[:: EVERY // 4].astype("<u4").tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n_ids: int, table_id, table_bits, limit: int):
    """All ids of a block: one lane for each checkpoint, a table look-up for each id of all lanes."""
    import numpy as np

    lanes = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.empty((EVERY, len(lanes)), np.uint32)
    raw = np.frombuffer(payload + bytes(8 + 4 * EVERY), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    mask, most = (1 << limit) - 1, len(window) - 1
    for i in range(EVERY):
        key = (window[np.minimum(lanes >> 3, most)] >> (32 - limit - (lanes & 7)).astype(np.uint32)) & mask
        out[i] = table_id[key]
        lanes += table_bits[key]
    return out.T.reshape(-1)[:n_ids]


def _decoder(lengths: dict[int, int]):
    import numpy as np

    ids, bits, codes = canonical(lengths)
    limit = max([1, *bits])
    if limit > 24:
        raise ValueError("codes of more than 24 bits")
    table_id, table_bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    for s, b, c in zip(ids, bits, codes):
        table_id[c << (limit - b) : (c + 1) << (limit - b)] = s
        table_bits[c << (limit - b) : (c + 1) << (limit - b)] = b
    return lambda payload, checkpoints, n: decode_block(payload, checkpoints, n, table_id, table_bits, limit)


def _tokenize(path: str, end_id: int):
    def run(batches):
        import struct

        import numpy as np
        import pyarrow as pa

        encode, end = encoder(path), struct.pack("<I", end_id)
        size = max(tokenizer(path).get_vocab_size(), end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        counts = np.zeros(size, np.int64)
        docs, lens, parts, held = [], [], [], 0

        def block(total=None):
            nonlocal held
            ids = np.frombuffer(b"".join(parts), "<u4")
            if total is None:
                np.add(counts, np.bincount(ids, minlength=size), out=counts)
            out = pa.RecordBatch.from_arrays([pa.array([docs[:]], pa.list_(pa.int64())), pa.array([lens[:]], pa.list_(pa.int64())), pa.array([pa.compress(ids.astype(kind).tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([total], pa.binary())], names=["doc_ids", "doc_lens", "ids", "counts"])
            docs.clear(), lens.clear(), parts.clear()
            held = 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                docs.append(doc), lens.append(len(ids) // 4), parts.append(ids)
                held += len(ids) // 4
                if held >= BLOCK:
                    yield block()
        if docs:
            yield block()
        yield block(counts.tobytes())

    return run


def _counts(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            n = np.frombuffer(raw, np.int64)
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])


def _encode(lengths: dict[int, int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids, bits, codes = canonical(lengths)
        size = max([0, *ids]) + 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        code[ids], length[ids] = codes, bits
        file, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for docs, lens, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = sum(lens)
                kind = "<u2" if size <= 1 << 16 else "<u4"
                width = 2 if kind == "<u2" else 4
                got = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), kind)
                payload, checkpoints = encode_block(got, code, length)
                values = [file, number, before, n, docs, lens, checkpoints, payload]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["file", "block", "start", "n_ids", "doc_ids", "doc_lens", "checkpoints", "payload"])
                number, before = number + 1, before + n

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize each row's text, add end_id, and write the store `folder` in ascending id order.

    The rows are dealt by ranges of (id, hash of the text), so a tied id can be split; each range
    is one file. A range's ids are tokenized once and kept in a checkpoint, compressed, while the
    counts of all ranges are added up; the code comes from these global counts. The driver sees
    the vocabulary's counts only. Null ids come first; null texts are empty (the end id alone); very long texts are one block; repeated
    rows are each written; an empty table gives an empty store.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, docs.rdd.getNumPartitions())
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    raw = materialize(dealt.select("doc_id", "text").mapInArrow(_tokenize(path, end_id), RAW))
    counts = raw.filter(F.col("counts").isNotNull()).select("counts").mapInArrow(_counts, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r["id"]: r["n"] for r in counts.collect()})  # as many as the vocabulary has, at most
    spark = docs.sparkSession
    spark.createDataFrame([(int(s), int(b)) for s, b in lengths.items()], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    raw.filter(F.col("counts").isNull()).select("doc_ids", "doc_lens", "ids").mapInArrow(_encode(lengths), STORED).write.option("compression", "none").parquet(f"{folder}/blocks")


def _read(lengths: dict[int, int], with_ids: bool):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        decode = _decoder(lengths)
        for batch in batches:
            for file, before, n, docs, lens, checkpoints, payload in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_ids", "doc_ids", "doc_lens", "checkpoints", "payload"))):
                ids = decode(payload, checkpoints, n).astype("<u4")
                ends = np.cumsum(np.array(lens, np.int64))
                own = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), lens)]
                cols = [pa.array([file] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array((ends - np.array(lens, np.int64) + before).tolist(), pa.int64()), pa.array(lens, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * len(docs), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Rows of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit)."""
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{folder}/codebook").collect()}
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row for each file; the running sum sees no documents
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select(F.col("file").alias("__file"), (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("__before"))
    got = blocks.mapInArrow(_read(lengths, with_ids), "file int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    out = got.join(few(files), F.col("file") == F.col("__file"))
    return out.select("doc_id", (F.col("at") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder, read all of it back, and drop it; what was read, without the ids.

    Per row of docs: doc_id, start, n_tokens, ids_crc32, in ascending id order, null ids first. Null and
    empty texts are the end id alone; repeated rows and tied ids each have theirs, tied ones in the order of
    a hash of the text; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    try:
        write_tokens(docs, path, folder, end_id)
        return materialize(read_tokens(spark, folder, with_ids=False))
    finally:
        remove_folder(spark, folder)
