"""Token ids in binary segments of patched frame-of-reference (PFOR) blocks.

A segment holds whole documents and is laid out, little-endian, as

    magic "PFR1" | documents u32 | blocks u32 | ids u64
    document ids i64 (zero where the id is null) | whether each id is null u8
    ids of each document u32
    block starts u32: bytes from the start of the block area to each block, and its end
    blocks: minimum u32 | width u8 | exceptions u16 | packed | exception places u16 | exception values u32

A block has ``BLOCK`` ids. The block minimum is subtracted; ``width`` bits hold the given
percentile of what is left; ids that need more bits are listed as exceptions with their place
and whole value. Spark writes segments as rows of a Parquet binary column, so that any store
Spark can write to will do, and its committer drops what lost executors left behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import giving_back, new_path
from graphcall.llm.wordbpe import encoded, encoder

BLOCK = 512
HEAD, BODY = struct.Struct("<4sIIQ"), struct.Struct("<IBH")
SCHEMA = "shard_doc long, shard_hash long, shard_salt double, segment int, before long, n_docs int, n_ids long, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values to rows of BLOCK * width / 8 bytes: every 32 values fill ``width`` words of 32 bits, lowest bits first."""
    groups = np.ascontiguousarray(values.reshape(-1, 32).T)
    out = np.zeros((width, groups.shape[1]), np.uint32)
    for k in range(32 if width else 0):
        word, shift = divmod(k * width, 32)
        out[word] |= groups[k] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= groups[k] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T).astype("<u4", copy=False).view(np.uint8).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u4").astype(np.uint32, copy=False).reshape(-1, width).T)
    out = np.empty((32, words.shape[1]), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        out[k] = words[word] >> np.uint32(shift)
        if shift + width > 32:
            out[k] |= words[word + 1] << np.uint32(32 - shift)
    return np.ascontiguousarray((out & mask).T).reshape(len(packed), BLOCK)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment of whole documents. ``percentile``: the share of a block's ids that its width must hold."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks = np.zeros((n_blocks, BLOCK), np.uint32)
    blocks.reshape(-1)[: len(ids)] = ids
    if n_blocks:
        blocks.reshape(-1)[len(ids) :] = ids[-1]
    low = blocks.min(axis=1, initial=2**32 - 1) if n_blocks else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    place = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    need = np.partition(rest, place, axis=1)[:, place] if n_blocks else low
    widths = np.ceil(np.log2(need.astype(np.float64) + 1)).astype(np.int64)
    bodies: list[bytes] = [b""] * n_blocks
    for w in np.unique(widths):
        chosen = np.flatnonzero(widths == w)
        for part in np.array_split(chosen, max(1, len(chosen) // 256)):
            own = rest[part]
            over = own >> np.uint32(w) != 0 if w < 32 else np.zeros(own.shape, bool)
            packed = _pack(np.where(over, np.uint32(0), own), int(w)).tobytes()
            counts = over.sum(axis=1)
            ends, size = np.cumsum(counts).tolist(), int(w) * BLOCK // 8
            at, values = np.nonzero(over)[1].astype("<u2").tobytes(), own[over].astype("<u4").tobytes()
            for row, (k, least, n) in enumerate(zip(part.tolist(), low[part].tolist(), counts.tolist(), strict=True)):
                b = ends[row]
                bodies[k] = b"".join((BODY.pack(least, int(w), n), packed[row * size : row * size + size], at[2 * (b - n) : 2 * b], values[4 * (b - n) : 4 * b]))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype("<u4")
    return b"".join([
        HEAD.pack(b"PFR1", len(doc_ids), n_blocks, len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u4").tobytes(),
        starts.tobytes(),
        *bodies,
    ])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids of a segment."""
    magic, n_docs, n_blocks, n_ids = HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    at = HEAD.size
    docs, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    null, at = np.frombuffer(data, "u1", n_docs, at), at + n_docs
    lengths, at = np.frombuffer(data, "<u4", n_docs, at), at + 4 * n_docs
    starts, at = np.frombuffer(data, "<u4", n_blocks + 1, at).astype(np.int64), at + 4 * (n_blocks + 1)
    raw, starts = np.frombuffer(data, np.uint8), at + starts[:-1]
    heads = raw[starts[:, None] + np.arange(BODY.size)]
    low, widths, over = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0], heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    out = np.empty((n_blocks, BLOCK), np.uint32)
    for w in np.unique(widths):
        chosen, size = np.flatnonzero(widths == w), int(w) * BLOCK // 8
        for part in np.array_split(chosen, max(1, len(chosen) // 256)):
            out[part] = _unpack(raw[(starts[part] + BODY.size)[:, None] + np.arange(size)], int(w))
    # Exceptions of all blocks at once: the k-th of a block lies 2 k bytes behind its packed part, its value 4 k behind all places.
    block = np.repeat(np.arange(n_blocks), over)
    k = np.arange(len(block)) - np.repeat(np.cumsum(over) - over, over)
    lists = starts + BODY.size + widths * BLOCK // 8
    place = raw[(lists[block] + 2 * k)[:, None] + np.arange(2)].view("<u2")[:, 0]
    out[block, place] = raw[(lists[block] + 2 * over[block] + 4 * k)[:, None] + np.arange(4)].view("<u4")[:, 0]
    out += low[:, None].astype(np.uint32)
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], lengths, out.reshape(-1)[:n_ids]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    segment_ids: int = 262_144, percentile: float = 0.9,
) -> str:
    """Encodes whole texts and writes segments in ascending order of ``id_col``; returns the path.

    Documents are dealt by ranges of (id, text hash, a draw), so one id on many rows, and one row many times, is split too; each
    partition sorts its range, encodes it and cuts segments of about ``segment_ids`` ids (a longer
    document gets one of its own). Null texts count as empty, null ids come first, repeated rows
    are all written, other columns are ignored; an empty table gives no segments. A text is encoded in one piece of a worker's memory.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.rand(17).alias("salt"), "text").repartitionByRange("doc_id", "hash", "salt").sortWithinPartitions("doc_id", "hash", "salt")
    rows.mapInArrow(giving_back(_segments(tokenizer_path, end_id, segment_ids, percentile)), SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return path


def _segments(tokenizer_path: str, end_id: int, segment_ids: int, percentile: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        first: list = []
        docs: list = []
        parts: list = []
        done = {"ids": 0, "segment": 0, "held": 0}

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [*first, done["segment"], done["ids"], len(docs), len(ids), encode_segment(docs, [len(p) // 4 for p in parts], ids, percentile)]
            done.update(ids=done["ids"] + len(ids), segment=done["segment"] + 1, held=0)
            docs.clear(), parts.clear()
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            if ids and not first:
                first.extend(batch.column(k)[0].as_py() for k in range(3))
            for at, found in encoded(encode, batch.column(3), end_id):
                for k, part in enumerate(found, at):
                    docs.append(ids[k])
                    parts.append(part)
                    done["held"] += len(part) // 4
                    if done["held"] >= segment_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """One row for each document of the segments at ``path``: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian u32).

    ``start`` counts the ids of all documents before it: segments know what their shard holds
    before them, and what earlier shards hold is a running sum over one row a shard. There are as
    many shards as the writer had partitions, which bounds the broadcast.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)
    shards = segments.groupBy("shard_doc", "shard_hash", "shard_salt").agg(F.sum("n_ids").alias("shard_ids"))
    earlier = Window.orderBy(F.col("shard_doc").asc_nulls_first(), "shard_hash", "shard_salt").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard_doc").alias("s_doc"), F.col("shard_hash").alias("s_hash"), F.col("shard_salt").alias("s_salt"), F.coalesce(F.sum("shard_ids").over(earlier), F.lit(0)).alias("base"))
    rows = segments.select("shard_doc", "shard_hash", "shard_salt", "before", "payload").mapInArrow(_documents(with_ids), "shard_doc long, shard_hash long, shard_salt double, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    same = F.col("shard_doc").eqNullSafe(F.col("s_doc")) & (F.col("shard_hash") == F.col("s_hash")) & (F.col("shard_salt") == F.col("s_salt"))
    return rows.join(F.broadcast(shards), same).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _documents(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, lengths, ids = decode_segment(batch.column(4)[k].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                places = ends - lengths
                whole = memoryview(ids.astype("<u4", copy=False)).cast("B")
                raw = [whole[4 * a : 4 * b] for a, b in zip(places.tolist(), ends.tolist(), strict=True)]
                shard = [pa.array([batch.column(c)[k].as_py()] * len(docs), kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                rows = [pa.array(docs, pa.int64()), pa.array(places + batch.column(3)[k].as_py(), pa.int64()), pa.array(lengths.astype(np.int64))]
                rows += [pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([bytes(r) for r in raw] if with_ids else [None] * len(raw), pa.binary())]
                yield pa.RecordBatch.from_arrays(shard + rows, ["shard_doc", "shard_hash", "shard_salt", "doc_id", "place", "n_tokens", "ids_crc32", "ids"])

    return run
