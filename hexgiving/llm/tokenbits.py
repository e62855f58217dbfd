"""Token ids in bit-packed binary files: the fewest bits that hold the vocabulary, with block offsets.

File format, little-endian. A file is a run of blocks, each followed by one
newline byte. A block: magic ``HXB1``; uint32 bits per id; uint32 shard;
uint64 ids before it in the shard; uint32 documents n; uint64 ids m; n bytes
(1: document id is null); n int64 document ids; n + 1 uint64 offsets (ids of
the block before each document, then m); ceil(m * bits / 8) bytes of ids,
first id in the lowest bits. Id k lies at bit k * bits, so any document or
range is read without what precedes it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import stored
from hexgiving.llm.tokenizer import encoder

HEADER = struct.Struct("<4sIIQIQ")
MAGIC = b"HXB1"
BLOCK_IDS = 1 << 19         # ids after which a block is closed
BLOCKS_PER_FILE = 16


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit stream, ``bits`` each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(planes, bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a bit stream, reading only their bytes."""
    if stop <= start:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first = start * bits // 8
    window = np.frombuffer(raw, np.uint8, (stop * bits + 7) // 8 - first, first)
    planes = np.unpackbits(window, bitorder="little")[start * bits - first * 8:][:(stop - start) * bits]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :bits] = planes.reshape(-1, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _block(shard: int, before: int, doc_ids: list, ids: list[bytes], bits: int) -> bytes:
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="<u8")
    m = int(offsets[-1])
    return b"".join([
        HEADER.pack(MAGIC, bits, shard, before, len(doc_ids), m), bytes(x is None for x in doc_ids),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), offsets.tobytes(),
        pack_bits(np.frombuffer(b"".join(ids), "<u4"), bits)])


def blocks(content: bytes) -> Iterator[dict]:
    """The blocks of one file, ids still packed."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, bits, shard, before, n, m = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEADER.size
        null = np.frombuffer(content, np.uint8, n, at).astype(bool)
        doc_ids = np.frombuffer(content, "<i8", n, at + n)
        offsets = np.frombuffer(content, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        size = (m * bits + 7) // 8
        yield {"bits": bits, "shard": shard, "before": before, "null": null, "doc_ids": doc_ids, "offsets": offsets,
               "ids": view[at:at + size]}
        at += size + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Tokenize whole texts (null: empty), append ``end_id`` to each, write them in ascending id order.

    Shards are the range partitions of the sort, so shard order is id order
    (nulls first; rows that repeat an id follow each other, ordered by text
    hash). A task holds one open block. Spark's own file commit writes the
    blocks, so a retried task leaves no half file. Ids must be integers.
    """
    bits = bits_for(vocabulary)

    def run(batches):
        shard, before, count = TaskContext.get().partitionId(), 0, 0
        enc, end, keys, ids = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), [], []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i in range(0, len(names), 200):
                for key, b in zip(names[i:i + 200], enc.encode(batch.column(1)[i:i + 200].to_pylist()), strict=True):
                    keys.append(key)
                    ids.append(b + end)
                    count += len(b) // 4 + 1
                    if count >= BLOCK_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([_block(shard, before, keys, ids, bits)])], names=["value"])
                        before, count, keys, ids = before + count, 0, [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([_block(shard, before, keys, ids, bits)])], names=["value"])

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
               .select("id", "text"))
    packed = ordered.mapInArrow(run, "value binary")
    # the text writer copies a string's bytes as they are and ends each with a newline
    (packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE)
     .option("compression", "none").text(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard) and, if asked, ids, of every document in the files.

    start: ids of all documents before it, over all shards.
    """
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for b in blocks(content.as_py()):
                    o = b["offsets"]
                    flat = unpack_bits(b["ids"], b["bits"], 0, int(o[-1]))
                    raw, ends = flat.tobytes(), (o * 4).tolist()
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
                    n = len(b["doc_ids"])
                    columns = [pa.array(b["doc_ids"], mask=b["null"]), pa.array(o[:-1] + b["before"]), pa.array(np.diff(o)),
                               pa.array(crc, pa.int64()), pa.array(np.full(n, b["shard"], np.int32))]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(o.astype(np.int32), flat.view(np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "local", "n_tokens", "ids_crc32", "shard"] + ["ids"] * with_ids
    schema = "id long, local long, n_tokens long, ids_crc32 long, shard int" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = stored(files.mapInArrow(run, schema), "token-index")
    # one row per shard: the running total is small whatever the data
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    out = rows.join(first, "shard")
    return out.select("id", (F.col("first") + F.col("local")).alias("start"), *names[2:])
