"""Best-fit-decreasing packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import slices, stored
from hexgiving.llm.tokenizer import encoder, forget_words

ROWS_PER_BUCKET = 100_000


class CapacityTree:
    """Segment tree over remaining capacities 0..size: each node counts the open bins below it."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = [0] * (2 * self.base)

    def add(self, capacity: int, bins: int) -> None:
        i = self.base + capacity
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has."""
        i = self.base + least
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.base


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing over a histogram of lengths.

    Returns placements (length, first rank, first bin, pieces per bin, offset)
    and the number of bins: the r-th piece of a length goes by the last
    placement that starts at or before r, to bin ``first_bin + (r - first) //
    per_bin`` at ``offset + (r - first) % per_bin * length``. Bins of equal
    remaining capacity are alike, so a run of equal pieces takes whole runs of
    bins; the result is that of placing the pieces one at a time. Work and
    result are bounded by the capacity, not by the number of pieces.
    """
    tree, runs = CapacityTree(capacity), defaultdict(deque)
    placements, bins = [], 0

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            runs[left].append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, per = capacity, capacity // length
                first, n = bins, -(-todo // per)
                bins += n
            else:
                first, n = runs[left].popleft()
                tree.add(left, -n)
                per = left // length
            placements.append((length, rank, first, per, capacity - left))
            full, rest = divmod(min(todo, n * per), per)
            give(left - per * length, first, full)
            if rest:
                give(left - rest * length, first + full, 1)
            give(left, first + full + bool(rest), n - full - bool(rest))
            rank += full * per + rest
            todo -= full * per + rest
    return placements, bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 (and ids): the tokens of the whole text and ``end_id``.

    Only documents over ``capacity`` are cut, into pieces of that length of
    which the first may be shorter. Null or empty text: the end id alone.
    """
    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            row, no, start, length, crc, ids = [], [], [], [], [], []
            for i, b in enumerate(enc.encode(batch.column(1).to_pylist())):
                b += end
                n = len(b) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for j, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    no.append(j)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(b[4 * s:4 * e]))
                    if keep_ids:
                        ids.append(b[4 * s:4 * e])
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(no, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0, *length], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(ends, flat))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [docs.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(),
             T.ArrayType(T.IntegerType())]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=False)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int, length_col: str, order_by: list[str]) -> DataFrame:
    """``items`` with sequence_id and offset: best-fit-decreasing into sequences of ``capacity``.

    Lengths must be 1..capacity. The histogram of lengths (at most
    ``capacity`` rows) goes to the driver, which packs it; each row finds its
    place from its rank among the rows of its length. Ranks come from a row
    number within hashed buckets of bounded size and a running total of the
    bucket sizes, so a length that a third of all rows have is spread over
    buckets. ``order_by`` names columns that fix the order; rows equal in all
    of them are alike. Columns of the result's names are replaced.
    """
    items = stored(items.drop("sequence_id", "offset"), "pieces")
    n = F.col(length_col)
    counts = {r[0]: r[1] for r in items.groupBy(n).count().collect()}
    buckets = sum(counts.values()) // ROWS_PER_BUCKET + 1
    placements, _ = plan(counts, capacity)
    table = np.array(placements, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # one sorted key for (length, rank): lengths are spread further apart than any rank
    spread = max(counts.values(), default=0) + 1
    starts = table[:, 0] * spread + table[:, 1]

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length, rank):
        import pandas as pd
        forget_words()
        length, rank = length.to_numpy(), rank.to_numpy()
        t = table[np.searchsorted(starts, length * spread + rank, "right") - 1]
        at = rank - t[:, 1]
        return pd.DataFrame({"sequence_id": t[:, 2] + at // t[:, 3], "offset": t[:, 4] + at % t[:, 3] * length})

    # the row as one struct: no name of the input meets one of the ranks
    key = [F.col("row")[c] for c in order_by]
    rows = items.select(F.struct(*items.columns).alias("row"), n.cast("long").alias("length"),
                        F.pmod(F.xxhash64(*order_by), F.lit(buckets)).alias("bucket"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*key))
    ranked = (rows.withColumn("rank", inside).join(offsets, ["length", "bucket"])
              .withColumn("at", place("length", (F.col("before") + F.col("rank") - 1).cast("long"))))
    return ranked.select("row.*", "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 (ids), sequence_id, offset. Other columns are not read.

    Null and empty texts pack as their end id; a null id is kept; rows that
    repeat an id are packed each; no rows give no sequences.
    """
    p = pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids)
    return pack(p, capacity, "length", ["id", "piece", "ids_crc32"]).withColumnRenamed("id", id_col)
