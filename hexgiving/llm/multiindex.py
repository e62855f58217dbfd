"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import stored

SAMPLE = 20_000             # vectors the two codebooks are fitted on, at most about
CENTROIDS = 64              # per half, at most; cells are pairs of centroids
ROUNDS = 12
SHARE = 0.75                # share of the index that a query visits, best cells first
BLOCK = 4096, 1024          # vectors and queries of one block, about
SLICE = 128                 # queries multiplied at a time
SEED = 7


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles: not null, no null or non-finite component, not zero, of the common length."""
    v = F.col("v")
    usable = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
              .where(F.col("id").isNotNull() & v.isNotNull())
              .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
              .where(F.exists(v, lambda x: x != 0)))
    lengths = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.where(F.size("v") == (lengths["n"] if lengths else 0))


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means centroids of the sample rows."""
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Cells (as a mask over pairs) from the smallest summed distance on, until they hold ``wanted`` entries.

    ``first`` and ``second``: the query's distance to each half's centroids.
    A heap holds the frontier of the sorted pair grid, so only visited pairs
    and their successors are ever summed.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, fb = first[a].tolist(), second[b].tolist()
    cell = sizes[np.ix_(a, b)].tolist()
    mask = np.zeros(sizes.shape, bool)
    heap, reached, found = [(fa[0] + fb[0], 0, 0)], [0] * len(fa), 0
    taken = []
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        taken.append((i, j))
        found += cell[i][j]
        reached[i] = j + 1
        if j + 1 < len(fb) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (fa[i] + fb[j + 1], i, j + 1))
        if i + 1 < len(fa) and reached[i + 1] == j:
            heapq.heappush(heap, (fa[i + 1] + fb[j], i + 1, j))
    i, j = np.array(taken).T
    mask[a[i], b[j]] = True
    return mask


def search(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           share: float = SHARE) -> DataFrame:
    """Per query row: (query_id, rank, id, score), the ``k`` nearest found by inner product, ties to the smaller id.

    Queries are the rows for which ``query`` (over a column named id) holds;
    candidates every other row. Distance to a cell is minus the inner
    products with its two centroids; visited entries are reranked on the
    original vectors in double precision. The codebooks are fitted on a
    sample chosen by hash; every row is indexed. A query visits ``share`` of
    the index, and ``k`` other ids at least, or all. Null, zero and non-finite
    vectors and those of an uncommon length take no part; null ids neither.
    Rows that repeat an id are one candidate, with the best score of its
    vectors, and one query, likewise. Other columns are not read.

    Index entries are dealt by first centroid and hash into blocks of a
    bounded size, however full a cell is; a block of queries meets a block of
    entries in one matrix product, masked by each query's visited cells, and
    at most ``k`` rows a query leave it.
    """
    spark = vectors.sparkSession
    data = stored(valid_vectors(vectors, id_col, vector_col).distinct(), "vectors")
    n = data.count()
    schema = T.StructType([T.StructField("query_id", vectors.schema[id_col].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], schema)
    parts = 1_000_000
    sample = data.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) < max(1, min(parts, parts * SAMPLE // n))).select("v").toPandas()["v"]
    sample = np.stack(sample.to_numpy()) if len(sample) else np.stack([data.first()["v"]])
    half = sample.shape[1] // 2
    centroids = min(CENTROIDS, max(1, int(n ** 0.5 / 2)))
    books = codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids)
    shape = len(books[0]), len(books[1])
    salts = n // (shape[0] * BLOCK[0]) + 1
    shared = spark.sparkContext.broadcast(books)

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x, (one, two) = flat(batch.column(1)), shared.value
                a, b = _nearest(x[:, :half], one), _nearest(x[:, half:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                                 names=["id", "v", "a", "b"])

    placed = T.StructType([*data.schema.fields, T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    index = stored(data.mapInArrow(assign, placed), "index")
    sizes = np.zeros(shape, np.int64)
    for r in index.groupBy("a", "b").count().collect():     # at most CENTROIDS ** 2 rows
        sizes[r["a"], r["b"]] = r["count"]
    full = spark.sparkContext.broadcast(sizes)
    wanted = data.where(query)
    # k other ids are in any k times the most rows of one id, a query's own rows aside
    most = data.groupBy("id").count().agg(F.max("count")).first()[0]
    least = k * most + most

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (one, two) = flat(batch.column(1)), shared.value
            d1, d2 = -(x[:, :half] @ one.T), -(x[:, half:] @ two.T)
            row, first, cells = [], [], []
            for i in range(len(x)):
                mask = traverse(d1[i], d2[i], full.value, max(int(np.ceil(share * n)), least))
                for a in np.flatnonzero(mask.any(1)):
                    row.append(i)
                    first.append(a)
                    cells.append(np.packbits(mask[a]).tobytes())
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()),
                                              pa.array(cells, pa.binary())], names=["id", "v", "a", "cells"])

    visited = T.StructType([*data.schema.fields, T.StructField("a", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    queries = stored(wanted.mapInArrow(visit, visited), "queries")
    groups = queries.select("id", "v").distinct().count() // BLOCK[1] + 1
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select("a", every(salts).alias("s"), group.alias("g"), "id", "v", "cells")
    right = index.select("a", salt.alias("s"), every(groups).alias("g"), "id", "v", "b").toDF("a", "s", "g", "id", "v", "b")

    def compare(q: pa.Table, e: pa.Table) -> pa.Table:
        out = [[], [], []]
        if q.num_rows and e.num_rows:
            names, x = q.column("id").to_pylist(), flat(q.column("v").combine_chunks())
            cells = np.unpackbits(np.frombuffer(b"".join(q.column("cells").to_pylist()), np.uint8).reshape(q.num_rows, -1),
                                  axis=1).astype(bool)
            ids, y, b = e.column("id").to_pylist(), flat(e.column("v").combine_chunks()), e.column("b").to_numpy()
            number = {}
            owner = np.array([number.setdefault(i, len(number)) for i in ids])
            for i in range(len(names)):
                if i % SLICE == 0:
                    rough_all = x[i:i + SLICE] @ y.T
                rows = np.flatnonzero(cells[i][b] & (owner != number.get(names[i], -1)))
                rough = rough_all[i % SLICE][rows]
                if len(rows) > k:       # the k best ids; ties at the edge stay
                    best = rough
                    if len(number) < len(ids):
                        best = np.full(len(number), -np.inf)
                        np.maximum.at(best, owner[rows], rough)
                    rows = rows[rough >= np.partition(best, len(best) - k)[len(best) - k] - 1e-9] if len(best) > k else rows
                exact = (y[rows] * x[i]).sum(axis=1)
                found = {}
                for s, r in sorted(zip((-exact).tolist(), rows.tolist(), strict=True), key=lambda t: (t[0], ids[t[1]])):
                    found.setdefault(ids[r], -s)
                    if len(found) == k:
                        break
                out[0] += [names[i]] * len(found)
                out[1] += found.keys()
                out[2] += found.values()
        kind = q.schema.field("id").type if q.num_rows else e.schema.field("id").type
        return pa.table({"query_id": pa.array(out[0], kind), "id": pa.array(out[1], kind), "score": pa.array(out[2], pa.float64())})

    found = (left.groupBy("a", "s", "g").cogroup(right.groupBy("a", "s", "g"))
             .applyInArrow(compare, T.StructType([schema["query_id"], schema["id"], schema["score"]])))
    # a query's rows: at most k for each block it met
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
