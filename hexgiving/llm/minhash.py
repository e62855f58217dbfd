"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import chain, lean, ngram_hashes, stored, word_hashes
from hexgiving.llm.components import connected_components

BANDS, ROWS = 50, 5     # a pair at similarity 0.8 shares no band with probability 2.3e-9
ESTIMATE_SLACK = 0.16   # over six standard deviations of the 250-minima estimate at 0.8
SEED = 20240229
SKETCH_BITS = 1024      # odd sketch: one parity bit for each value of the hashes' low bits
BLOCK = 256, 1024       # visitors and members that one block of the remainder compares


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles (fewer words: the whole sequence as one; none: empty)."""
    h = word_hashes(text)
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else h


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each universal hash x -> a*x + b (mod 2^32), its smallest value over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i:i + 1024] * a + b).min(axis=0), out=out)
    return out


def _odd_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements at each value of the low bits."""
    at = (s % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _packed(m: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, two to a byte."""
    low = (m & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return low[:, ::2] | low[:, 1::2] << 4


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, digest of the full set, odd sketch and four bits per minimum, one key per band."""
    id_type = docs.schema[id_col].dataType
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        a = rng.integers(0, 2**32, k, np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, k, np.uint32)
        for batch in batches:
            count, digest, mins, odd = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(t, n)
                count.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()))
                mins.append(_minima(s, a, b))
                odd.append(_odd_sketch(s))
            low = _packed(np.array(mins, np.uint32).reshape(len(mins), k))
            m = np.array(mins, np.uint32).reshape(len(mins), bands, rows)
            keys = [chain([np.full(len(mins), j, np.uint64), *(m[:, j, i].astype(np.uint64) for i in range(rows))])
                    for j in range(bands)]
            flat = np.stack(keys, 1).view(np.int64).ravel() if len(mins) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array([o + x.tobytes() for o, x in zip(odd, low, strict=True)], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)],
                names=["id", "n_shingles", "digest", "sig", "bands"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_shingles", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Per row: id and its full shingle set."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, n).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)],
                                             names=["id", "set"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("set", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def _both_sides(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """(a, b, x.., y..): pairs with the values of their two ids. Only the pairs' own values are shuffled, by b.

    Both tables are written, so Spark knows their sizes and broadcasts the pairs while they are small.
    """
    left = values.select(F.col("id").alias("a"), *(F.col(n).alias(f"x{i}") for i, n in enumerate(names))).join(pairs, "a")
    right = (values.select(F.col("id").alias("b"), *(F.col(n).alias(f"y{i}") for i, n in enumerate(names)))
             .join(pairs.select("b").distinct(), "b", "left_semi"))
    every = [f"{side}{i}" for side in "xy" for i in range(len(names))]
    return left.join(right, "b").select("a", "b", *every)


def _promising(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int, minima: int) -> np.ndarray:
    """Which rows of signatures (sets of m and n shingles) may be links.

    The share of equal minima is an estimate, held to the threshold less
    ``ESTIMATE_SLACK``; minima that differ still agree in their four bits one
    time in 16, which only raises it. The odd sketches differ in at most as
    many bits as the sets in elements, and so do the sizes: these two bounds
    are exact and lose no link.
    """
    differ = x ^ y
    edge = SKETCH_BITS // 8
    apart = np.maximum(np.bitwise_count(differ[:, :edge]).sum(axis=1, dtype=np.int64), np.abs(m - n))
    tail = differ[:, edge:]
    equal = (tail & 15 == 0).sum(axis=1) + (tail >> 4 == 0).sum(axis=1)
    return (equal >= (percent / 100 - ESTIMATE_SLACK) * minima) & (100 * (m + n - apart) >= percent * (m + n + apart))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures and sizes allow a link (``_promising``)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        for i in (2, 4))
                m, n = (batch.column(i).to_numpy() for i in (3, 5))
                batch = batch.filter(pa.array(_promising(x, y, m, n, percent, BANDS * ROWS)))
            yield batch.select([0, 1])

    both = _both_sides(stored(pairs, "pairs"), reps.withColumnRenamed("rep", "id"), "sig", "n_shingles")
    return both.mapInArrow(lean(run), pairs.select("a", "b").schema).distinct()


def _sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    # the ids are written, so Spark knows their size: it sends them to the texts while they are small
    ids = stored(ids.distinct(), "ids")
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(ids, "id", "left_semi")
    return stored(_sets(wanted, "id", "t", n), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full sets."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    both = _both_sides(pairs, _sets_of(ids, docs, id_col, text_col, n), "set")
    return both.mapInArrow(lean(run), pairs.select("a", "b").schema).distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set, through the left sets' sorted elements."""
    elements = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), [len(x) for x in left])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for j, r in enumerate(right):
        lo, hi = np.searchsorted(elements, r, "left"), np.searchsorted(elements, r, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        out[:, j] = np.bincount(owner[at], minlength=len(left))
    return out


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (id, c) of different components, by an exact prefix filter.

    With shingles ordered from rare to common, two sets at or above the
    threshold share one among the first ``size - ceil(percent * size / 100)
    + 1`` of each. A shingle that many sets have there is mostly one
    component's (its home); members of other components that have it there
    are that home's visitors. So a link joins a visitor with a home member or
    another visitor. Those are counted against each other in blocks of
    bounded size, and only links leave a block.
    """
    rows = sets.join(members, "id").select("id", "c", "set", F.size("set").alias("size"), F.xxhash64("set").alias("row"))
    rows = stored(rows, "members")
    shingles = rows.select("id", "c", "size", "row", F.explode("set").alias("s"))
    counts = shingles.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("id", "row", "size").orderBy(F.coalesce("n", F.lit(1)), "s")
    first = F.expr(f"size - ({percent} * size + 99) div 100 + 1")
    common = F.count("n").over(Window.partitionBy("id", "row", "size"))
    prefix = stored(shingles.join(counts, "s", "left").withColumn("rank", F.row_number().over(order))
                    .withColumn("common", common)
                    .where((F.col("rank") <= first) & (F.col("n") > 1) & F.expr(f"100 * common >= {percent} * size"))
                    .select("s", "id", "row", "c"), "prefix")
    home = (prefix.groupBy("s", "c").agg(F.count("*").alias("k"))
            .groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("home")))
    at = prefix.join(home, "s").select("home", "id", "row", (F.col("c") != F.col("home")).alias("visits")).distinct()
    at = stored(at.groupBy("home", "id", "row").agg(F.max("visits").alias("visits")), "homes")
    size = at.groupBy("home").agg((F.sum(F.col("visits").cast("int")) / BLOCK[0]).cast("int").alias("la"),
                                  (F.count("*") / BLOCK[1]).cast("int").alias("lb"),
                                  F.max("visits").alias("any")).where("any").drop("any")
    at = at.join(size, "home").join(rows.drop("size"), ["id", "row"])
    spread = F.xxhash64("id", "row")
    every = F.sequence(F.lit(0), F.col("lb"))
    # keys of one type on both sides: a cogroup does not cast them
    left = at.where("visits").select("home", F.pmod(spread, F.col("la") + 1).cast("int").alias("i"), F.explode(every).alias("j"),
                                     "id", "c", "set")
    right = at.select("home", F.explode(F.sequence(F.lit(0), F.col("la"))).alias("i"),
                      F.pmod(spread, F.col("lb") + 1).cast("int").alias("j"), "id", "c", "set").toDF("home", "i", "j", "id", "c", "set")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        sets = [[x.values.to_numpy() for x in t.column("set")] for t in (a, b)]
        if not sets[0] or not sets[1]:
            return pa.table({"a": a.column("id").slice(0, 0), "b": b.column("id").slice(0, 0)})
        both = _overlaps(*sets)
        union = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]]) - both
        i, j = np.nonzero(100 * both >= percent * union)
        a, b = a.take(pa.array(i)), b.take(pa.array(j))
        out = pa.table({"a": a.column("id"), "b": b.column("id")})
        return out.filter(pc.not_equal(a.column("c"), b.column("c")))

    id_type = members.schema["id"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    keys = ("home", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, schema).distinct()


def near_duplicate_links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, words: int,
                         percent: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs at or above ``percent``.

    Equal sets are collapsed to their smallest id first, so a group of any
    number of copies costs one row in each band. In a bucket every member is
    then compared with the bucket's smallest id (the pivot), never all with
    all. Members that this leaves in different components are compared by an
    exact prefix filter, so no link between different texts is lost.
    """
    live = signed.where("id IS NOT NULL AND n_shingles > 0")
    reps = stored(live.groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig"),
                                             F.any_value("n_shingles").alias("n_shingles"),
                                             F.any_value("bands").alias("bands")), "reps")
    copies = (live.select("id", "digest").join(reps.select("digest", "rep"), "digest").where("id != rep")
              .select(F.col("id").alias("a"), F.col("rep").alias("b")))
    buckets = reps.select(F.explode("bands").alias("key"), "rep")
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(buckets.join(pivots, "key").where("rep != pivot"), "buckets")
    sig = reps.select("rep", "sig", "n_shingles")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        likely = stored(_likely(pairs, sig, percent), f"{name}-likely")
        return stored(_confirmed(likely, docs, id_col, text_col, words, percent), f"{name}-links")

    first = verify(shared.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pivot")
    links = first.unionByName(copies)
    # members of one bucket that are still in different components, pivots aside
    found = connected_components(first)
    placed = (shared.join(found.withColumnRenamed("node", "rep"), "rep", "left")
              .select("key", "rep", F.coalesce("component", "rep").alias("c")))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    members = stored(placed.join(open_keys, "key").select(F.col("rep").alias("id"), "c").distinct(), "open")
    sets = _sets_of(members.select("id"), docs, id_col, text_col, words)
    return links.unionByName(stored(_across(members, sets, percent), "rest-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept (the document with the component's smallest id).

    A document's set holds its distinct ``words``-word shingles (A-Z
    lower-cased). Null, empty or blank text: empty set, linked with nothing,
    its own component, kept. Null id: never linked, component null, kept.
    Rows that repeat an id are one node: they get one component, and links of
    any of them count. Other columns are not read.
    """
    signed = stored(signatures(docs, id_col, text_col, words, BANDS, ROWS), "signatures")
    parts = connected_components(near_duplicate_links(docs, signed, id_col, text_col, words, percent))
    out = signed.select("id", "n_shingles").join(parts.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
