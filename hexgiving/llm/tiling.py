"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import WORD_HASHES, lean, ngram_hashes, stored

MIN_MATCH = 4           # words; shorter matches are no tiles
COVERAGE = 0.7          # share of a test item's words under tiles
SEEDS_PER_PASS = 2_000_000      # benchmark seeds that one pass over the documents carries (16 MB)
PRIME, BASE = (1 << 61) - 1, 1_000_003
GAP = 0                 # stands for document words outside all seeds

_FOLD = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(),
                        (string.ascii_lowercase + " " * len(string.punctuation)).encode())


def tokens(text: bytes | None) -> np.ndarray:
    """Word hashes: A-Z lower-cased, ASCII punctuation and white space between words."""
    w = (text or b"").translate(_FOLD).split()
    return np.fromiter(map(WORD_HASHES.__getitem__, w), np.uint64, len(w))


def _windows(t: list[int], marked: list[bool], size: int):
    """(start, rolling hash) of each unmarked window of ``size`` tokens."""
    top = pow(BASE, size - 1, PRIME)
    run = h = 0
    for i, x in enumerate(t):
        if marked[i]:
            run = h = 0
            continue
        if run == size:
            h = (h - t[i - size] * top) % PRIME
            run -= 1
        h = (h * BASE + x) % PRIME
        run += 1
        if run == size:
            yield i - size + 1, h


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length) of non-overlapping common runs, longest first.

    For a search length, windows of both sides meet by rolling hash and
    matches grow to their full length; longer finds raise the search length,
    else the found ones are marked and it falls, down to ``least``.
    """
    mine, theirs = [False] * len(item), [x == GAP for x in text]
    tiles, size = [], max(least, len(item) // 2)
    while True:
        index = defaultdict(list)
        for p, h in _windows(item, mine, size):
            index[h].append(p)
        found, longest = [], 0
        for d, h in _windows(text, theirs, size):
            for p in index.get(h, ()):
                k = 0
                while (p + k < len(item) and d + k < len(text) and not mine[p + k] and not theirs[d + k]
                       and item[p + k] == text[d + k]):
                    k += 1
                if k >= size:
                    found.append((-k, p, d))
                    longest = max(longest, k)
            if longest > 2 * size:
                break
        if longest > 2 * size:
            size = longest
            continue
        for k, p, d in sorted(found):
            # an earlier tile may have taken a part: what is left counts if still long enough
            if not any(mine[p:p - k]) and not any(theirs[d:d - k]):
                tiles.append((p, d, -k))
                mine[p:p - k] = theirs[d:d - k] = [True] * -k
        if found and any(not any(mine[p:p + size]) and not any(theirs[d:d + size]) for _, p, d in found):
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


def _seeds(benchmark: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(item, seed, at, n, tokens): one row per window of ``least`` words; tokens on the first alone."""
    def run(batches):
        for batch in batches:
            items, seeds, at, sizes, words = [], [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = tokens(text)
                if item is None or len(t) < least:
                    continue
                s = ngram_hashes(t, least).view(np.int64).tolist()
                items += [item] * len(s)
                seeds += s
                at += range(len(s))
                sizes += [len(t)] * len(s)
                words += [t.view(np.int64).tolist()] + [None] * (len(s) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, batch.schema.types[0]), pa.array(seeds, pa.int64()), pa.array(at, pa.int32()),
                 pa.array(sizes, pa.int32()), pa.array(words, pa.list_(pa.int64()))],
                names=["item", "seed", "at", "n", "tokens"])

    schema = T.StructType([T.StructField("item", benchmark.schema[id_col].dataType), T.StructField("seed", T.LongType()),
                           T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("tokens", T.ArrayType(T.LongType()))])
    return benchmark.select(id_col, text_col).mapInArrow(lean(run), schema)


def _matches(docs: DataFrame, id_col: str, text_col: str, least: int, seeds: np.ndarray, places: bool) -> DataFrame:
    """(id, text_hash, seeds, tokens) of documents that share a seed; words outside the seeds shrink to gaps.

    With ``places``: the words under the seeds alone, and their places.
    """
    known = docs.sparkSession.sparkContext.broadcast(np.unique(seeds))

    def run(batches):
        table = known.value
        mask = np.uint64((1 << max(16, int(len(table)).bit_length() + 4)) - 1)
        hit = np.zeros(int(mask) + 1, bool)
        hit[table & mask] = True
        for batch in batches:
            row, found, kept, at_word = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                t = tokens(text)
                if len(t) < least:
                    continue
                s = ngram_hashes(t, least)
                at = np.flatnonzero(hit[s & mask])
                at = at[table[np.searchsorted(table[:-1], s[at])] == s[at]] if len(table) else at[:0]
                if not len(at):
                    continue
                cover = np.zeros(len(t) + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + least, -1)
                inside = np.cumsum(cover[:-1]) > 0
                first_gap = ~inside & np.concatenate([[not places], inside[:-1] & (not places)])
                if places:
                    at_word.append(np.flatnonzero(inside))
                row.append(i)
                found.append(np.unique(s[at]).view(np.int64))
                kept.append(np.where(inside, t, np.uint64(GAP))[inside | first_gap].view(np.int64))
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (found, kept, *[at_word] * places))], names=schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("seeds", "tokens", *["places"] * places))])
    return docs.select(F.col(id_col), F.xxhash64(text_col), text_col).mapInArrow(lean(run), schema)


def _merged(matches: DataFrame) -> DataFrame:
    """(id, text_hash, seeds, tokens) with the words that any part found, in order; gaps where words are missing between."""
    def run(batches):
        for batch in batches:
            out = []
            for pieces in batch.column(3).to_pylist():
                places, first = np.unique(np.concatenate([p["places"] for p in pieces]), return_index=True)
                words = np.concatenate([np.array(p["tokens"], np.int64) for p in pieces])[first]
                out.append(np.insert(words, np.flatnonzero(np.diff(places, prepend=-1) > 1), GAP))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))],
                                             names=["id", "text_hash", "seeds", "tokens"])

    both = matches.groupBy("id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("seeds"))).alias("seeds"),
                                                  F.collect_set(F.struct("places", "tokens")).alias("pieces"))
    return both.mapInArrow(lean(run), matches.drop("places").schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
                 coverage: float = COVERAGE, by_text: bool = False) -> DataFrame:
    """(id, item, coverage, n_tiles, longest): documents whose tiles cover at least that share of a test item.

    Order of the passages does not matter. Null, empty or shorter texts than
    ``min_match`` words give nothing on either side, nor does a null item
    id; a null document id is kept. Rows that repeat a document (or an item)
    give one result; with ``by_text`` one for each distinct text of an id,
    whose xxhash64 is the column ``text_hash`` after id. Other columns are
    not read.

    Distinct benchmark seeds travel to the documents in parts of about
    ``SEEDS_PER_PASS``, dealt by their hash, one pass over the documents for
    each part, so memory is bounded whatever the benchmark's size and however
    long one item is. What a document shares with each part is put together
    before coverage counts. Only the words under shared
    seeds leave a document. Pairs whose shared seeds cannot reach the
    coverage are dropped before tiling.
    """
    spark = docs.sparkSession
    seeds = stored(_seeds(benchmark, item_col, item_text_col, min_match), "benchmark-seeds")
    parts = max(1, -(-seeds.select("seed").distinct().count() // SEEDS_PER_PASS))
    matches = None
    for part in range(parts):
        mine = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == part)
        values = mine.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64).view(np.uint64)
        found = stored(_matches(docs, id_col, text_col, min_match, values, places=parts > 1), "matches")
        matches = found if matches is None else matches.unionByName(found)
    if parts > 1:
        matches = stored(_merged(matches), "merged")
    shared = matches.select("id", "text_hash", F.explode("seeds").alias("seed")).join(
        seeds.select("item", "seed", "at", "n").distinct(), "seed")
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.collect_set("at"), lambda p: F.sequence(p, p + F.lit(min_match - 1))))))
    likely = (shared.groupBy("id", "text_hash", "item", "n").agg(covered.alias("covered"))
              .where(F.col("covered") >= F.lit(coverage) * F.col("n")))
    items = seeds.where("tokens IS NOT NULL").select("item", F.col("tokens").alias("item_tokens")).distinct()
    left = likely.toDF(*(f"l_{c}" for c in likely.columns))
    pairs = (matches.join(left, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_text_hash")))
             .select("id", "text_hash", F.col("l_item").alias("item"), "tokens").distinct()
             .join(items, "item").select("id", "text_hash", "item", "tokens", "item_tokens"))

    def run(batches):
        for batch in batches:
            rows = []
            for text, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = tile(item, text, min_match)
                rows.append((sum(x[2] for x in found) / len(item), len(found), max((x[2] for x in found), default=0)))
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r[0] for r in rows], pa.float64()),
                 *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2))],
                names=["id", "text_hash", "item", "coverage", "n_tiles", "longest"])
            yield out.filter(pa.array([r[0] >= coverage for r in rows], pa.bool_()))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("item", benchmark.schema[item_col].dataType),
                           T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()),
                           T.StructField("longest", T.IntegerType())])
    # one pair a row costs most here: spread them
    tiled = pairs.repartition("id", "text_hash", "item").mapInArrow(lean(run), schema)
    keys = ("id", "text_hash", "item") if by_text else ("id", "item")
    return tiled.groupBy(*keys).agg(F.max_by(F.struct("coverage", "n_tiles", "longest"), "coverage").alias("t")).select(
        *keys, "t.*")
