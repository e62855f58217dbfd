"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Documents are dealt into blocks of a bounded number of tokens. A block sends
each distinct word and bigram it holds once, with its count, to the partition
that its hash names; there the counts of all blocks are added and go back to
the blocks that asked. So a word that is in every document costs one entry
for each block, and no count table is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import chain, fold, lean, release, slices, stored, word_hashes

BLOCK_TOKENS = 500_000
KEYS_PER_PARTITION = 500_000
START, END = np.uint64(1), np.uint64(2)     # stand for a text's start (a context only) and its end (a token)
RETAINED, DELETED, UNSEEN = 0, 1, 2         # a block's part: estimates, mixture weights, neither
BUCKETS = 24                                # context counts 0, 1, 2-3, 4-7, ...
STEPS = 4                                   # bins per doubling for the statistics of the mixture weights
DEFAULT = (0.5, 0.4, 0.1)


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, grouped by place, which compresses small numbers well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, len(b) // size).T).view(dtype).ravel()


def _blocks(docs: DataFrame, id_col: str, text_col: str, part: str) -> DataFrame:
    """(block, part, ids, lengths, tokens, words): tokens as places in the block's words, commonest first; START is last."""
    id_type = docs.schema[id_col].dataType

    def flush(number: int, role: int, ids: list, texts: list[np.ndarray], arrow_type) -> pa.RecordBatch:
        words, tokens, counts = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.array([ids], pa.list_(arrow_type)),
             pa.array([planes(np.array([len(t) for t in texts], np.uint32))], pa.binary()),
             pa.array([planes(place[tokens])], pa.binary()),
             pa.array([np.append(words[order], START).tobytes()], pa.binary())],
            names=["block", "part", "ids", "lengths", "tokens", "words"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        open_ids, open_texts, sizes = ([[], [], []] for _ in range(3))
        sizes = [0, 0, 0]
        kind = None
        for batch in slices(batches):
            kind = batch.schema.types[0]
            for i, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                t = np.append(word_hashes(text), END)
                open_ids[role].append(i)
                open_texts[role].append(t)
                sizes[role] += len(t)
                if sizes[role] >= BLOCK_TOKENS:
                    yield flush(number, role, open_ids[role], open_texts[role], kind)
                    number += 1
                    open_ids[role], open_texts[role], sizes[role] = [], [], 0
        for role in range(3):
            if open_ids[role]:
                yield flush(number, role, open_ids[role], open_texts[role], kind)
                number += 1

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(id_type)),
                           *(T.StructField(c, T.BinaryType()) for c in ("lengths", "tokens", "words"))])
    return docs.select(id_col, part, text_col).mapInArrow(lean(run), schema)


class Block:
    """One block's distinct words and bigrams, each in hash order, with the block's counts."""

    def __init__(self, lengths: bytes, tokens: bytes, words: bytes):
        self.lengths = unplanes(lengths, np.uint32).astype(np.int64)
        self.tokens = unplanes(tokens, np.uint32).astype(np.int64)
        self.words = np.frombuffer(words, np.uint64)
        n = len(self.words)
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([[n - 1], self.tokens[:-1]])
        before[self.first] = n - 1
        pairs, self.pair, self.pair_counts = np.unique(before * n + self.tokens, return_inverse=True, return_counts=True)
        self.context, self.word = np.divmod(pairs, n)
        self.pair_keys = chain([self.words[self.context], self.words[self.word]])
        self.word_counts = np.bincount(self.tokens, minlength=n)
        self.word_counts[n - 1] = len(self.lengths)

    def levels(self):
        return (1, self.words, self.word_counts), (2, self.pair_keys, self.pair_counts)

    def spread(self, level: int, ordered: np.ndarray) -> np.ndarray:
        """Values given in hash order, put in the block's own order."""
        keys = self.words if level == 1 else self.pair_keys
        out = np.empty(len(keys), np.int64)
        out[np.argsort(keys, kind="stable")] = ordered
        return out


KEY_SCHEMA = "level int, p int, block long, part int, first binary, gaps binary, counts binary"
COUNT_SCHEMA = ("level int, p int, block long, part int, total binary, retained binary, "
                "n long, n_retained long, v long, v_retained long")


def _requests(blocks: DataFrame, partitions: int) -> DataFrame:
    """One row per block, level and partition: the distinct keys there (sorted, as gaps) and the block's counts."""
    width = (1 << 64) // partitions + 1

    def run(batches):
        for batch in batches:
            for block, part, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for level, keys, counts in Block(*data).levels():
                    order = np.argsort(keys, kind="stable")
                    keys, counts = keys[order], counts[order]
                    edges = np.searchsorted(keys, np.array([p * width for p in range(1, partitions)], np.uint64))
                    for p, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges), strict=True)):
                        if len(k):
                            rows.append((level, p, block, part, k[:1].tobytes(), planes(np.diff(k)), planes(c.astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(),
                                                    pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    names=[x.split()[0] for x in KEY_SCHEMA.split(", ")])

    return blocks.select("block", "part", "lengths", "tokens", "words").mapInArrow(lean(run), KEY_SCHEMA)


def _totals(table: pa.Table) -> pa.Table:
    """The counts of one partition's keys over all blocks, in each block's order."""
    release()       # a worker serves many groups
    level, p = table.column("level")[0].as_py(), table.column("p")[0].as_py()
    part = table.column("part").to_pylist()
    keys = [np.cumsum(np.concatenate([np.frombuffer(f, np.uint64), unplanes(g, np.uint64)]), dtype=np.uint64)
            for f, g in zip(table.column("first").to_pylist(), table.column("gaps").to_pylist(), strict=True)]
    counts = np.concatenate([unplanes(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.float64)
    role = np.repeat(part, [len(k) for k in keys])
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    retained = np.bincount(at, counts * (role == RETAINED), len(known)).astype(np.int64)
    total = retained + np.bincount(at, counts * (role == DELETED), len(known)).astype(np.int64)
    tokens = known != START if level == 1 else np.zeros(len(known), bool)
    sums = [int(x[tokens].sum()) for x in (total, retained, total > 0, retained > 0)]
    ends = np.cumsum([len(k) for k in keys])
    mine = [at[e - len(k):e] for e, k in zip(ends, keys, strict=True)]
    n = len(keys)
    return pa.table({
        "level": pa.array([level] * n, pa.int32()), "p": pa.array([p] * n, pa.int32()), "block": table.column("block"),
        "part": pa.array(part, pa.int32()), "total": pa.array([planes(total[m]) for m in mine], pa.binary()),
        "retained": pa.array([planes(retained[m]) if r == DELETED else b"" for m, r in zip(mine, part, strict=True)], pa.binary()),
        **{c: pa.array([s] + [0] * (n - 1), pa.int64()) for c, s in zip(("n", "n_retained", "v", "v_retained"), sums, strict=True)}})


def _answers(block: Block, counts: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of the block's words and bigrams."""
    rows = sorted(zip(counts.column("level").to_pylist(), counts.column("p").to_pylist(),
                      counts.column(column).to_pylist(), strict=True), key=lambda r: r[:2])
    one, two = (np.concatenate([unplanes(r[2], np.int64) for r in rows if r[0] == level]) for level in (1, 2))
    return block.spread(1, one), block.spread(2, two)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def mixture_weights(cells: list, uniform: float, rounds: int = 200) -> np.ndarray:
    """Per bucket the weights of bigram, unigram and uniform estimate: expectation-maximisation.

    ``cells``: (bucket, bin of the bigram estimate, bin of the unigram
    estimate, held-out count); a null bin is an estimate of 0. A bucket
    without counts takes the weights of the next lower one.
    """
    out = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    for b in range(BUCKETS):
        mine = [c for c in cells if c[0] == b]
        if not mine:
            out[b] = out[b - 1] if b else out[b]
            continue
        p = np.array([[0 if x is None else 2.0 ** (x / STEPS) for x in c[1:3]] + [uniform] for c in mine])
        n = np.array([c[3] for c in mine], float)
        w = np.array(DEFAULT)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            new = (n @ share) / n.sum()
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        out[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    return out


def _bins(p: np.ndarray) -> pa.Array:
    with np.errstate(divide="ignore"):
        return pa.array(np.round(np.log2(p) * STEPS).clip(-10_000, 0).astype(np.int32), mask=p <= 0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the whole text's words (A-Z lower-cased) and one end. Learned
    from are the rows whose crc32(id as text) mod 7 is not 2; of those,
    remainder 3 is deleted from the estimates while the mixture weights of
    each context-frequency bucket are learned on its counts, and counted
    again for the final ones. ``score`` is the sum of log10 P(word | word
    before), ``base_score`` that of log10 (c + 1) / (N + V + 1). Null and
    empty texts are their end alone. A null id is held out. Repeated rows
    count and are scored each. Other columns are not read.
    """
    spark = docs.sparkSession
    part = F.when(fold("id", 7) == 2, UNSEEN).when(fold("id", 7) == 3, DELETED).when(F.col("id").isNull(), UNSEEN)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "part", part.otherwise(RETAINED).cast("int"))
    blocks = stored(_blocks(rows, "id", "text", "part"), "blocks")
    tokens = blocks.agg(F.sum(F.length("tokens") / 4)).first()[0] or 0
    partitions = int(tokens // KEYS_PER_PARTITION) + 1
    counts = stored(_requests(blocks, partitions).groupBy("level", "p").applyInArrow(_totals, COUNT_SCHEMA), "counts")
    n, n_retained, v, v_retained = (counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in
                                                 ("n", "n_retained", "v", "v_retained"))).first())
    answers = counts.select("block", "level", "p", "part", "total", "retained")

    def statistics(key, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        block = Block(*(left.column(c)[0].as_py() for c in ("lengths", "tokens", "words")))
        one, two = _answers(block, right, "retained")
        context = one[block.context]
        return pa.table({"bucket": pa.array(bucket(context), pa.int32()),
                         "two": _bins(two / np.maximum(context, 1)),
                         "one": _bins(one[block.word] / max(n_retained, 1)),
                         "n": pa.array(block.pair_counts, pa.int64())}).group_by(["bucket", "two", "one"]).aggregate(
            [("n", "sum")]).rename_columns(["bucket", "two", "one", "n"])

    deleted = F.col("part") == DELETED
    cells = (blocks.where(deleted).select("block", "lengths", "tokens", "words").groupBy("block")
             .cogroup(answers.where(deleted).groupBy("block"))
             .applyInArrow(statistics, "bucket int, two int, one int, n long")
             .groupBy("bucket", "two", "one").agg(F.sum("n")).collect())
    weights = mixture_weights([tuple(c) for c in cells], 1 / (v_retained + 1))

    def scores(key, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        block = Block(*(left.column(c)[0].as_py() for c in ("lengths", "tokens", "words")))
        one, two = _answers(block, right, "total")
        context = one[block.context]
        w = weights[bucket(context)]
        w = np.where((context > 0)[:, None], w, w * [0, 1, 1] / w[:, 1:].sum(1, keepdims=True))
        unigram = one / n if n else np.zeros(len(one))
        if not n:
            w = np.array([[0, 0, 1.0]])
        p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * unigram[block.word] + w[:, 2] / (v + 1)
        base = np.log10((one + 1) / (n + v + 1))
        add = lambda x: np.add.reduceat(x, block.first)
        m = len(block.lengths)
        return pa.table({
            "id": left.column("ids").combine_chunks().flatten(),
            "held_out": pa.array([left.column("part")[0].as_py() == UNSEEN] * m),
            "n_tokens": pa.array(block.lengths), "n_known": pa.array(add((one[block.tokens] > 0).astype(np.int64))),
            "train_tokens": pa.array([n] * m, pa.int64()), "base_score": pa.array(add(base[block.tokens])),
            "score": pa.array(add(np.log10(p)[block.pair]))})

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    out = (blocks.select("block", "ids", "part", "lengths", "tokens", "words").groupBy("block")
           .cogroup(answers.drop("retained").groupBy("block")).applyInArrow(scores, schema))
    return out.withColumnRenamed("id", id_col)
