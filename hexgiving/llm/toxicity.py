"""Toxicity scores on deobfuscated text: a noisy channel decoded by Viterbi under a character language model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import WordCache, fold, lean, release, slices, stored

# The letters of the character model (position 0: edge of a word) ...
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 1
# ... and what a sign can stand for. A sign between letters may also stand for nothing.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou"}
SEPARATORS = ".-_*'`~,:;/\\"
SWAP = SILENT = math.log(0.9)
DOUBLE, LONG = (math.log(0.98), math.log(0.02)), (math.log(0.05), math.log(0.95))     # keep or drop a repeated character

SAMPLE_ROWS = 20_000        # labelled rows that the classifier is fitted on, at most about
CACHED = 100_000            # entries of a worker's word cache; results do not depend on it
SHORT = 30                  # a text counts as having this many words at least, so one weak word is no verdict
MIN_TOXIC, MIN_WEIGHT = 5, 2.0      # a feature needs so many toxic documents and this log lift
GRAM = 4

INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(257, np.int32)
for _c, _i in INDEX.items():
    _TABLE[ord(_c)] = _i
SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
RUN = re.compile(r"(.)\1\1")
EDGE = ".,;:?\"'()[]{}<>|"
JUNK = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")       # a run of one sign at an end


def character_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(code, n): letter trigrams of all texts, with word edges; at most ``SIZE ** 3`` rows."""
    def run(batches):
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                cp = np.frombuffer(f"\n{(text or '').lower()}\n".encode("utf-32-le"), "<u4")
                s = _TABLE[np.minimum(cp, 256)]
                b, c = s[:-1], s[1:]
                a = np.where(b == 0, 0, np.concatenate([[0], s[:-2]]))
                total += np.bincount((a * SIZE + b) * SIZE + c, minlength=SIZE ** 3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code])], names=["code", "n"])

    return (docs.select(text_col).mapInArrow(lean(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")))


def character_model(rows: list, weight: float = 5.0) -> np.ndarray:
    """log P(c | a, b) for all letter pairs, each order backed by the lower one."""
    n = np.zeros(SIZE ** 3)
    for r in rows:
        n[r[0]] = r[1]
    n = n.reshape(SIZE, SIZE, SIZE)
    n[0, 0, 0] = 0
    one = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
    two = n.sum(0)
    two = (two + weight * one) / (two.sum(1, keepdims=True) + weight)
    three = (n + weight * two) / (n.sum(2, keepdims=True) + weight)
    return np.log(three)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for ("" for nothing) with the channel's log probability."""
    out: list[list[tuple[str, float]]] = []
    previous = ""
    for at, ch in enumerate(token):
        options = [(ch, 0.0)] if ch in INDEX else [(x, SWAP - math.log(len(LEET[ch]))) for x in LEET.get(ch, "")]
        if ch == previous and options:
            keep, drop = LONG if token[at - 2:at] == ch * 2 or token[at + 1:at + 2] == ch else DOUBLE
            options = [(x, p + keep) for x, p in options] + [("", drop)]
        if ch in SEPARATORS or not options:
            options = [*options, ("", SILENT)]
        out.append(options)
        previous = ch
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token: Viterbi over the lattice, state = last two letters."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letter, cost in options:
                if letter:
                    c = INDEX[letter]
                    state, value, so_far = (b, c), score + cost + model[a, b, c], text + letter
                else:
                    state, value, so_far = (a, b), score + cost, text
                if state not in following or value > following[state][0]:
                    following[state] = (value, so_far)
        states = following
    return max(((score + model[a, b, 0], text) for (a, b), (score, text) in states.items()))[1]


def disguised(token: str) -> bool:
    """Letters mixed with signs inside, or a letter three times running."""
    letters = sum(c in INDEX for c in token)
    return letters > 0 and letters < len(token) or bool(RUN.search(token))


def restored(token: str, model: np.ndarray) -> list[str]:
    """The words that a lower-case token may mean: its letters, and its decoding if it looks disguised."""
    core = JUNK.sub("", token.strip(EDGE)).strip(EDGE)
    plain = core.rstrip("!")
    words = [plain] if plain.isalpha() else []
    if disguised(plain):
        best = decode(core, model)
        if len(best) > 2:
            words.append(best)
    return words


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case tokens, and each spaced-out run of single characters put together."""
    low = (text or "").lower()
    found = set(low.split())
    found.update(m[0].replace(" ", "") for m in SPACED.finditer(low))
    return found


def features(word: str) -> list[str]:
    """The word itself and its letter runs, with its edges marked."""
    w = f"^{word}$"
    return [w, *(w[i:i + GRAM] for i in range(len(w) - GRAM + 1))]


@dataclass
class Model:
    """Character model, weights of toxic features, and the calibration of document scores."""

    characters: np.ndarray
    weights: dict[str, float]
    calibration: np.ndarray
    cache: WordCache | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def weight(self, token: str) -> float:
        return max((self.word_weight(w) for w in restored(token, self.characters)), default=0.0)

    def word_weight(self, word: str) -> float:
        """The word's own weight, or the mean over its letter runs, so that a run that clean words share tells little."""
        own, *runs = (self.weights.get(f, 0.0) for f in features(word))
        return max(own, math.fsum(runs) / max(len(runs), 1))

    def measures(self, text: str | None) -> list[float]:
        """Strongest token, summed strength, summed strength for the text's size, 1."""
        if self.cache is None:
            self.cache = WordCache(self.weight, CACHED)
        return measures([self.cache[t] for t in tokens(text)])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.measures(text), self.calibration))
        if not math.isfinite(z):
            raise ValueError(f"score of a text is not finite: {z}")
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def measures(weights: list[float]) -> list[float]:
    """Of a text's distinct tokens: strongest, summed strength, summed strength for the text's size, 1."""
    total = math.log1p(math.fsum(weights))
    return [max(weights, default=0.0), total, total / math.log(max(len(weights), SHORT) + 2), 1.0]


def _loss(x: np.ndarray, y: np.ndarray, beta: np.ndarray, ridge: float) -> float:
    z = x @ beta
    return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * beta @ beta)


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by damped Newton steps: a step is halved until it lowers the penalised loss."""
    if not np.isfinite(x).all():
        raise ValueError("measures of toxicity are not finite")
    beta = np.zeros(x.shape[1])
    beta[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    loss = _loss(x, y, beta, ridge)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        slope = x.T @ (p - y) + ridge * beta
        step = -np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), slope)
        size = 1.0
        while size > 1e-10 and not (after := _loss(x, y, beta + size * step, ridge)) <= loss + 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-10:
            break
        beta, loss = beta + size * step, after
        if np.abs(size * step).max() < 1e-9:
            break
    if not np.isfinite(beta).all():
        raise ValueError("the calibration of toxicity scores did not converge")
    return beta


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model: characters on all texts, the rest on labelled rows for which ``train`` holds.

    Labels reach the model only through those rows; about ``sample_rows`` of
    them at most, chosen by a hash of id and text, each text of an id once. Toxic words and letter runs are those whose
    share among toxic documents' words stands out against clean ones'. The
    document score is calibrated on each half of the sample with the features
    that the other half finds. Null ids and labels are left out; an id labelled twice is
    toxic if one label says so. Without usable labels every score is low. A
    fit that is not finite is an error.
    """
    spark = docs.sparkSession
    model = Model(character_model(character_counts(docs, text_col).collect()), {}, np.array([1.0, 1.0, 1.0, -6.0]))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = (known if train is None else known.where(train)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("y"))
    n = docs.select(F.col(id_col).alias("id")).join(known, "id").count()
    parts = 1_000_000
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id", "text"), F.lit(parts))
    drawn = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .where(draw < min(parts, parts * sample_rows // max(n, 1))))
    # copies merge before the shuffle, so one row repeated any number of times is drawn once
    texts = stored(drawn.join(known, "id").groupBy("id", F.xxhash64("text").alias("tie")).agg(
        F.any_value("y").alias("y"), F.any_value("text").alias("text")).select(
        F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int").alias("half"), "y", "text"), "labelled")
    shared = spark.sparkContext.broadcast(model.characters)

    def words(batches):
        cache = WordCache(lambda t: restored(t, shared.value), CACHED)
        for batch in slices(batches):
            rows, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = {w for t in tokens(text) for w in cache[t]}
                out += found
                rows += [i] * len(found)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.string())],
                                             names=["half", "y", "word"])

    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1))),
                        lambda i: F.substring(marked, i, F.lit(GRAM)))
    by_word = stored(texts.mapInArrow(lean(words), "half int, y int, word string").groupBy("word").agg(
        *(F.count_if((F.col("half") == h) & (F.col("y") == y)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1))), "words")
    counts = [f"n{h}{y}" for h in (0, 1) for y in (0, 1)]
    by_feature = stored(by_word.select(F.explode(F.array_distinct(F.concat(F.array(marked), grams))).alias("f"), *counts)
                        .groupBy("f").agg(*(F.sum(c).alias(c) for c in counts))
                        .where(F.col("n01") + F.col("n11") >= MIN_TOXIC), "features")
    totals = by_word.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).first()

    def weights(halves: tuple[int, ...]) -> dict[str, float]:
        """Log lift of each feature's share among toxic documents' words, less one standard error of its count."""
        clean, toxic = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (0, 1))
        all_clean, all_toxic = (sum(totals[f"n{h}{y}"] for h in halves) for y in (0, 1))
        if not all_clean or not all_toxic:
            return {}
        lift = F.log((toxic - F.sqrt(toxic)) / F.lit(all_toxic) * F.lit(all_clean) / (clean + 1))
        strong = by_feature.where(toxic >= MIN_TOXIC).select("f", lift.alias("w")).where(F.col("w") > MIN_WEIGHT)
        return {r["f"]: r["w"] for r in strong.collect()}

    # each half is measured with the other half's features; a token is decoded once for both
    halves = spark.sparkContext.broadcast([Model(model.characters, weights((1 - h,)), model.calibration) for h in (0, 1)])

    def measured(batches):
        one, two = halves.value
        cache = WordCache(lambda t: (one.weight(t), two.weight(t)), CACHED)
        for batch in slices(batches):
            x = [measures([cache[t][h] for t in tokens(text)])
                 for h, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = texts.mapInArrow(lean(measured), "y int, x array<double>").collect()       # sample_rows at most
    model.weights = weights((0, 1))
    y = np.array([r["y"] for r in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        model.calibration = _calibrate(np.array([r["x"] for r in rows], float), y)
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score of 0 to 1 for each whole text; a column named ``out`` is replaced.

    Null and empty texts have no words and share the score of such. No
    shuffle; rows are scored by themselves, so ties and repeats agree. Only
    texts go to the Python workers and only scores come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")
        finally:
            shared.value.cache = None
            release()

    return docs.drop(out).withColumn(out, score(F.col(text_col)))


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned from."""
    return fold(id_col, 4) != 2
