"""Substring dedup by unit hashing: every repeated line, sentence or run of short sentences keeps only its earliest occurrence."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgiving.llm.common import lean, slices, stored

# A line is a unit; a line of several sentences is a paragraph and gives one unit for each sentence.
UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
NOISE = regex.compile(r"[^\p{L}\p{N}]+")
MIN_WORDS = 8       # shorter units (headings, stock phrases) repeat by chance and are left alone
# For passages: sentences also end at the full stops of scripts without blanks, whose letters count as words.
SENTENCE = re.compile(r"[^.!?\u3002\uff01\uff1f\uff61\n]*[.!?\u3002\uff01\uff1f\uff61\n]+|[^.!?\u3002\uff01\uff1f\uff61\n]+")
_LETTER = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
UNSPACED, WORD = regex.compile(f"[{_LETTER}]"), regex.compile(f"[{_LETTER}]|[^ {_LETTER}]+")


def normalise(unit: str) -> str:
    """Lower case, everything but letters and digits to single blanks."""
    return NOISE.sub(" ", unit.lower()).strip()


def sentences(text: str, min_words: int):
    """(start, end, n_words, normalised) of each sentence of at least ``min_words`` blank-separated words."""
    for m in UNIT.finditer(text):
        if m.end() - m.start() < 2 * min_words - 1:
            continue
        norm = normalise(m[0])
        n = norm.count(" ") + 1
        if n >= min_words and norm:
            yield m.start(), m.end(), n, norm


def passages(text: str, min_words: int):
    """(start, end, n_words, normalised) of each sentence of at least ``min_words`` words, and of short ones with neighbours.

    A shorter sentence gives two units: the shortest run of sentences from
    it on, and the shortest run up to it, that have ``min_words`` words. So a
    run of whole sentences (a line, a paragraph) of that many words in all is
    covered by units inside it, however short its sentences are.
    """
    parts = []
    for m in SENTENCE.finditer(text):
        norm = normalise(m[0])
        if norm:
            spaced = norm.isascii() or not UNSPACED.search(norm)
            parts.append((m.start(), m.end(), norm.count(" ") + 1 if spaced else len(WORD.findall(norm)), norm))
    runs = set()
    for i, (_, _, n, _) in enumerate(parts):
        for step, edge in ((1, len(parts) - 1), (-1, 0)):
            j, total = i, n
            while total < min_words and j != edge:
                j += step
                total += parts[j][2]
            if total >= min_words:
                runs.add((min(i, j), max(i, j)))
    for i, j in sorted(runs):
        yield (parts[i][0], parts[j][1], sum(p[2] for p in parts[i:j + 1]),
               parts[i][3] if i == j else " ".join([p[3] for p in parts[i:j + 1]]))


def units(docs: DataFrame, id_col: str, text_col: str, min_words: int, split=passages) -> DataFrame:
    """(id, text_hash, start, end, n_words, digest): units of the whole texts, offsets in code points."""
    def run(batches):
        for batch in slices(batches):
            rows, start, end, n_words, digest = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for first, last, n, norm in split(text or "", min_words):
                    rows.append(i)
                    start.append(first)
                    end.append(last)
                    n_words.append(n)
                    digest.append(xxhash.xxh128_digest(norm.encode()))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()),
                 pa.array(end, pa.int32()), pa.array(n_words, pa.int32()), pa.array(digest, pa.binary())],
                names=["id", "text_hash", "start", "end", "n_words", "digest"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "n_words")),
                           T.StructField("digest", T.BinaryType())])
    return docs.select(F.col(id_col), F.xxhash64(text_col), text_col).mapInArrow(lean(run), schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, split=passages) -> DataFrame:
    """(id, text_hash, start, end, n_words, first_id, first_start): each unit that an earlier one equals.

    Units (``split``: ``passages``, which may overlap, or ``sentences``) rank
    by id (null last), text hash, then start (sentences: start, then text
    hash); the earliest of each digest is not listed, nor one that overlaps
    it. Null, empty or short texts have no units. Rows that repeat an id with
    the same text are one document: their units tie and neither counts
    against the other. Other columns are not read.

    The disk holds the units once more, see ``_not_first``.
    """
    found = _not_first(stored(units(docs, id_col, text_col, min_words, split), "units"), split)
    return found.select("id", "text_hash", "start", "end", "n_words", F.col("first.id").alias("first_id"),
                        F.col("first.start").alias("first_start"))


def _not_first(u: DataFrame, split) -> DataFrame:
    """The rows of ``u`` (units) that ``repeated_units`` lists, with ``first``: the earliest of their digest.

    ``u`` is shuffled once, by digest: the earliest of each and the join back
    both read that shuffle. For that, both must take all of its columns and
    rows, so the caller drops those it does not need, ``first`` holds the
    others, and what is never null is said to be so, or Spark adds it to one.
    Both stream a digest's rows, however many they are, in one task.
    """
    order = ["start", "text_hash"] if split is sentences else ["text_hash", "start"]
    rank = ["id", *order, "end"]
    rank = F.struct(F.col("id").isNull().alias("n"), *rank, *(c for c in u.columns if c not in [*rank, "digest"]))
    u = u.where("digest IS NOT NULL AND text_hash IS NOT NULL").repartition("digest")
    first = (u.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("k")).where("k > 1")
             .select("digest", "first"))
    return (u.join(first, "digest")
            .where("NOT (first.id <=> id AND start < first.end AND first.text_hash = text_hash)"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, split=passages) -> DataFrame:
    """``docs`` with the repeated units cut from the text, and their original offsets in ``removed``.

    Overlapping units are joined there. Every row stays, its text perhaps empty; ``removed`` is null where nothing
    went (a column of that name in the input is replaced). The rest as for
    ``repeated_units``.
    """
    @F.pandas_udf("array<struct<start: int, end: int>>")
    def join(spans):
        out = []
        for one in spans:
            whole = []
            for s in one:
                if whole and s["start"] < whole[-1]["end"]:
                    whole[-1]["end"] = max(whole[-1]["end"], s["end"])
                else:
                    whole.append({"start": s["start"], "end": s["end"]})
            out.append(whole)
        return type(spans)(out, dtype=object)

    u = stored(units(docs, id_col, text_col, min_words, split).drop("n_words"), "units")
    spans = (_not_first(u, split).groupBy("id", "text_hash")
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
             .select("id", "text_hash", join("spans").alias("spans")))

    @F.pandas_udf("string")
    def cut(text, cuts):
        out = []
        for t, c in zip(text, cuts, strict=True):
            if t is None or c is None:
                out.append(t)
                continue
            pieces, at = [], 0
            for s in c:
                pieces.append(t[at:s["start"]])
                at = s["end"]
            out.append("".join([*pieces, t[at:]]))
        return type(text)(out, dtype=object)

    kept = [c for c in docs.columns if c != "removed"]
    # the row as one struct: no name of the input meets one of the spans
    rows = docs.select(F.struct(*kept).alias("row"), F.xxhash64(text_col).alias("row_hash"))
    joined = rows.join(spans, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    text = F.col("row")[text_col]
    new = F.when(F.col("spans").isNull(), text).otherwise(cut(text, F.col("spans")))
    return joined.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in kept), F.col("spans").alias("removed"))
