"""Spelling variants by permuterm rotations: words that differ by one code point, their forms and roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgiving.llm.common import stored

MARK = "\0"         # ends a word in its rotations; words must not hold it
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = r"[a-zÀ-ÿ]"


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5) -> DataFrame:
    """(id, run): every maximal run of Latin letters (to U+00FF) of at least ``least_length``, A-Z lower-cased.

    Whole texts are read; null and empty ones give no rows. Repeated rows count each.
    """
    lower = F.translate(F.col(text_col), UPPER, UPPER.lower())
    runs = F.regexp_extract_all(lower, F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))


def slipped(run: Column, key: Column, every: int) -> Column:
    """``run`` without one code point where ``every`` divides the crc32 of ``key:run``: repeatable slips of the pen.

    The crc32 modulo the run's length is the place from 0. A null key is an empty text.
    """
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(words: DataFrame, word_col: str = "word", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least so many code points and occurrences. Partial counts precede the shuffle."""
    return (words.select(F.col(word_col).alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, opens, word, n): the rotations of each marked word, cut before the code point that an edit touches.

    A word x c y gives, for each code point c, the rotation y MARK x c; its
    ``prefix`` y MARK x skips c. Words with one prefix differ by a replacement
    there. The whole rotation y MARK x of the word x y (``edited`` false)
    sorts right before that range: the range's words are x y with c inserted.
    ``opens``: c differs from the code point before it. Deleting any of a run
    of equal ones gives the same word, so only the run's first counts.
    """
    word, size = F.col("word"), F.length("word")

    def at(i: Column, skipped: int) -> Column:
        return F.concat(F.substr(word, i + (skipped + 1)), F.lit(MARK), F.substr(word, F.lit(1), i))

    edited = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        at(i, 1).alias("prefix"), F.lit(True).alias("edited"),
        ((i == 0) | (F.substr(word, i + 1, F.lit(1)) != F.substr(word, i, F.lit(1)))).alias("opens")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        at(i, 0).alias("prefix"), F.lit(False).alias("edited"), F.lit(False).alias("opens")))
    return (words.where(size > 0).select("word", "n", F.explode(F.concat(edited, whole)).alias("r"))
            .select("r.prefix", "r.edited", "r.opens", "word", "n"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of distinct words: how many are one code point away, and the one of largest n.

    Ties of n go to the smallest in code-point order; a word with no neighbour
    has 0 and nulls. Rotations are dealt by prefix and sorted within it, so a
    group is the words of one prefix range: at most two for each code point
    that occurs there, however many words there are. The scan gives each row
    its group's count and its best other member; no pairs leave a group.
    """
    group = Window.partitionBy("prefix")
    # the smallest of these is the word of largest n, ties to the smallest word
    rank = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    edited, opening = F.when(F.col("edited"), rank), F.when(F.col("opens"), rank)
    scanned = rotations(words).select(
        "word", "n", "edited", "opens", rank.alias("own"), edited.alias("same_length"),
        F.count(edited).over(group).alias("n_edited"), F.count(opening).over(group).alias("n_opening"),
        F.min(edited).over(group).alias("first"), F.min(opening).over(group).alias("longer"),
        F.min(F.when(~F.col("edited"), rank)).over(group).alias("shorter"), "prefix")
    second = F.min(F.when(F.col("same_length") != F.col("first"), F.col("same_length"))).over(group)
    scanned = scanned.withColumn("second", second)
    shorter = F.when(F.col("opens"), F.col("shorter"))
    found = scanned.select(
        "word",
        F.when(F.col("edited"), F.col("n_edited") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
        .otherwise(F.col("n_opening")).alias("n_near"),
        F.when(F.col("edited"), F.least(F.when(F.col("first") == F.col("own"), F.col("second")).otherwise(F.col("first")), shorter))
        .otherwise(F.col("longer")).alias("best")).where("n_near > 0")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"),
        (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows without cycles: the last form reached. Pointers double, so rounds are few.

    Each round's table is written to shared storage; a form that many words share is one row on its side of the join.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of distinct (word, n).

    A word's form is its near word of largest n, if that n is at least
    ``times`` the word's own; else null. The root follows forms to the last
    one, and is the word itself if it has none. Forms grow in n, so there are no cycles.
    """
    near = stored(neighbours(stored(words, "words")), "near-words")
    has = F.col("near_n") >= times * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    return (forms.join(roots(forms.where("form IS NOT NULL")), "word", "left")
            .withColumn("root", F.coalesce("root", "word")))
