"""Greedy word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexgiving.llm.common import WordCache
from hexgiving.llm.tokenizer import ALPHABET

_automata: dict = {}


class Automaton:
    """Vocabulary trie with failure links and popped-token counts.

    A failure link leads from what has been read to what is left of it once
    the longest pieces at its front are taken off; ``popped`` is the number
    of those pieces. A word's greedy longest-match length then takes one pass
    without going back and without building a piece. A word that no pieces
    make counts as one unknown token.
    """

    def __init__(self, pieces: list[bytes]):
        self.child: dict[int, int] = {}     # node * 256 + byte -> node
        self.fail: list[int | None] = [None]
        self.popped = [0]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node * 256 + byte
                if key not in self.child:
                    self.child[key] = len(ends)
                    ends.append(False)
                    self.fail.append(None)
                    self.popped.append(0)
                node = self.child[key]
            ends[node] = node > 0
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in self.child.items():
            below[key >> 8].append((key & 255, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below[parent]:
                queue.append(node)
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at is not None and at * 256 + byte not in self.child:
                    at, count = self.fail[at], count + self.popped[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.child[at * 256 + byte], count

    def length(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for byte in word:
            while (following := child.get(node * 256 + byte)) is None:
                if fail[node] is None:
                    return 1
                count += popped[node]
                node = fail[node]
            node = following
        while node:
            if fail[node] is None:
                return 1
            count += popped[node]
            node = fail[node]
        return count


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary as bytes; a leading blank marks a word's first piece."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in ALPHABET.items()}
    return [bytes(back[c] for c in p) for p in pieces if all(c in back for c in p)]


class Counter:
    """Tokens of a text: its words (runs without white space), each with the word mark in front."""

    def __init__(self, path: str):
        automaton = Automaton(vocabulary(path))
        self.lengths = WordCache(lambda word: automaton.length(b" " + word))

    def count(self, text: bytes | None) -> tuple[int, int]:
        words = (text or b"").split()
        return len(words), sum(map(self.lengths.__getitem__, words))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens (greedy longest-match pieces of the whole text).

    Null, empty and blank texts: 0 and 0. A null id is kept, repeated rows
    count each. Other columns are not read. No shuffle.
    """
    def run(batches):
        if vocabulary_path not in _automata:
            _automata[vocabulary_path] = Counter(vocabulary_path)
        counter = _automata[vocabulary_path]
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))],
                names=["id", "n_words", "n_tokens"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
