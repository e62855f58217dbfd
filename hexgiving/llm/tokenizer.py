"""Exact tokenizer ids through a per-worker cache of word chunks."""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from array import array

import regex
from hexgiving.llm.common import WordCache

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# White space other than blank and newline, whose runs could reach over a chunk's edge; looking for one character
# after the other is faster than one pattern.
OTHER_SPACE = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]
# Outside these characters case folding and composition are left to the library.
LATIN = re.compile(r"[\0-\u024f]*")
# The word pattern and the byte alphabet of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
BLANK = ALPHABET[32]
MARKS = string.punctuation      # a run of them with no letter behind is one word of the pattern
_encoders: dict = {}


class Encoder:
    """``encode(texts)``: the ids as little-endian uint32 bytes, equal to the library's on each whole text.

    Byte-level tokenizers split words before they merge, and no word reaches
    over the place between a non-blank and a following blank or newline. So
    the ids of a text are those of its chunks (white space, then the rest)
    put together; each chunk's words go to the library's merge model once and
    are kept in a bounded cache. Texts with other white space, chunks beyond
    Latin letters and tokenizers of another kind are encoded by the library
    as a whole, and so are texts that hold an added token. With ``special``
    (the library's default) strings of special tokens give their ids, else
    they are ordinary text. Null: no ids.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        self.pattern, self.lower = self._words(kind["normalizer"], kind["pre_tokenizer"])
        added = [t for t in kind["added_tokens"] if special or not t["special"]]
        self.added = [t["content"] for t in added]
        if any(t["normalized"] for t in added):     # these also match other spellings
            self.pattern = None
        self.cache, self.word_cache = WordCache(self._chunk, 250_000), WordCache(self._word, 50_000)

    @staticmethod
    def _words(normal: dict | None, split: dict | None):
        """The pattern of the words, and whether they are lower-cased; no pattern: another kind."""
        if normal is None and split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            return regex.compile(BYTE_LEVEL), False
        steps = (split or {}).get("pretokenizers", [])
        if [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and \
                normal["normalizers"][1]["content"] == " " and [x["type"] for x in steps] == ["Split", "ByteLevel"] and \
                steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]:
            return regex.compile(steps[0]["pattern"]["Regex"]), True
        return None, False

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str) -> bytes:
        # the alphabet shows letters as themselves
        shown = word if word.isascii() and word.isalpha() else "".join(map(ALPHABET.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not self.lower and chunk[0] == " " and chunk.isascii():
            # the commonest kinds, at once: a blank and letters, and marks behind them
            word = chunk[1:]
            if word.isalpha():
                return array("I", [t.id for t in self.tokenize(BLANK + word)]).tobytes()
        elif self.lower and chunk.isascii():
            # the commonest kind, at once: a blank and letters
            chunk = chunk.lower()
            if chunk[0] == " " and chunk[1:].isalpha():
                return array("I", [t.id for t in self.tokenize(chunk[1:])]).tobytes()
        elif not chunk.isascii():
            if not LATIN.fullmatch(chunk):
                return self.whole(chunk)
            if self.lower:
                chunk = unicodedata.normalize("NFC", chunk).lower()
        if chunk[0] == " " and chunk[1:].isalpha():
            return self._word(chunk[1:] if self.lower else chunk)
        if not self.lower and chunk[0] == " " and (word := chunk.rstrip(MARKS))[1:].isalpha():
            # a word and marks behind it: two words of the pattern, of which the first is often known
            return self.cache[word] + self.word_cache[chunk[len(word):]]
        words = self.pattern.findall(chunk)
        if self.lower:      # plain words are in the cache as they stand after a blank
            return b"".join([self.word_cache[w] if len(w) <= 3 else self.cache[" " + w] if w.isascii() and w.isalpha() else self._word(w)
                             for w in words])
        return b"".join([self._word(w) if len(w) > 3 else self.word_cache[w] for w in words])

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern is None or any(map(text.__contains__, OTHER_SPACE)) or "\0" in text or any(t in text for t in self.added):
            return self.whole(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            chunks = CHUNK.findall(text)
        else:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            if not chunks[0]:
                del chunks[0]
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(t) for t in texts]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file: ids as the library gives them by default."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, special=True)
    return _encoders[path]


def forget_words() -> None:
    """Empty the word caches of the worker's encoders: for the job step after encoding, which needs the memory."""
    for e in _encoders.values():
        for cache in (e.cache, e.word_cache):
            cache.empty()
