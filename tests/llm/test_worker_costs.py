"""What a worker computes again or keeps between tasks."""

import numpy as np
import pyarrow as pa
import pytest

from hexgiving.llm import common, interpolation, tokenizer


def test_a_word_is_merged_once_whatever_marks_are_around_it():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    e = tokenizer.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, merge = [], e.tokenize
    e.tokenize = lambda w: asked.append(w) or merge(w)
    text = " Zyxwab zyxwab. (zyxwab) zyxwab,zyxwab\nzyxwab  zyxwab Étézy"
    plain = text.replace(" ", "")
    assert e.encode([plain]) == [e.whole(plain)] and asked.count("zyxwab") <= 2     # the line's first one stands for itself
    assert e.encode([text]) == [e.whole(text)]


def test_every_other_space_is_known():
    assert all((c in tokenizer.OTHER_SPACE) == (c.isspace() and c not in " \n") for c in map(chr, range(0x110000)))


def test_language_model_workers_keep_no_words():
    def fill():
        common.word_hashes(b"some words")
        assert len(common.WORD_HASHES)
    fill()
    one, ones = interpolation.planes(np.array([], np.uint64)), interpolation.planes(np.array([3], np.uint32))
    out = interpolation._totals(pa.table({
        "level": pa.array([2], pa.int32()), "p": pa.array([0], pa.int32()), "block": [7], "part": pa.array([0], pa.int32()),
        "first": [np.array([9], np.uint64).tobytes()], "gaps": [one], "counts": [ones]}))
    assert interpolation.unplanes(out.column("total")[0].as_py(), np.int64).tolist() == [3] and not len(common.WORD_HASHES)


def test_a_byte_level_word_is_merged_once_whatever_marks_follow():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    e = tokenizer.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, merge = [], e.tokenize
    e.tokenize = lambda w: asked.append(w) or merge(w)
    text = " zyxwab zyxwab. zyxwab, zyxwab?! zyxwab&&& zyxwab' zyxwab##########"
    assert e.encode([text]) == [e.whole(text)] and asked.count(tokenizer.BLANK + "zyxwab") == 1
    odd = [f"{a}{w}{m}" for a in ("", " ", "\n", "(") for w in ("", "zyx", "Été", "don't", "z9", "中", "²") for m in
           (*tokenizer.MARKS, "'s", "''s", ".'ll", "'.", ".é", "²", "9.", "._", "…")]
    texts = [*odd, *(f"a{t} b{t} c" for t in odd), "".join(odd)]
    assert e.encode(texts) == [e.whole(t) if t else b"" for t in texts]
