"""Cases where an operator once did less than its whole job."""

import collections
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hexgiving.llm import bestfit, multiindex, substring, tiling, tokenbits, tokenizer, urlfilter
from hexgiving.session import shared_dir


def test_short_sentences_of_a_repeated_passage_go(spark):
    rng = random.Random(12)
    own = lambda n: " ".join(f"own{rng.randrange(10 ** 9)}" for _ in range(n))
    short = "Stop here. Dr. A. Bell said no! Why not? It was late. They ran. Wait for me! Nobody came. So it ends. Go home now. "
    lines = "one red house\ntwo blue doors\nthree old men\nfour more roads\n"
    han = "今天天气很好。我们去公园散步。你想一起来吗?当然可以。"
    docs = [(i, f"{own(20)}. {short}{own(20)}.\n{lines}{own(9)}.\n{han}{own(9)}. Thank you. {own(9)}.") for i in range(4)]
    # a run that overlaps its own first occurrence is no repeat of it
    docs += [(9, "No. " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring.remove_repeats(df).collect()}
    assert out[0]["text"] == docs[0][1] and out[0]["removed"] is None
    for i in (1, 2, 3):
        left = docs[i][1]
        for passage in (short, lines, han):
            left = left.replace(passage.strip(" "), "")
        assert out[i]["text"].split() == left.split()
        spans = [tuple(s) for s in out[i]["removed"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert out[9]["text"].split() == ["No."] * 8


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_texts_give_their_ids(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    special = {t["id"] for t in json.loads(library.to_str())["added_tokens"]}
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>x y\n<|endoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> c",
             "<|endof text|> d", "a\t<|endoftext|>  b", "plain words", "日本<|endoftext|> 語", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encoder(path).encode(texts)] == want
    assert sum(i in special for ids in want for i in ids) == (7 if len(special) == 1 else 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bestfit.pack_documents(df, path, 2, 1024, keep_ids=True).collect()}
    assert [got[i][:-1] for i in range(len(texts))] == want
    folder = shared_dir(spark, "special")
    tokenbits.write_tokens(df, folder, path, 50_257, 1)
    got = {r["id"]: r["ids"] for r in tokenbits.read_tokens(spark, folder, with_ids=True).collect()}
    assert [got[i][:-1] for i in range(len(texts))] == want


def test_only_the_covered_row_of_an_id_goes(spark, tmp_path):
    item = " ".join(f"t{i}" for i in range(30))
    rows = [(None, f"a b {item} c"), (None, "a clean text without an id"), (None, None), (5, item), (5, "another text of five"), (6, "six")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, left)) == sorted(str(Row(doc_id=i, text=t)) for i, t in rows if item not in (t or ""))


def test_a_small_table_gives_all_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(19)] + [(0, [1.0] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in multiindex.search(t, F.col("id") % 2 == 0, 20).collect():
        got[r["query_id"]].add(r["id"])
    assert got == {i: set(range(19)) - {i} for i in range(0, 19, 2)}


def test_url_aliases_in_any_attribute_order(spark):
    target = "http://a.com/de/1"
    html = [f'<meta content="0; url={target}" http-equiv="refresh">', f'<meta http-equiv=refresh content="0;url={target}">',
            f'<link rel="alternate canonical" href="{target}">', f"<link href='{target}' rel='canonical nofollow'>",
            f'<link rel="noncanonical" href="{target}">', f'<meta content="0; url={target}" http-equiv="x-refresh">']
    df = spark.createDataFrame([(i, f"http://p{i}.net/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    judged = urlfilter.judge(df, urlfilter.rules_table(spark, [("com/de/", "block")])).collect()
    assert {r["page_id"] for r in judged if r["verdict"] == "block" and r["by_alias"]} == {0, 1, 2, 3}


def test_seeds_of_one_item_in_many_parts(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"t{i}" for i in range(120)]
    docs = [(1, " ".join(["x"] * 5 + words[60:] + ["y"] * 9 + words[:60])), (2, " ".join(words[:70] + ["z"] * 50)),
            (3, " ".join(rng.sample(words, 120))), (None, " ".join(words)), (1, " ".join(words[:100]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:40]))], "item_id long, text string")
    whole = sorted(map(str, tiling.contaminated(df, bench, by_text=True).collect()))
    sizes = []
    matches = tiling._matches
    monkeypatch.setattr(tiling, "_matches", lambda *a, **k: (sizes.append(len(a[4])), matches(*a, **k))[1])
    monkeypatch.setattr(tiling, "SEEDS_PER_PASS", 40)
    assert sorted(map(str, tiling.contaminated(df, bench, by_text=True).collect())) == whole and len(whole) == 7
    assert len(sizes) == 3 and max(sizes) < 60
