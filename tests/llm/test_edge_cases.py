"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexgiving.llm import (bestfit, components, interpolation, minhash, multiindex, substring, tiling, tokenbits, tokencount,
                           toxicity, urlfilter)
from hexgiving.session import shared_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(20_000))
SENTENCE = "this exact sentence of more than eight words is repeated here"
ROWS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n "), (None, "null id text"), (5, LONG), (6, LONG),
        (1, "one two three four five six seven"), (7, "one two three four five six seven"), (8, f"start. {SENTENCE}. end"),
        (9, f"{SENTENCE}.\n{SENTENCE}."), (10, "😀 ünï\0code\x1f x")]
CLASH = ("id", "digest", "set", "component_id", "kept", "removed", "sequence_id", "offset", "score", "part", "__spans", "n")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    d = d.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return d.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_token_counts(docs, none):
    r = rows(tokencount.token_counts(docs, BYTE))
    assert len(r) == len(ROWS) and all(x["n_tokens"] == 0 for x in r if x["doc_id"] in (2, 3, 4))
    assert {x["n_tokens"] for x in r if x["doc_id"] in (1, 7)} == {7}
    assert tokencount.token_counts(none, BYTE).count() == 0


def test_near_duplicates(docs, none):
    r = rows(minhash.near_duplicates(docs))
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in r}
    assert len(r) == len(ROWS) and {(1, 1, True), (7, 1, False), (6, 5, False), (2, 2, True), (None, None, True)} <= got
    assert minhash.near_duplicates(none).count() == 0


def test_substring(docs, none):
    r = rows(substring.repeated_units(docs))
    assert {(x["id"], x["first_id"]) for x in r if x["n_words"] == 11} == {(9, 8)}
    out = {(x["doc_id"], x["text"]) for x in rows(substring.remove_repeats(docs))}
    assert (9, "") in out and (2, None) in out and (8, f"start. {SENTENCE}. end") in out and (5, LONG) in out
    assert substring.remove_repeats(none).count() == 0


def test_contaminated(docs, none, spark):
    bench = spark.createDataFrame([(1, "One, two three four five six seven!"), (2, None), (3, ""), (None, "a b c d e f"),
                                   (4, "two words"), (1, "One, two three four five six seven!")], "item_id long, text string")
    r = rows(tiling.contaminated(docs, bench))
    assert {(x["id"], x["item"]) for x in r} == {(1, 1), (7, 1)} and len(r) == 2
    assert tiling.contaminated(none, bench).count() == 0
    assert tiling.contaminated(docs, bench.where("item_id = 9")).count() == 0


def test_packing(docs, none):
    r = rows(bestfit.pack_documents(docs, BYTE, keep_ids=True))
    assert sum(x["piece"] == 0 for x in r) == len(ROWS)
    assert all(x["ids"] == [2] for x in r if x["doc_id"] in (2, 3)) and all(len(x["ids"]) == x["length"] <= 1024 for x in r)
    ends = {}
    for x in sorted(r, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 1024
    assert bestfit.pack_documents(none, BYTE).count() == 0


def test_token_files(docs, none, spark):
    path = shared_dir(spark, "t")
    tokenbits.write_tokens(docs, path, WORD, 49_408, 1)
    r = rows(tokenbits.read_tokens(spark, path, with_ids=True).orderBy("start"))
    assert [x["id"] for x in r] == sorted((x[0] for x in ROWS), key=lambda i: (i is not None, i or 0))
    assert all(x["ids"] == [1] for x in r if x["id"] in (2, 3)) and [len(x["ids"]) for x in r] == [x["n_tokens"] for x in r]
    empty = shared_dir(spark, "t")
    tokenbits.write_tokens(none, empty, WORD, 49_408, 1)
    assert tokenbits.read_tokens(spark, empty).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (7, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    r = rows(toxicity.with_scores(docs, model))
    assert len(r) == len(ROWS) and all(0 <= x["toxicity"] <= 1 for x in r)
    assert len({x["toxicity"] for x in r if x["doc_id"] in (1, 7)}) == 1
    assert len({x["toxicity"] for x in r if x["doc_id"] in (2, 3, 4)}) == 1
    model = toxicity.learn(none, labels.where("doc_id = -1"))
    assert toxicity.with_scores(none, model).count() == 0


def test_search(spark):
    v = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
         (6, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (8, [])]
    t = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "a": F.lit(3)})
    r = rows(multiindex.search(t, F.col("id") % 20 == 0, 20, share=1.0))
    assert [(x["rank"], x["id"], x["score"]) for x in r if x["query_id"] == 0] == [(1, 1, 1.0), (2, 20, 1.0), (3, 6, 0.5)]
    assert multiindex.search(t.where("vec_id = -1"), F.col("id") % 20 == 0).count() == 0


def test_language_model(docs, none):
    r = rows(interpolation.score(docs))
    assert len(r) == len(ROWS) and all(x["n_tokens"] == 1 for x in r if x["doc_id"] in (2, 3, 4))
    assert all(x["score"] < 0 for x in r if x["n_tokens"] > 1) and all(x["held_out"] for x in r if x["doc_id"] is None)
    assert interpolation.score(none).count() == 0


def test_urls(spark):
    p = spark.createDataFrame([(1, None, None), (2, "no scheme/de/1", "<link rel=canonical href=/x>"), (3, "http://A.example.com/de/1", None),
                               (4, "http://x.net", ""), (None, "http://x.com/fr/", "h"), (3, "http://A.example.com/de/1", None)],
                              "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "node", "id", "rule")})
    rules = urlfilter.rules_table(spark, [("com/de/", "block"), ("com/fr/", "allow")])
    got = sorted(map(str, ((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in rows(urlfilter.judge(p, rules)))))
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/de/1", "com/de/", "block"),
            (3, "a.example.com", "/de/1", "com/de/", "block"), (4, "x.net", "", None, "allow"), (None, "x.com", "/fr/", "com/fr/", "allow")]
    assert got == sorted(map(str, want))
    assert urlfilter.judge(p.where("page_id = -1"), rules).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (None, 1), (3, 2)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(e).collect()} == {(2, 1), (3, 1), (8, 7), (9, 7)}
    assert components.connected_components(e.where("a = -1")).count() == 0


def test_stages(docs, none, spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 x1 w2 x2 w3 x3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, none):
            out = stage(spark, table, str(tmp_path))
            n = out.count()
            assert n <= table.count() if name != "packing" else n >= table.count()
            if name != "packing":
                assert set(docs.columns) - {"removed"} <= set(out.columns)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, 5, 8, 9, 10], key=str)
