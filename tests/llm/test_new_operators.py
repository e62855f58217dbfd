"""Spelling variants, whitening and the WARC archive against brute force, exact round trips and SQL; edge cases."""

import base64
import collections
import glob
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexgiving.llm import queries, variants, warc, whitening
from hexgiving.session import shared_dir

SF = "/root/testdata/sf0.001"


# --- spelling variants --------------------------------------------------------

def brute_counts(texts):
    n = collections.Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    by_size = collections.defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    close = {w: [u for size in (len(w) - 1, len(w), len(w) + 1) for u in by_size[size] if near(w, u)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n}


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query_is_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(texts))
    df = queries.op11_spelling_variants(spark, SF)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(df) == want and any(r[1] for r in want) and df.count() == len(want)


def test_neighbours_of_dense_words(spark):
    """Every word of up to 5 letters of a small alphabet: repeats, ties and all kinds of edits."""
    words = ["".join(p) for size in (1, 2, 3, 4, 5) for p in itertools.product("aéb", repeat=size)]
    n = {w: 3 + zlib.crc32(w.encode()) % 50 for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(variants.group_variants(df)) == brute_variants(n)


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    r = variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {x["word"]: x["root"] for x in r} == {a: "w37" for a, _ in rows}


def test_spelling_edges(spark):
    rows = [(None, "Straße STRASSE straße"), (1, None), (2, ""), (3, "école École ÉCOLE écoles"), (3, "école École ÉCOLE écoles"),
            (4, "word " * 5000 + "x" * 30_000), (5, "a×b÷c naïve-naïve naïve 12naïve34"), (6, "Ωmega ΩΩΩΩΩ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "word", "run", "prefix")})
    runs = variants.letter_runs(docs)
    df = variants.group_variants(variants.word_counts(runs.select(variants.slipped(F.col("run"), F.col("id"), 97).alias("word"))))
    want = brute_variants(brute_counts(rows))
    assert got(df) == want and {"naïve"} <= {w[0] for w in want}
    assert variants.group_variants(variants.word_counts(runs.where("false").withColumnRenamed("run", "word"))).count() == 0


# --- whitening ----------------------------------------------------------------

def brute_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (fit * n - sums) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, len(e))
    white = ((x * n - sums) / n) @ u[:, :k] / np.sqrt(e[:k])
    return n, ((x * n - sums) ** 2).sum(1), white, e[:k] / np.trace(v)


def test_whitening_query_is_brute_force(spark):
    source = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, dev, white, explained = brute_whitening([v for _, v in source])
    rows = queries.op12_embedding_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert len(rows) == 16 * len(source)
    out = np.array([r["whitened"] for r in rows]).reshape(-1, 16)
    sign = np.sign((out * white).sum(0))
    assert np.abs(out * sign - white).max() < 1e-8
    assert [r["deviation"] for r in rows[::16]] == dev.tolist() and {r["n"] for r in rows} == {n}
    assert np.allclose([r["explained"] for r in rows[:16]], explained, rtol=1e-10)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("kind", ["random", "clustered", "repeated", "low rank", "diagonal", "identity", "one", "zero"])
def test_spectral(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 41
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"random": rng.random(d) * 10, "clustered": 5 + 1e-9 * rng.random(d), "repeated": np.repeat([7.0, 2.0, 1.0, 1.0], 11)[:d],
         "low rank": np.r_[rng.random(5) + 1, np.zeros(36)], "diagonal": 2.0 ** -np.arange(d), "identity": np.ones(d),
         "one": np.array([3.0]), "zero": np.zeros(d)}[kind]
    if kind == "diagonal":
        q = np.eye(d)
    a = q * e @ q.T
    a = (a + a.T) / 2
    values, v = whitening.spectral(a)
    scale = max(np.abs(e).max(), 1e-300)
    assert np.abs(np.sort(e)[::-1] - values).max() <= 1e-13 * scale * d
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-12 and np.abs(a @ v - v * values).max() <= 1e-13 * scale * d


def test_polar_of_near_singular():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    e = np.r_[-np.logspace(0, -12, 15), np.logspace(0, -12, 15)]
    u = whitening.polar(q * e @ q.T)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-10


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (2, [-1.0, 0.25, 0.5]), (None, [3.0, -2.0, 0.5]), (3, None), (4, [1.0, None, 2.0]),
            (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0]), (8, []), (9, [0.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "x", "v", "n")})
    data = whitening.scaled(df)
    assert sorted((r["id"] or 0) for r in data.collect()) == [0, 1, 2, 2, 9]
    model = whitening.fit_whitening(data)
    assert model.n == 4 and model.white.tolist() == [True, True, False] and model.identity_error < 1e-12
    out = whitening.whiten(data, model).collect()
    assert all(r["whitened"][2] is None and r["whitened"][0] is not None for r in out)
    n, dev, _, _ = 4, *brute_whitening([v for i, v in rows if i in (1, None, 9) or v and len(v) == 3 and i == 2])[1:]
    assert sorted(r["deviation"] for r in out) == sorted(dev.tolist())
    none = whitening.fit_whitening(data.where("false"))
    assert none.n == 0 and whitening.whiten(data.where("false"), none).count() == 0
    single = whitening.fit_whitening(data.where("id = 1"))
    assert single.n == 1 and single.identity_error is None
    assert whitening.whiten(data.where("id = 1"), single).first()["whitened"] == [None] * 3


def test_deviation_beyond_a_long_is_null(spark):
    data = spark.createDataFrame([(1, [2 ** 60]), (2, [0]), (3, [5])], "id long, x array<long>")
    out = {r["id"]: r["deviation"] for r in whitening.whiten(data, whitening.Whitening(
        3, [2 ** 60 + 5], np.ones(1), np.ones((1, 1)), 1.0, 0.0)).collect()}
    assert out == {1: None, 2: None, 3: None}
    small = whitening.Whitening(3, [10], np.ones(1), np.ones((1, 1)), 1.0, 0.0)
    assert whitening.whiten(data.where("id = 3"), small).first()["deviation"] == 25


# --- WARC archive -------------------------------------------------------------

def brute_pages(rows):
    """(payload_bytes, digest, type, refers_to) per row for distinct ids."""
    first, out = {}, {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        b = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        kind = "revisit" if b in first else "response"
        out[i] = (len(b), digest, kind, first.get(b))
        first.setdefault(b, i)
    return out


def parse_warc(content):
    at, out = 0, []
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        head = content[at:end]
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:-2])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and content[end + size:end + size + 4] == b"\r\n\r\n"
        out.append((fields, content[end:end + size]))
        at = end + size + 4
    return out


def test_warc_query_and_files(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    source += [(100_000 + i, u, h) for i, u, h in source[::3]]      # copies
    df = spark.createDataFrame(source, "page_id long, url string, html string").repartition(5)
    path = shared_dir(spark, "warc-test")
    warc.write_archive(df, path)
    want = brute_pages(source)
    got = {r["id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.record_facts(spark, path).collect()}
    assert {int(k): (*v[:3], v[3] and int(v[3])) for k, v in got.items()} == want
    assert warc.payloads(spark, path).count() == len({h or "" for _, _, h in source})
    rebuilt = {int(r["id"]): (r["url"], bytes(r["payload"]).decode()) for r in warc.records(spark, path).collect()}
    assert rebuilt == {i: (u, h or "") for i, u, h in source}
    target = shared_dir(spark, "warc-files")
    warc.export_warc(spark, path, target, per_file=20)
    files = glob.glob(f"{target.removeprefix('file:')}/part-*")
    found = [r for f in files for r in parse_warc(open(f, "rb").read())]
    assert len(files) > 2 and len(found) == len(source)
    names = {f["WARC-Record-ID"]: f for f, _ in found}
    assert len(names) == len(source)
    for fields, body in found:
        size, digest, kind, refers = want[int(fields["X-Page-ID"])]
        assert fields["WARC-Type"] == kind and fields["WARC-Payload-Digest"] == f"sha1:{digest}"
        assert len(body) == (size if kind == "response" else 0)
        assert refers is None or names[fields["WARC-Refers-To"]]["X-Page-ID"] == str(refers)


def test_warc_edges(spark):
    rows = [(5, "http://a/\r\nWARC-Type: evil", "same"), (3, None, "same"), (3, None, "same"), (None, "u", "same"), (7, "u", None), (6, "u", ""),
            (None, "u", "alone"), (8, "u", "é\0\r\n\r\nWARC/1.1\r\n"), (9, "", "x" * 1_000_000), (3, "v", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("id", "payload", "digest", "row", "header", "first")})
    path = shared_dir(spark, "warc-edges")
    warc.write_archive(df, path)
    out = warc.record_facts(spark, path).collect()
    assert len(out) == len(rows)
    same = [r for r in out if r["payload_bytes"] == 4]
    assert sorted((r["record_type"], str(r["id"]), r["refers_to"]) for r in same) == [
        ("response", "3", None), ("revisit", "3", "3"), ("revisit", "5", "3"), ("revisit", "None", "3")]
    empty = {r["id"]: (r["record_type"], r["refers_to"], r["payload_digest"]) for r in out if r["payload_bytes"] == 0}
    assert empty["6"][:2] == ("response", None) and empty["7"][:2] == ("revisit", "6")
    assert empty["6"][2] == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    whole = sorted((str(r["id"]), bytes(r["payload"]).decode()) for r in warc.records(spark, path).collect())
    assert whole == sorted((str(i), h or "") for i, _, h in rows)
    assert {r["url"] for r in warc.headers(spark, path).collect() if r["id"] == "5"} == {"http://a/%0D%0AWARC-Type: evil"}
    again = shared_dir(spark, "warc-least")
    warc.write_archive(df, again, least=5)
    kinds = collections.Counter(r["record_type"] for r in warc.record_facts(spark, again).collect())
    assert kinds == {"response": len(rows)}
    none = shared_dir(spark, "warc-none")
    warc.write_archive(df.where("false"), none)
    assert warc.record_facts(spark, none).count() == 0 and warc.records(spark, none).count() == 0


def test_warc_damage_is_found(spark):
    path = shared_dir(spark, "warc-damaged")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    bad = shared_dir(spark, "warc-damaged")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("tent").cast("binary")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.records(spark, bad).collect()
