"""Nearest neighbours of repeated ids and language-model scores against brute force."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexgiving.llm import interpolation, multiindex, queries

SF = "/root/testdata/sf0.001"


def brute_neighbours(rows, k):
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = collections.defaultdict(lambda: -math.inf)
        for _, x in [r for r in rows if r[0] == q]:
            for i, y in rows:
                if i != q:
                    best[i] = max(best[i], float(np.dot(x, y)))
        out[q] = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


@pytest.mark.parametrize("repeated", [7, 20, None])
def test_repeated_ids_of_candidates_and_queries(spark, repeated):
    """Thirty vectors of one candidate, or of a query, near the query; or every id several times."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(3)) for i in range(1, 81)]
    if repeated is None:
        rows += [(int(rng.integers(1, 81)), rng.standard_normal(8).round(3)) for _ in range(200)]
    else:
        near = dict(rows)[20]
        rows += [(repeated, (near * 3 + rng.standard_normal(8) * 0.1).round(3)) for _ in range(30)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for share in (1.0, 0.75):
        got = collections.defaultdict(list)
        for r in multiindex.search(df, F.col("id") % 20 == 0, 20, share=share).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["id"], r["score"]))
        want = brute_neighbours(rows, 20)
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        if share == 1.0:
            for q, w in want.items():
                assert [i for i, _ in got[q]] == [i for i, _ in w]
                assert np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-12)


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def brute_scores(docs):
    """Deleted interpolation with dictionaries, one document after the other."""
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    start = object()

    def counts(ids):
        one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for i in ids:
            before = start
            for w in tokens[i]:
                one[w] += 1
                two[before, w] += 1
                ctx[before] += 1
                before = w
        return one, two, ctx

    def bucket(c):
        return 0 if c == 0 else min(int(math.log2(c)) + 1, interpolation.BUCKETS - 1)

    def binned(p):
        return 0.0 if p <= 0 else 2.0 ** (round(math.log2(p) * interpolation.STEPS) / interpolation.STEPS)

    train = [i for i in tokens if fold(i, 7) != 2]
    one, two, ctx = counts([i for i in train if fold(i, 7) != 3])
    held = counts([i for i in train if fold(i, 7) == 3])[1]
    size = sum(one.values())
    cells = collections.defaultdict(list)
    for (before, w), c in held.items():
        known = ctx[before]
        cells[bucket(known)].append((binned(two[before, w] / max(known, 1)), binned(one[w] / size), 1 / (len(one) + 1), c))
    weights = [np.array(interpolation.DEFAULT)] * interpolation.BUCKETS
    for b in range(interpolation.BUCKETS):
        if cells[b]:
            w = np.array(interpolation.DEFAULT)
            for _ in range(200):
                new = np.zeros(3)
                for *p, c in cells[b]:
                    s = w * np.array(p)
                    new += c * s / s.sum()
                new /= sum(c[-1] for c in cells[b])
                done = np.abs(new - w).max() < 1e-9
                w = new
                if done:
                    break
            weights[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        elif b:
            weights[b] = weights[b - 1]
    one, two, ctx = counts(train)
    size, words = sum(one.values()), len(one)
    out = {}
    for i, ts in tokens.items():
        total, base, before = 0.0, 0.0, start
        for w in ts:
            known = ctx[before]
            a = weights[bucket(known)]
            if not known:
                a = np.array([0, a[1], a[2]]) / (a[1] + a[2])
            total += math.log10(a[0] * two[before, w] / max(known, 1) + a[1] * one[w] / size + a[2] / (words + 1))
            base += math.log10((one[w] + 1) / (size + words + 1))
            before = w
        out[i] = (fold(i, 7) == 2, len(ts), sum(one[w] > 0 for w in ts), size, base, total)
    return out


def test_language_model_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", 9_000)      # several blocks a part
    monkeypatch.setattr(interpolation, "KEYS_PER_PARTITION", 5_000)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_scores(docs)
    got = queries.op9_language_model(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-6)
