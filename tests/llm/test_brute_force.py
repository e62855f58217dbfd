"""Each operator against a brute-force version, an exact round trip, its SQL or held-out labels."""

import collections
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hexgiving.llm import bestfit, components, minhash, multiindex, oracle, queries, tiling, tokenbits, tokencount, tokenizer, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(oracle.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert collections.Counter(tuple(r) for r in got.select(names).collect()) == collections.Counter(want.fetchall())


def test_url_aliases(spark):
    pages = [(1, "http://a.example.com/de/1", ""), (2, "http://b.net/x", '<link rel="canonical" href="https://a.example.com/de/1#f">'),
             (3, "https://c.net/y?q=1&amp", "<META http-equiv='refresh' content='0; url=//b.net/x'>"), (4, "http://d.org/1", '<link href="/2" rel=canonical>'),
             (5, "http://e.net/p/q", '<link rel="canonical" href="r">'), (6, "http://e.net/p/r", '<link rel=canonical href=http://z.com/fr/9>'),
             (7, "http://e.net/p/s", '<link rel=canonical href=http://e.net/p/q>'), (8, "http://f.net/", '<link rel=canonical href=http://g.com/de/>'),
             (9, "http://h.net/", '<link rel=canonical href=http://f.net/>')]
    from hexgiving.llm import urlfilter
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    r = {x["page_id"]: (x["rule"], x["verdict"], x["by_alias"]) for x in
         urlfilter.judge(df, urlfilter.rules_table(spark, queries.URL_RULES)).collect()}
    assert r[1] == ("com/de/", "block", False) and r[2] == r[3] == (None, "block", True) and r[4] == ("org/", "allow", False)
    assert r[5] == r[6] == r[7] == (None, "allow", True) and r[8] == r[9] == (None, "block", True)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = con.execute(oracle.OP2).fetchall()
    assert {x[0]: (x[3], x[4], x[5]) for x in want} == r


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n: got.get(n, n) for n in label} == label


def near_duplicate_components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        k = min(n, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in links:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(n)
    texts, vocabulary = {}, [f"w{i}" for i in range(60)]
    for family in range(6):     # near copies at all distances from the threshold
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(25):
            texts[len(texts)] = " ".join(rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.05, 0.08]) else w for w in base)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicate_components(texts, n, 80)


def test_op3(spark, texts):
    got = queries.op3_minhash_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicate_components(texts, 2, 80)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(texts, name):
    e = tokenizer.Encoder(public_tokenizers.path(name))
    odd = ["a\t  b", "|x a|b c| |", "(a) (b", "a  b\n\n c ", "<|endoftext|> x\0 y", " \n", "  x", "don't I'LL\x1c b", "\u0301 x", "Σας ΣΑΣ",
           "e\u0301té İx", " a\n", "x\u00a0 y", "日本 語", "1234 5.6", ""]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    for text, got in zip([*texts.values(), *odd], e.encode([*texts.values(), *odd]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        k = next((k for k in range(len(word), at, -1) if word[at:k] in pieces), None)
        if k is None:
            return 1
        n, at = n + 1, k
    return n


def test_automaton():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
        a = tokencount.Automaton(sorted(pieces))
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
            assert a.length(word) == greedy(word, pieces), (word, pieces)


def test_op1(spark, texts):
    pieces = set(tokencount.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    for r in queries.op1_token_counts(spark, SF).collect()[:60]:
        assert r["n_tokens"] == sum(greedy(b" " + w, pieces) for w in (texts[r["doc_id"]] or "").encode().split())


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([5, 16, 64])
        counts = collections.Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 150)))
        bins = []
        for length in sorted(counts.elements(), reverse=True):
            left = min((b for b in bins if b >= length), default=None)
            if left is not None:
                bins.remove(left)
            bins.append((cap if left is None else left) - length)
        placements, n = bestfit.plan(counts, cap)
        fill = [0] * n
        for length in sorted(counts, reverse=True):
            mine = [p for p in placements if p[0] == length]
            for r in range(counts[length]):
                _, first, bin_, per, offset = [p for p in mine if p[1] <= r][-1]
                at = bin_ + (r - first) // per
                assert offset + (r - first) % per * length == fill[at]
                fill[at] += length
        assert sorted(cap - f for f in fill) == sorted(bins)


def test_op4_and_op6(spark, texts):
    for query, name, end in ((queries.op4_best_fit_packing, "byte_bpe_50k.json", 2), (queries.op6_token_bits, "word_bpe_49k.json", 1)):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        rows, at = collections.defaultdict(list), 0
        for r in query(spark, SF).collect():
            rows[r["doc_id"]].append(r)
        for i in sorted(texts):
            ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, end], "<u4")
            if end == 1:
                (r,) = rows[i]
                assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
                at += len(ids)
            else:
                mine = sorted(rows[i], key=lambda r: r["piece"])
                assert [r["length"] for r in mine[1:]] == [1024] * (len(mine) - 1)
                for r in mine:
                    assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
                assert sum(r["length"] for r in mine) == len(ids)


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 20, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, np.uint64).astype(np.uint32)
    raw = tokenbits.pack_bits(ids, bits)
    assert len(raw) == (1000 * bits + 7) // 8
    for a, b in ((0, 1000), (13, 77), (999, 1000), (5, 5)):
        assert (tokenbits.unpack_bits(raw, bits, a, b) == ids[a:b]).all()


def naive_tiling(item, text, least):
    mine, theirs, covered = [False] * len(item), [x == 0 for x in text], 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(text)):
                k = 0
                while p + k < len(item) and d + k < len(text) and not mine[p + k] and not theirs[d + k] and item[p + k] == text[d + k]:
                    k += 1
                best = max(best, (k, -p, -d))
        k, p, d = best[0], -best[1], -best[2]
        if k < least:
            return covered
        mine[p:p + k], theirs[d:d + k], covered = [True] * k, [True] * k, covered + k


def test_tiling():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randint(1, 9) for _ in range(rng.randint(4, 30))]
        cut = rng.randint(0, len(item))
        text = [rng.randint(1, 9) for _ in range(8)] + item[cut:] + [rng.randint(0, 9) for _ in range(6)] + item[:cut]
        tiles = tiling.tile(item, text, 4)
        assert sum(t[2] for t in tiles) == naive_tiling(item, text, 4)
        assert all(item[p:p + k] == text[d:d + k] and k >= 4 for p, d, k in tiles)


def test_reordered_passage(spark):
    item = [f"t{i}" for i in range(40)]
    docs = [(1, " ".join(["x"] * 30 + item[20:] + ["y"] * 9 + item[:20])), (2, " ".join(item[:20] + ["z"] * 50)), (3, " ".join(sorted(item)))]
    r = tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(x["id"], x["item"], x["coverage"], x["n_tiles"]) for x in r if x["id"] != 3] == [(1, 7, 1.0, 2)]


def test_viterbi():
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 50)) for i in rng.sample(range(toxicity.SIZE ** 3), 40_000)]
    model = toxicity.character_model(rows)

    def value(path):
        a = b = 0
        total = 0.0
        for letter, cost in path:
            total += cost
            if letter:
                total += model[a, b, toxicity.INDEX[letter]]
                a, b = b, toxicity.INDEX[letter]
        return total + model[a, b, 0]

    for token in ("1d10t", "a.b1", "l00ser", "5--tt", "m*n", "aaa1"):
        best = max(itertools.product(*toxicity.lattice(token)), key=value)
        assert toxicity.decode(token, model) == "".join(x for x, _ in best)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = queries.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    caught = sum(x["predicted"] for x in r if x["toxic"]) / sum(x["toxic"] for x in r)
    wrong = sum(x["predicted"] for x in r if not x["toxic"]) / sum(not x["toxic"] for x in r)
    assert caught >= 0.9 and wrong <= 0.06


def test_deobfuscation_reaches_the_score(spark):
    rng = random.Random(6)
    plain = ["river stone garden winter", "quiet morning on the hill", "the clown was walking there"]
    docs = [(i, " ".join(rng.choice(plain) for _ in range(6)) + (" you idiot" if i % 5 == 0 else "")) for i in range(400)]
    docs += [(1000, plain[0] + " 1d10t"), (1001, plain[0] + " i d i o t now"), (1002, plain[0] + " idiooooot!!"), (1003, plain[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    r = {x["doc_id"]: x["toxicity"] for x in toxicity.with_scores(df, toxicity.learn(df, labels)).where("doc_id >= 1000").collect()}
    assert min(r[1000], r[1001], r[1002]) > 0.5 > r[1003]


def test_search_recall(spark, db):
    ids, vectors = zip(*db.execute("SELECT vec_id, embedding FROM embeddings").fetchall(), strict=True)
    v, ids = np.array(vectors, float), np.array(ids)
    got = collections.defaultdict(dict)
    for r in queries.op8_nearest_neighbours(spark, SF).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        want = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, 21)) and all(abs(s[np.flatnonzero(ids == i)[0]] - x) < 1e-12 for i, x in mine.values())
        hits += len({int(ids[i]) for i in want} & {i for i, _ in mine.values()})
        total += 20
    assert hits / total >= 0.9


def test_traversal_takes_the_nearest_cells():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b, sizes = rng.normal(size=6), rng.normal(size=7), rng.integers(0, 5, (6, 7))
        mask = multiindex.traverse(a, b, sizes, 30)
        order = np.argsort((a[:, None] + b).ravel(), kind="stable")
        n = int(np.searchsorted(np.cumsum(sizes.ravel()[order]), 30)) + 1
        assert set(np.flatnonzero(mask.ravel())) == set(order[:n])


def test_language_model(spark, texts):
    kept = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = collections.Counter(w for i in texts if kept[i] != 2 for w in tokens[i])
    n, v = sum(c.values()), len(c)
    model = base = 0
    for r in queries.op9_language_model(spark, SF).collect():
        t = tokens[r["doc_id"]]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            kept[r["doc_id"]] == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - want) < 1e-6
        if r["held_out"]:
            model, base = model + r["score"], base + want
    assert model > base


def test_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay, and each stage's decisions reach the next."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('bcdfghklmn')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randint(10, 99)}" for _ in range(n))
    clean = [text(60) + "." for _ in range(120)]
    docs = list(enumerate(clean))
    docs += [(1000 + i, text(40) + " idiot scum") for i in range(40)]
    docs += [(2000, clean[3]), (2001, clean[4].replace(clean[4].split()[30], "changed"))]
    passage = text(55)
    docs += [(3000, text(30) + ".\n" + passage + ".\n" + text(30)), (3001, text(40) + ".\n" + passage + ".\n" + text(30))]
    item = text(30)
    docs += [(4000, text(40) + " " + item + " " + text(20))]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 1030)) for i in [*range(100), *range(1000, 1030)]],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = set(range(120)) | {3000, 3001}
    assert {r["doc_id"] for r in out} == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r["doc_id"]: r["ids"] for r in out if r["start"] == 0}
    assert passage in library.decode(whole[3000]) and passage not in library.decode(whole[3001])
    assert all(library.decode(whole[i][:-1]) == clean[i] for i in range(120))


def test_signature_bounds_lose_no_link():
    """Pairs at the threshold pass the sketch, size and minima bounds; pairs far from it do not."""
    rng = np.random.default_rng(3)
    family = np.random.default_rng(minhash.SEED)
    a = family.integers(0, 2**32, 250, np.uint32) | np.uint32(1)
    b = family.integers(0, 2**32, 250, np.uint32)

    def signed(s):
        low = minhash._packed(minhash._minima(s, a, b)[None])
        return np.frombuffer(minhash._odd_sketch(s) + low.tobytes(), np.uint8)

    links = far = 0
    for size in (5, 40, 300, 5_000):
        for gone in np.linspace(0, 0.5, 41):
            whole = rng.integers(0, 2**64, 2 * size, np.uint64)
            x = np.unique(whole[:size])
            y = np.unique(whole[int(gone * size):int(gone * size) + size - size // 20])
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            keep = minhash._promising(signed(x)[None], signed(y)[None], np.array([len(x)]), np.array([len(y)]), 80, 250)[0]
            if 100 * both >= 80 * union:
                links += 1
                assert keep
            elif 100 * both < 60 * union and size == 300:
                far += 1
                assert not keep
    assert links > 20 and far > 3
