"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import bpe, epsgrid, jaccard, jobs, langid, mih, ngramlm, packing, pii, toxicity, units, wrappers
from runlens.llm.textblocks import blocks

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " ", "\n\t", "a", "one two three four", "x" * 4000, "  lead", "Mixed CASE Words in A Row", "é ß ñ 日本 語", "<|endoftext|> and <|startoftext|>",
       " wide  　space  ", "1 2 3 4 5 6 7 8 9"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, near copies, columns with clashing names."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
    texts += [texts[20]] * 5 + [" ".join(r.choices(vocab, k=30_000))]
    rows = [(i, t, "en" if i % 2 else None, i, "x", 1.5) for i, t in enumerate(texts)] + [(3, None, "fr", 0, "y", 0.0), (None, "no id here", None, 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, sig string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_matches_the_library_on_whole_texts(spark, odd_docs, docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = units.plain_tokenizer(path)
    both = odd_docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(60))
    texts = [r.text or "" for r in both.collect()]
    got = bpe.encode_decode(both, path, keep_ids=True).collect()
    want = Counter()
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        out = t.decode(ids, skip_special_tokens=False)
        want[len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest(), tuple(ids), out] += 1
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == want


def _thue_morse(n):
    """Two words of the letters a and b that any polynomial modulo 2^64 with an odd base takes for one."""
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def test_words_with_equal_polynomials_are_told_apart(spark):
    import public_tokenizers

    one, two = _thue_morse(1024)
    texts = [f"x {one} y", f"x {two} y", one, two]
    (b,) = blocks(pa.array(texts))
    start, end, _ = b.runs()
    assert len(set(b.hashes(start, end).tolist())) == 4
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t = units.plain_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [list(r.ids) for r in bpe.encode_decode(rows, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).orderBy("doc_id").collect()] == want
    t = units.plain_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: r.n for r in packing.pack_documents(rows).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
    twice = spark.createDataFrame([(0, one), (1, two)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_join(twice).collect()} == {0, 1}
    known = ngramlm.lm_scores(spark.createDataFrame([(0, one, True), (1, two, False)], "doc_id long, text string, train boolean"))
    assert {r.doc_id: r.n_known for r in known.collect()} == {0: 2, 1: 1}


def test_memo_compares_bytes_behind_equal_hashes(monkeypatch):
    monkeypatch.setattr(units.Block, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    memo = units.UnitMemo(lambda us: [[ord(c) for c in u] for u in us])
    for text in ("ab c ab dd", "dd ab", "c"):
        (b,) = blocks(pa.array([text]))
        start, end, _ = b.runs()
        got = memo.ids[memo.lookup(b, start, end)]
        assert [bytes(np.frombuffer(x, "<u4").astype(np.uint8)).decode() for x in got] == text.split()


def test_bpe_reuses_shared_chunks(monkeypatch):
    import public_tokenizers

    coder = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    shared = " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(2000))
    (b,) = blocks(pa.array([shared, "before " + shared + " after"]))
    cuts = bpe.chunk_cuts(b)
    keys = b.hashes(cuts[:-1], cuts[1:])
    assert len(np.unique(keys)) < 0.7 * len(keys)
    first, second = coder.encode(b)
    assert first[0] in second[0]


def _jaccard(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(list(zip([d for d, _ in rows], sets)), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return Counter((d, len(s), root(d)) for (d, _), s in zip(rows, sets))


def test_jaccard_join_matches_all_pairs(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()]
    got = jaccard.jaccard_join(odd_docs.where("doc_id is not null")).collect()
    assert Counter(tuple(r) for r in got) == _jaccard(rows)


def test_jaccard_join_without_stars_in_small_blocks(odd_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 2)
    some = odd_docs.where("doc_id is not null")
    assert Counter(tuple(r) for r in jaccard.jaccard_join(some).collect()) == _jaccard([(r.doc_id, r.text) for r in some.collect()])


def test_jaccard_join_empty_and_null_ids(spark, odd_docs):
    assert jaccard.jaccard_join(odd_docs.limit(0)).count() == 0
    one = jaccard.jaccard_join(odd_docs.where("doc_id is null")).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in one] == [(None, 1, None)]


def test_components_on_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(202, 201), (201, 200), (200, 202), (7, 7)]
    got = dict(jobs.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def test_toxicity_held_out_and_odd_texts(spark, odd_docs):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained_model(d, y)
    held = d.join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = toxicity.score(held.select("doc_id", "text", "toxic"), model).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    odd = toxicity.score(odd_docs.drop("score"), model).toPandas()
    assert odd.score.between(0, 1).all() and len(odd) == odd_docs.count()
    assert toxicity.trained_model(d.limit(0), y) == 0.0
    assert toxicity.score(odd_docs.select("doc_id", "text").limit(0), 0.0).count() == 0


def test_toxicity_gradients():
    (b,) = blocks(pa.array(["you are bad bad man", "nice day out there today", "x"]))
    model, w = toxicity.BiGRU(1), toxicity.Words(b)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    doc, at, n = toxicity.windows(w.first)
    idx, mask = toxicity.gather(np.r_[w.which, 0], at, n, len(w.rows))
    y, weight = np.array([1, 0, 0]), np.ones(3)

    def loss():
        logit = model.forward(model.inputs(w).astype(np.float64), idx, mask.astype(np.float64))[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    g = model.gradients(w, model.inputs(w), idx, mask, y[doc], weight)
    for name, place in (("fx", (1, 2)), ("bh", (0, 4)), ("a", (3,)), ("w", (5,)), ("f0", (2,)), ("c", (0,))):
        old = model.p[name][place]
        model.p[name][place] = old + 1e-3
        up = loss()
        model.p[name][place] = old - 1e-3
        down = loss()
        model.p[name][place] = old
        assert abs((up - down) / 2e-3 - g[name][place]) < 2e-4, name


def test_toxicity_windows_cover_every_word():
    first = np.r_[0, np.cumsum([0, 1, 47, 48, 49, 500])]
    doc, at, n = toxicity.windows(first)
    for d in range(6):
        seen = {w for i in np.flatnonzero(doc == d) for w in range(at[i], at[i] + n[i])}
        assert seen == set(range(first[d], first[d + 1]))


def test_toxicity_windows_hold_half_a_window_whole():
    doc, at, n = toxicity.windows(np.array([0, 400]))
    for size in (9, 20, toxicity.WINDOW // 2 + 1):
        assert all(((at <= s) & (s + size <= at + n)).any() for s in range(400 - size + 1)), size


def test_toxicity_of_a_sentence_does_not_depend_on_its_place():
    r = random.Random(9)
    calm = ["".join(r.choices("abcdefgh", k=r.randint(3, 7))) for _ in range(300)]
    sharp = ["".join(r.choices("stuvwxyz", k=r.randint(3, 7))) for _ in range(40)]
    mixed = lambda n, share: [r.choice(sharp if r.random() < share else calm) for _ in range(n)]
    texts, labels = [], []
    for i in range(240):  # toxic documents hold a dense passage, clean ones single sharp words
        t = mixed(150, 0.1)
        if i % 2:
            s = r.randrange(150 - 24)
            t[s : s + 24] = mixed(24, 0.6)
        texts.append(" ".join(t))
        labels.append(i % 2)
    model = toxicity.train(texts, labels)
    planted, clean = mixed(24, 0.6), mixed(220, 0.0)
    (b,) = blocks(pa.array([" ".join(clean[:k] + planted + clean[k:]) for k in range(97)]))
    got = model.scores(b)
    assert got.max() - got.min() < 0.15 and got.min() > model.scores(next(blocks(pa.array([" ".join(clean)]))))[0]


def test_hamming_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD_ROWS", 60)
    monkeypatch.setattr(mih, "QUERY_ROWS", 3)
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 40))
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (None, [1.0] * 40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = mih.hamming_topk(v, v.where("vec_id % 50 = 0"), k=7).collect()
    bits, want = x > 0, set()
    for q in range(0, 400, 50):
        near = sorted(((bits[q] != bits[i]).sum(), i) for i in range(400))[:7]
        want |= {(q, k + 1, i, int(d)) for k, (d, i) in enumerate(near)}
    assert {tuple(g) for g in got} == want and len(got) == len(want)
    assert mih.hamming_topk(v.limit(0), v).count() == 0


def test_language_held_out_and_und(spark, odd_docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prof = langid.trained_profiles(d)
    held = langid.identify(d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), prof).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95
    odd = langid.identify(odd_docs.select("doc_id", "text"), prof).toPandas()
    blank = odd.text.isna() | ~odd.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert (odd[blank].lang_pred == "und").all() and (odd[blank].score == 0).all() and (odd[~blank].lang_pred != "und").all()
    assert langid.identify(d.limit(0), prof).count() == 0
    assert set(langid.identify(d.limit(5), []).toPandas().lang_pred) == {"und"}


def test_language_profile_is_rank_order():
    text = "aab ab"
    grams = Counter()
    for w in text.split():
        p = f" {w} "
        grams.update(w)
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert [int(x) for x in langid.ranked(langid.ngrams(text), 99)] == [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))]


def test_wrappers_keep_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in wrappers.main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        assert r.text == " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text)


def test_wrappers_learn_template_and_slot(spark):
    page = "<body><div id=a><p>Welcome to our site</p></div><div id=b><p>Read more below</p><p>{}</p><p>{}</p></div><div class=comments><p>c{}</p></div>"
    rows = [(i, "http://h.x/%d" % i, page.format(f"Story number {i} is told here", f"and it ends {i}", i)) for i in range(9)]
    rows += [(100, None, None), (101, "", ""), (102, "http://z/1", "plain <b>te</b>xt &amp; more"), (3, "http://h.x/3", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = sorted((r.page_id, r.text) for r in wrappers.main_text(df).collect())
    want = sorted([(i, f"Story number {i} is told here and it ends {i}") for i in [*range(9), 3]] + [(100, ""), (101, ""), (102, "plain text & more")])
    assert got == want
    assert wrappers.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("slot", ["article", "div class=text"])
def test_wrappers_keep_paragraphs_of_near_copies(spark, slot):
    tag = slot.split()[0]
    page = "<body><div class=top><p>Our site</p></div><" + slot + "><h1>{}</h1><p>{}</p></" + tag + "></body>"
    paragraphs = [f"Paragraph {k} of the article that is copied with small changes." for k in range(5)]
    told = [[f"Heading number {i}", *paragraphs] for i in range(6)] + [[f"Another story {i}", *(f"Own words {k} of the {i}th page, nothing is shared here." for k in range(5))] for i in (6, 7)]
    rows = [(i, "http://n.x/%d" % i, page.format(t[0], "</p><p>".join(t[1:]))) for i, t in enumerate(told)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate(told)}


def test_wrappers_keep_constant_headings_of_articles(spark):
    told = [["Summary", f"What page {i} says about matter {i * 7}.", "Thanks for reading."] for i in range(9)]
    rows = [(i, "http://c.x/%d" % i, "<body><article><h2>{}</h2><p>{}</p><p>{}</p></article>".format(*t)) for i, t in enumerate(told)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate(told)}


def test_wrappers_count_families_once():
    ref = Counter({"Menu of the site": 1, "The reference tells its own long story here": 1})
    copies = [Counter({"Menu of the site": 1, "A longer story that is copied many times over": 1, f"on day {i}": 1}) for i in range(5)]
    assert len({wrappers.family(ref, c) for c in copies}) == 1 and wrappers.family(ref, copies[0]) is not None
    assert wrappers.family(ref, ref + Counter({"one more line": 1})) is None


def test_wrappers_match_deep_and_wide_pages(spark):
    deep = ["<div>" * 5000 + f"<p>Deep text {i}</p>" + "<i class=nav>x</i>" * i for i in range(3)]
    wide = ["<table>" + "<tr class=first><td>a</td></tr>" * i + "".join(f"<tr class=r{k % 3}><td>{k} of {i}</td>" + "<td>b</td>" * (k % 5) + "</tr>" for k in range(20_000)) + f"<tr class=z{i}></tr></table>" for i in range(2)]
    for x, y in (deep[:2], wide):
        a, b = wrappers.Page(x), wrappers.Page(y)
        got = wrappers.match(a, b)
        assert len(got) >= len(a.label) - 2 and all(a.label[i] == b.label[j] for i, j in got.items())
    df = spark.createDataFrame([(i, "http://d.x/", t) for i, t in enumerate(deep)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.main_text(df).collect()} == {i: f"Deep text {i}" for i in range(3)}


def test_wrappers_match_is_largest(monkeypatch):
    r = random.Random(6)

    def tree(depth):
        tag = r.choice(["div", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 4) if depth else 0)) + f"</{tag}>"

    def most(a, b, x=0, y=0):
        t = [[0] * (len(b.kids[y]) + 1) for _ in range(len(a.kids[x]) + 1)]
        for i, p in enumerate(a.kids[x]):
            for j, q in enumerate(b.kids[y]):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + most(a, b, p, q) if a.label[p] == b.label[q] else 0)
        return 1 + t[-1][-1]

    for cells in (0, 10_000):
        monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
        for _ in range(60):
            a, b = (wrappers.Page("".join(tree(3) for _ in range(r.randint(0, 4)))) for _ in "ab")
            got = wrappers.match(a, b)
            assert len(got) == most(a, b) and len(set(got.values())) == len(got)
            assert all(i == 0 or (a.label[i] == b.label[j] and got[a.parent[i]] == b.parent[j]) for i, j in got.items())
            assert all((i < k) == (j < got[k]) for i, j in got.items() for k in got if k != i)


def test_elias_fano_round_trip(tmp_path):
    r = np.random.default_rng(1)
    for n, universe in ((1, 10), (500, 1 << 32), (3000, 1 << 60), (200, 200), (4, 1 << 63)):
        v = np.sort(r.choice(universe, n, replace=False) if universe < 1000 else np.unique(r.integers(0, universe, n)))
        seq = ngramlm.EliasFano(v, universe, str(tmp_path / f"s{n}"))
        assert (seq.find(v) == np.arange(len(v))).all() and (seq.get(np.arange(len(v))) == v).all()
        probe = r.integers(0, universe, 500)
        assert [int(x) for x in seq.find(probe)] == [int(np.searchsorted(v, p)) if p in set(v.tolist()) else -1 for p in probe.tolist()]


def test_trie_successors(tmp_path):
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 34, 2000)).astype(np.uint64)
    codes = (np.arange(len(keys)) % 250 + 1).astype(np.uint8)
    trie = ngramlm.Trie(keys, codes, str(tmp_path))
    assert (trie.query(keys) == codes).all() and not trie.query(keys + np.uint64(1 << 35)).any()
    own = keys[keys >> np.uint64(32) == 2] & np.uint64(0xFFFFFFFF)
    assert (trie.successors_of(2)[0] == own).all()


def test_trie_searches_the_range_that_the_pointers_give(tmp_path, monkeypatch):
    pairs = [(1, 5), (1, 9), (2, 0), (2, 4), (7, 0), (7, 0xFFFFFFFF), (9, 1)]  # a range may begin with the value that ends the one before
    keys = np.array([c << 32 | w for c, w in pairs], np.uint64)
    trie = ngramlm.Trie(keys, np.arange(1, len(keys) + 1, dtype=np.uint8), str(tmp_path))
    asked = np.array(sorted({c << 32 | w for c in (1, 2, 3, 7, 9) for w in (0, 1, 4, 5, 9, 0xFFFFFFFF)}), np.uint64)
    held = {int(k): i + 1 for i, k in enumerate(keys)}
    assert trie.query(asked).tolist() == [held.get(int(k), 0) for k in asked]
    assert trie.successors_of(7)[0].tolist() == [0, 0xFFFFFFFF] and len(trie.query(asked[:0])) == 0
    used, get = [], trie.pointers.get
    monkeypatch.setattr(trie.pointers, "get", lambda i: used.append(len(i)) or get(i))
    trie.query(asked)
    assert used == [4, 4]  # both ends of the range of each context that is there


def test_lm_counts_and_scores(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ngramlm, "BLOCK_TOKENS", 3000)
    train = odd_docs.withColumn("train", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)))
    rows = [(r.doc_id, words(r.text) + [None], r.train) for r in train.select("doc_id", "text", "train").collect()]
    c = Counter(w for _, t, on in rows if on for w in t)
    pairs = Counter((v, w) for _, t, on in rows if on for v, w in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))

    def score(t):
        total = 0
        for a, b in zip([None, *t], t):
            p = round(64 * math.log10((c[b] - d if c[b] else d * v) / n)) / 64
            two = min(1, 2 ** (round(8 * math.log2(pairs[a, b])) / 8) / c[a]) if pairs[a, b] else 0
            total += math.log10(ngramlm.WEIGHT * two + (1 - ngramlm.WEIGHT) * 10**p) if c[a] else p
        return total

    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted(((i, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), score(t)) for i, t, _ in rows), key=key)
    got = sorted((tuple(r) for r in ngramlm.lm_scores(train).collect()), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5], rel=1e-6)
    assert ngramlm.lm_scores(train.limit(0)).count() == 0
    none = ngramlm.lm_scores(train.withColumn("train", F.lit(False))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in none)


STRICT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        double = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(double) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "phone": 10 <= len(d) <= 15}[kind]


def _spans(text):
    found = [(m.start(), j, k, m.end()) for j, k in enumerate(STRICT) for m in re.finditer(STRICT[k], text or "") if _passes(k, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(found)]


@pytest.fixture(scope="module")
def personal(spark):
    r = random.Random(4)
    bits = list("0123456789") * 2 + list(" -.+()@ab é日\n") + ["4111 1111 1111 1111", "+1 (988) 555-2485", "a.b@c.de", "@x.y.z", "1.2.3.4", "300.1.1.1", "\U0001F600"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 50))) for _ in range(800)] + [None, "", "1" * 9000, "a" * 9000 + "@b.c", "1 " * 4000, "x@" + "a." * 4000 + "b"]
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts + texts[:20])], "doc_id int, text string, base string, cand int")


def test_pii_base_spans_match_brute_force(personal):
    for r in pii.find_pii(personal).collect():
        own = [(s.kind, s.start, s.end) for s in r.base]
        assert own == _spans(r.row.text)
        found = [(s.kind, s.start, s.end) for s in r.found]
        assert set(own) <= set(found) and all(not (a[1] < b[2] and b[1] < a[2]) for a in set(found) - set(own) for b in own)


def test_pii_uses_no_python_on_executors(personal):
    plan = pii.redact(personal)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_redacts_and_keeps_columns(personal):
    out = pii.redact(personal)
    assert out.dtypes == personal.dtypes
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (personal, out))
    for i, t in before.items():
        if not _spans(t) and "@" not in (t or "") and len(re.sub("[^0-9]", "", t or "")) < 7:
            assert after[i] == t
    assert pii.redact(personal.limit(0)).count() == 0


def test_pii_em_trusts_agreeing_labelers():
    post = pii.estimate([("11111", 500), ("00000", 500), ("11101", 40), ("00010", 40), ("22222", 5)])
    assert post["11111"] > 0.95 > 0.05 > post["00000"] and post["11101"] > 0.5 > post["00010"]


def test_packing_is_complete_and_gapless(spark, odd_docs, docs):
    import public_tokenizers

    t = units.plain_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    both = odd_docs.where("doc_id is not null").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = both.collect()
    got = packing.pack_documents(both).toPandas()
    want = Counter()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        edges = sorted({0, *range(head, len(ids) + 1, 1024), len(ids)})
        for p, (s, e) in enumerate(zip(edges, edges[1:])):
            want[r.doc_id, p, s, e - s, zlib.crc32(np.asarray(ids[s:e], "<u4").tobytes())] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 1024) * 1.03 + 1
    assert packing.pack_documents(both.limit(0)).count() == 0


def test_best_two_fit_swaps_the_smallest():
    # greedy: 60 + 30 leaves 10; 20 + 19 fit the widened gap of 40 more tightly than 30
    counts = np.zeros(101, int)
    counts[[60, 30, 20, 19]] = 1
    plan = packing.best_two_fit(counts, 100)
    assert plan[0] == (1, [60, 20, 19]) and sorted(x for n, f in plan for x in f * n) == [19, 20, 30, 60]


def _cosine(rows, t=0.95):
    good = {i: np.array(e, float) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= t
    comp = {i: i for i, _ in rows}
    lab = np.array(ids)
    while True:
        new = np.where(s, lab[None, :], 1 << 60).min(1)
        if (new == lab).all():
            break
        lab = new
    comp |= dict(zip(ids, lab.tolist()))
    links = dict(zip(ids, (s.sum(1) - 1).tolist()))
    return {(i, links.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def test_epsilon_grid_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(epsgrid, "BLOCK", 32)
    monkeypatch.setattr(epsgrid, "LEAF", 8)
    r = np.random.default_rng(8)
    x = r.standard_normal((700, 16))
    x[100:300] = x[100] + 0.12 * r.standard_normal((200, 16))
    x[300:360] = x[300]
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [float("inf")] + [0.0] * 15), (804, [None] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    assert {tuple(g) for g in epsgrid.near_duplicates(v).collect()} == _cosine(rows)
    assert epsgrid.near_duplicates(v.limit(0)).count() == 0
    assert {tuple(g) for g in epsgrid.near_duplicates(v.where("vec_id >= 800")).collect()} == {(i, 0, i, True) for i in range(800, 805)}


def test_epsilon_grid_keeps_invalid_rows_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 0.0]), (1, [float("nan"), 1.0]), (1, [None, 1.0]), (2, [0.0, 1.0]), (2, []), (None, [1.0, 0.0])]
    got = Counter(tuple(r) for r in epsgrid.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == Counter({(1, 0, 1, True): 5, (2, 0, 2, True): 2, (None, 0, None, True): 1})


def test_pipeline_keeps_one_language_and_unlabelled_corpora(spark, tmp_path):
    import corpus_pipeline as cp

    common = "the cat and the dog sat on the mat and then the cat ran"
    rows = [(i, common, "en", 1) for i in range(40)] + [(100, "zyxwv qkjpf vuwzx", None, 2), (101, "12 !", None, 3), (102, None, "en", 4)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    assert langid.Profiles(langid.trained_profiles(one), langid.PROFILE).predict(rows[40][1])[1] <= 0.5
    for docs in (one, one.withColumn("lang", F.lit(None).cast("string"))):
        kept = cp.reject_unknown_language(spark, docs, "")
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 100}
    tied = langid.Profiles([("a", 0, ord("x")), ("b", 0, ord("x"))], langid.PROFILE)
    assert tied.decide("x")[2] is False
    one.select("doc_id", F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.reject_toxic(spark, one, str(tmp_path)).count() == one.count()


def test_pipeline_against_its_decisions(spark):
    """Each stage's rows, recomputed one document at a time from the stage's input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own"))
    docs = docs.unionByName(spark.createDataFrame([(90_001, None, None, None, None, "a"), (90_002, "12 34 !", "en", "s", 7, "b")], docs.schema)).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.trained_model(docs, labels)
    one = lambda t: float(model.scores(next(blocks(pa.array([t], pa.string()))))[0])
    kept = cp.reject_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if one(r.text) < toxicity.THRESHOLD}
    p = langid.Profiles(langid.trained_profiles(kept), langid.PROFILE)
    lang = cp.reject_unknown_language(spark, kept, SF).cache()
    assert {r.doc_id for r in lang.collect()} == {r.doc_id for r in kept.collect() if p.predict(r.text)[0] != "und" and p.predict(r.text)[1] > 0.5}
    single = cp.keep_one_of_each_group(spark, lang, SF).cache()
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in _jaccard([(r.doc_id, r.text) for r in lang.collect()])}
    clean = cp.redact_personal_data(spark, single, SF)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not _spans(r.text) and r.n_chars == len(r.text)
    assert [s for s, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "pii", "packing"]
    got = cp.run(spark, SF)
    assert got.select("doc_id").distinct().count() <= single.count()
