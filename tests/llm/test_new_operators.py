"""Collocations, chat formatting and whitening against brute force, round trips and numpy."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import chat, collocations, whiten
from runlens.llm.chat import Message

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- collocations ----


def _mined(rows, least, top):
    """Every rule of the query, phrase by phrase."""
    grams, total = {}, Counter()
    for text, lang in rows:
        own = grams.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 5):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in grams.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            if any(len(q) > len(g) and 100 * b >= 80 * a and any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1)) for q, b in often.items()):
                continue
            s, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))  # noqa: E741
            found.append((-s, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    r = random.Random(11)
    vocab = ["Ab", "cD", "é", "x" * 300, "e", "f", "g", "日本", " ", "h\x1fi"]
    fixed = ["new york city hall", "new york", "in vitro", "a a a a a", "salt, and pepper", "salt and pepper and salt"]
    rows = []
    for i in range(400):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(vocab) for _ in range(r.randint(0, 12))]
        rows.append((r.choice([" ", "\t", "  "]).join(parts) + r.choice(["", ".", "\n", "!?"]), r.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("only once", "xx"), (rows[0][0], "en")] * 3


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_match_counting_everything(spark, phrase_rows, monkeypatch, top):
    monkeypatch.setattr(collocations, "LEAST", 6)
    monkeypatch.setattr(collocations, "TOP", top)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 12)  # many phrases are counted by mistake
    docs = spark.createDataFrame([(t, x, i, "clash", 1.0) for i, (t, x) in enumerate(phrase_rows)], "text string, lang string, a long, w1 string, score double")
    got = sorted(map(tuple, collocations.collocations(docs.repartition(3)).collect()))
    assert got == _mined(phrase_rows, 6, top)
    assert len(got) > 10


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


def test_collocation_counts_in_small_buffers(spark, phrase_rows, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "SPREAD", 2)
    docs = spark.createDataFrame(phrase_rows * 6, "text string, lang string")
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == _mined(phrase_rows * 6, 30, 2000)


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**13 + i, 10**13 + 7 * i, 3 * 10**13 - i) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s"))
    assert [r.s for r in df.collect()] == [2000000 * a // (b + c) for a, b, c in rows]


# ---- chat formatting ----

PARTS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "ROLE]", "/ROLE]", " ", "a", "\n", "é日", *chat.CONTROLS]


def _odd(r):
    return "".join(r.choices(PARTS, k=r.randint(0, 8)))


def test_guard_is_reversible_and_breaks_every_control_string():
    for n in range(5):
        for parts in itertools.product(PARTS[:9], repeat=n):
            text = "".join(parts)
            safe = chat.guard(text)
            assert chat.unguard(safe) == text and not any(c in safe for c in chat.CONTROLS)
    r = random.Random(3)
    texts = {_odd(r) for _ in range(5000)}
    assert len({chat.guard(t) for t in texts}) == len(texts)


def test_formatted_turns_are_read_back():
    r = random.Random(4)
    made = chat.compile_template(chat.TEMPLATE)
    for _ in range(2000):
        turns = [Message(r.choice(["user", "assistant", "system", "", _odd(r)]), _odd(r)) for _ in range(r.randint(1, 6))]
        text, learned = "", []
        for part, spans in made.render(turns):
            learned += [chat.unguard(part[a:b]) for a, b in spans]
            text += part
        for size in (1, 3, len(text)):
            reader = chat.Reader()
            got = [t for i in range(0, len(text), size) for t in reader.feed(text[i : i + size])]
            reader.close()
            assert got == [(m.role, m.content) for m in turns]
        assert learned == [m.content for m in turns if m.role == "assistant"]


def _render(source, *turns):
    return "".join(t for t, _ in chat.compile_template(source).render(Message(*m) for m in turns))


def test_template_language():
    two = [("user", "Hi"), ("assistant", " yo ")]
    assert _render("{% for m in messages %}{{ loop.index }}:{{ m.role }}={{ m.content|trim|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", *two) == "1:user=HI, 2:assistant=YO"
    assert _render("{% set a = 'x' ~ 1 + 2 %}[{{ a }}{# none #}]  {%- if false %}no{% elif 1 < 2 and 'b' in 'abc' %} yes{% else %}no{% endif %}") == "[x3] yes"
    assert _render("{% for m in messages %}{{ loop.previous.role | default('-') }}<{{ m.role if loop.first else 'z' }}>{{ loop.next.role | default('-') }} {% endfor %}", *two) \
        == "-<user>assistant user<z>- "
    assert _render("{{ 'a\\n\\'b' }}{{ none }}{{ true }}{{ 'abc' | length }}{{ 5 - 2 }}") == "a\n'btrue33"
    assert _render("{% if true %}{% for m in messages %}{{ m.content }}{% endfor %}{% endif %}", *two) == "Hi yo "
    spans = [s for _, s in chat.compile_template("{% for m in messages %}a{% generation %}{{ m.content }}{% endgeneration %}{% endfor %}").render(Message(*m) for m in two)]
    assert spans == [[(1, 3)], [(1, 5)]]


def test_constants_are_folded():
    tree = chat.compile_template("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{{ 'D' | lower }}{% else %}{{ 'x' }}{% endif %}{% if false %}no{% endif %}e").tree
    assert tree == (chat.Text("ab1cde"),)
    (each,) = chat.compile_template("{% for m in messages %}{{ m.content ~ 'a' ~ ('b' if true else 'c') }}{% endfor %}").tree
    assert each.body[0].expr.args[1] == chat.Const("ab")


@pytest.mark.parametrize("source", [
    "{{ messages }}", "{{ open }}", "{{ m.__class__ }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ 'a'.join }}", "{{ 'a' | system }}",
    "{% for m in range %}{% endfor %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% include 'x' %}", "{{ 1", "{{ }}", "{% if 1 %}",
    "{% endif %}", "{{ 'a' * 3 }}", "{{ f(1) }}", "{% set loop = 1 %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ 'a' | default }}",
    "{% for m in messages %}{{ loop.next }}{% endfor %}", "{{ 1 + 'a' }}"])
def test_templates_outside_the_sandbox_are_refused(source):
    with pytest.raises(chat.TemplateError):
        out = chat.compile_template(source)
        assert out.tree == (chat.Text(source),)  # an open bracket alone is text
        raise chat.TemplateError


def _digests(turns):
    full, loss = hashlib.sha256(), "".join(t or "" for r, t in turns if r == "assistant")
    for role, text in turns:
        full.update(f"{role or ''}\n{text or ''}\n".encode())
    return len(turns), full.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_format_digests_and_conversations(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", _odd(r), "x" * 50_000])) for c in (None, 1, 2, 3, 40) for t in range(r.randint(1, 30))]
    rows += [(2, 0, "user", "again"), (2, None, "user", "no turn"), (2, None, "user", "no turn")]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, start string, part int")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: tuple((v is not None, v if v is not None else 0) if i < 2 else (v is not None, (v or "").encode()) for i, v in enumerate(x))):
        want.setdefault(c, []).append((role, text))
    got = {x.conv_id: x for x in chat.format_digests(df.repartition(3)).collect()}
    assert {c: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for c, x in got.items()} == {c: _digests(t) for c, t in want.items()}
    texts = {}
    for x in chat.format_conversations(df.repartition(3)).orderBy("conv_id", "part").collect():
        assert x.start == len(texts.get(x.conv_id, ""))
        texts[x.conv_id] = texts.get(x.conv_id, "") + x.text
        for a, b in x.learned:
            assert 0 <= a <= b <= len(texts[x.conv_id])
    assert {c: len(t) for c, t in texts.items()} == {c: x.formatted_chars for c, x in got.items()}
    assert chat.format_digests(df.limit(0)).count() == 0


def test_template_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {x.conv_id: x for x in chat.op12_template_compiler(spark, sf).collect()}
    want = {}
    for x in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(x.conv_id, []).append((x.role, x.text))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert {c: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for c, x in got.items()} == {c: _digests(t) for c, t in want.items()}


# ---- whitening ----


def _check_eigen(v, k=8):
    e, f = whiten.leading_components(v, k)
    want, size = np.linalg.eigvalsh(v)[::-1][: len(e)], max(1, np.abs(v).max())
    assert np.abs(e - want).max() <= 1e-13 * size * len(v)
    assert np.abs(f @ f.T - np.eye(len(f))).max() < 1e-12
    assert np.abs(f @ v - e[:, None] * f).max() <= 1e-12 * size * len(v)


def test_eigensolver_matches_numpy_also_in_clusters():
    r = np.random.default_rng(0)
    for d in (1, 2, 3, 9, 64):
        x = r.standard_normal((200, d)) * r.uniform(1, 100, d)
        _check_eigen(np.cov(x.T, bias=True).reshape(d, d))
    q = np.linalg.qr(r.standard_normal((20, 20)))[0]
    for spread in (0, 1e-14, 1e-9, 1e-4):
        _check_eigen((v := (q * np.r_[5 + spread * np.arange(12), r.uniform(0, 4, 8)]) @ q.T) / 2 + v.T / 2)
    _check_eigen(np.eye(12))
    _check_eigen(np.kron(np.eye(5), np.array([[2.0, 1], [1, 2]])))
    _check_eigen(np.ones((7, 7)))


def test_sturm_counts():
    r = np.random.default_rng(1)
    d, e = r.standard_normal(15), r.standard_normal(14)
    e[4] = 0
    w = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.r_[w - 1e-6, w + 1e-6, -100, 100]
    assert (whiten.count_below(d, e, at) == (w < at[:, None]).sum(1)).all()


def _whitened(rows):
    """Integer vectors, exact deviations and numpy's components."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100000 for c in v] for _, v in rows]
    n, dim = len(x), max(map(len, x))
    x = [v + [100000] * (dim - len(v)) for v in x]
    sums = [sum(v[i] for v in x) for i in range(dim)]
    dev = [sum((n * v[i] - sums[i]) ** 2 for i in range(dim)) for v in x]
    y = np.array([[(n * v[i] - sums[i]) / n for i in range(dim)] for v in x])
    w, q = np.linalg.eigh(y.T @ y / n)
    return n, dev, y, w[::-1], q[:, ::-1]


@pytest.mark.parametrize("huge", [False, True])
def test_whitening_matches_numpy(spark, huge):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.standard_normal(12) * np.arange(1, 13)]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[5][1]), (400, [0.0] * 12), (401, [1.5, -2.0]), (402, [])]
    if huge:
        rows.append((500, [2.0**41, *[0.0] * 11]))
    odd = [(600, None), (601, [1.0, None]), (602, [float("nan")] * 12), (603, [float("inf")] * 12)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows + odd], "vec_id long, embedding array<double>, n int, whitened string").repartition(5)
    got = whiten.whiten(df).toPandas()
    n, dev, y, w, q = _whitened(rows)
    kept = min(8, int((w > whiten.RANK * w.sum()).sum()))
    assert len(got) == n * kept and (got.n == n).all()
    fits = [d if d < 1 << 63 else None for d in dev]
    first = whiten.whiten(df).where("component = 1").select("vec_id", "deviation").collect()
    assert Counter(map(tuple, first)) == Counter((i, d) for (i, _), d in zip(rows, fits))
    assert got.identity_error.iloc[0] < 1e-6 and got.identity_error.nunique() == 1
    for c in range(1, kept + 1):
        mine = got[got.component == c].sort_values("whitened")
        assert abs(mine.explained.iloc[0] / (w[c - 1] / w.sum()) - 1) < 1e-9
        z = y @ q[:, c - 1] / np.sqrt(w[c - 1])
        if not huge:
            assert min(np.abs(np.sort(z) - mine.whitened).max(), np.abs(np.sort(-z) - mine.whitened).max()) < 1e-7


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    two = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [(x.vec_id, x.component, round(abs(x.whitened), 9), round(x.explained, 9)) for x in sorted(two)] == [(1, 1, 1, 1), (2, 1, 1, 1)]


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    got = whiten.op13_whitening(spark, sf)
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("embedding").isNotNull()).collect()]
    n, dev, _, w, _ = _whitened(rows)
    first = got.where("component = 1").collect()
    assert {x.vec_id: x.deviation for x in first} == {i: d for (i, _), d in zip(rows, dev)}
    assert got.count() == 8 * n and abs(first[0].explained / (w[0] / w.sum()) - 1) < 1e-9
