import zlib

import numpy as np
import pytest

from corpusmill.llm import language, toxicity
from corpusmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held_out(doc_id, n, left):
    return zlib.crc32(str(doc_id).encode()) % n == left


def test_gradients_equal_differences():
    network = toxicity.Network.new(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words = toxicity.Words.of(["foo", "barbar", "x", "été"])
    rng = np.random.default_rng(0)
    ids, mask = rng.integers(0, 4, (7, 5)), np.ones((7, 5))
    mask[4:, 1] = 0
    target, share = np.array([1, 0, 1, 0, 0.0]), np.array([1, 1, 0.7, 0.5, 1.0])

    def loss():
        logit, _ = network.run(network.gates(words)[ids], mask)
        p = 1 / (1 + np.exp(-logit))
        return -(share * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / share.sum()

    toxicity_run, network.run = network.run, lambda *a: toxicity_run(*a)
    grads = network.gradient(words, ids, mask, target, share)
    for name, g in grads.items():
        flat = network.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            keep, step = flat[at], 1e-3
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert (up - down) / (2 * step) == pytest.approx(g.ravel()[at], rel=0.02, abs=1e-5), name


def test_windows_cover_the_text():
    for n in (1, 47, 48, 49, 84, 85, 500):
        starts = toxicity.window_starts(n)
        assert {s + i for s in starts for i in range(toxicity.WINDOW) if s + i < n} == set(range(n))


def test_scores_do_not_depend_on_neighbours_or_blocks():
    network = toxicity.Network.new(2)
    texts = ["one two three " * k for k in (1, 30, 200)] + [None, "", "...", "one"]
    alone = [network.score([t])[0] for t in texts]
    assert np.allclose(network.score(texts), alone, atol=1e-6) and alone[3:6] == [0, 0, 0]


def test_toxicity_of_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(got) == 10_000
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for kind, least in ((1, 0.8), (0, 0.98)):
        own = [r.predicted == kind for r in got if r.held_out and labels.get(r.doc_id) == kind]
        assert sum(own) >= least * len(own)


def test_toxicity_of_odd_tables(spark):
    rows = [(i, "you idiot scum trash" if i % 3 == 0 else f"word{i} the nice and kind day", 0.5) for i in range(60)]
    rows += [(100, None, 1.0), (101, "", 1.0), (None, "you idiot", 1.0), (5, "  \x00 <>", 1.0), (5, "x " * 60_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, 0), (7, None)], "doc_id long, toxic int")
    got = toxicity.judge(docs, toxicity.learn(docs, labels))
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) and {r.score for r in got if not r.text} == {0.0}
    assert all(r.predicted == 1 for r in got if r.text and "idiot" in r.text)
    assert all(r.predicted == 0 for r in got if r.text and "nice" in r.text)
    unlearned = toxicity.learn(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.judge(docs, unlearned).collect()} == {0}
    assert toxicity.judge(docs.limit(0), unlearned).collect() == []


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_language"](spark, sf).collect()
    assert len(got) == len(langs) and all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in got)
    own = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert sum(own) >= 0.99 * len(own)
    assert sum(r.rejected for r in got) <= 2


def test_language_of_odd_tables(spark):
    en, de = "the quick brown fox and the lazy dog of the north", "der schnelle braune fuchs und der faule hund im norden"
    rows = [(i, f"{(en, de)[i % 2]} {i}", ("en", "de")[i % 2], i) for i in range(80)]
    rows += [(90, None, "en", 0), (91, "", "de", 0), (92, "12 34 !", "en", 0), (None, en, None, 0), (93, "中文" * 50, None, 0), (93, de * 3000, None, 0), (94, "İİ the", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.learn(docs)
    found = language.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = found.collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang and not r.rejected for r in got if r.doc_id is not None and r.doc_id < 80)
    assert [(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (90, 91, 92)] == [("und", 0, True)] * 3
    assert all(r.rejected for r in got if r.text and "中" in r.text)
    nothing = language.learn(docs.where("lang = 'xx'"))
    assert {(r.lang_pred, r.rejected) for r in language.identify(docs, nothing).collect()} == {("und", True)}
    assert language.identify(docs.limit(0), model).collect() == []


def plain_score(network, text):
    """One text, one window and one step at a time."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    words = toxicity.words_of(text)
    best, p = -np.inf, {k: v.astype(np.float64) for k, v in network.p.items()}
    for start in toxicity.window_starts(len(words)) if words else []:
        window = words[start : start + toxicity.WINDOW]
        vectors = []
        for w in window:
            one = toxicity.Words.of([w])
            grams = p["char"][one.gram].sum(axis=0) / one.n_grams[0] if len(one.gram) else np.zeros(p["char"].shape[1])
            vectors.append(np.concatenate((p["word"][one.bucket[0]], grams)))
        h = toxicity.HIDDEN
        states = np.zeros((len(window), 2 * h))
        for side, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
            state = np.zeros(h)
            for t in order:
                x = (vectors[t] @ p["wx"] + p["bx"])[3 * h * side : 3 * h * (side + 1)]
                u = state @ p["u"][side] + p["bu"][side, 0]
                z, r = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                state = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * state
                states[t, h * side : h * (side + 1)] = state
        attention = np.tanh(states @ p["wa"] + p["ba"]) @ p["va"]
        weight = np.exp(attention - attention.max())
        best = max(best, float(weight / weight.sum() @ states @ p["wo"] + p["bo"][0]))
    return sigmoid(best)


def test_scores_equal_a_plain_scorer():
    network = toxicity.Network.new(5)
    rng = np.random.default_rng(6)
    network.p = {k: v + 0.2 * rng.standard_normal(v.shape).astype(np.float32) for k, v in network.p.items()}
    texts = ["one", "a été b, İx", " ".join(f"w{i}" for i in range(130)), "x " * 48, "y z " * 30, ""]
    assert network.score(texts) == pytest.approx([plain_score(network, t) for t in texts], abs=1e-4)


def test_a_null_id_is_not_held_out(spark, tmp_path):
    rows = [(i, "the quick brown fox of the north", "en") for i in range(40)] + [(None, "the fox", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_toxicity", "op9_language"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 41 and [r.held_out for r in got if r.doc_id is None] == [False]


def test_language_of_one_text_does_not_depend_on_others(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    model = language.fit([t for t, _ in rows], [lang for _, lang in rows])
    texts = [t for t, _ in rows[:40]] + ["", "123", "a"]
    together = model.judge(texts)
    alone = [model.judge([t]) for t in texts]
    assert list(together[0]) == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone]) and list(together[2]) == [a[2][0] for a in alone]
