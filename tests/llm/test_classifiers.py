"""Quality (9), language (3), toxicity (6)."""

import numpy as np
import pytest

from tessera.llm import _text, language_id, quality, toxicity

BIG = "/root/testdata/sf0.01"


def _buffers(texts):
    import pyarrow as pa

    data, offsets, _ = _text.column_buffers(pa.array(texts))
    return data, offsets


@pytest.fixture(scope="module")
def big(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    return docs, half, {r.doc_id: r for r in labels.where("doc_id % 2 = 1").collect()}


def test_quality_held_out(big):
    docs, half, held = big
    out = {r.doc_id: r.keep for r in quality.score(docs, quality.fit(docs, half)).collect()}
    good = [out[d] for d, r in held.items() if r.quality]
    bad = [out[d] for d, r in held.items() if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.01


def test_quality_threshold_is_a_quantile_of_all_good_scores(spark):
    rng = np.random.default_rng(4)
    score = np.concatenate(([-90.0, -80.0], rng.normal(5, 1, 4998)))
    rows = [(i, float(x)) for i, x in enumerate(score)] + [(0, 3.0), (9000, 1.0), (9001, None), (None, -99.0)]
    labels = spark.createDataFrame([(i, 1) for i in range(5000)] * 2 + [(9000, 0), (9001, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    scores = spark.createDataFrame(rows, "doc_id bigint, score double")
    for q in (0.0, 0.0002, 0.002, 0.1):
        t = quality.threshold(scores, labels, q)
        under = int((score < t).sum())
        assert under <= q * 5000 and (score < t + 1 / quality.STEPS).sum() > q * 5000 - 1e-9
    assert quality.threshold(scores, labels.limit(0)) == -np.inf


def test_scoring_once_gives_the_same(documents, labels):
    key = lambda df: sorted((r.doc_id, r.score if r.score is not None else -1e9, r.keep) for r in df.collect())
    assert key(quality.ranked(documents, labels)) == key(quality.score(documents, quality.fit(documents, labels)))


def test_quality_and_ngrams_of_long_texts_in_windows(monkeypatch):
    texts = ["Some words, words!! again " * 30, "É" * 99 + "..", "", "12 ab"]
    data, offsets = _buffers(texts)
    x, grams = quality.features(data, offsets), language_id.each_presence(data, offsets)
    monkeypatch.setattr(_text, "WINDOW", 50)
    monkeypatch.setattr(_text, "_powers", [])
    assert (quality.features(data, offsets) == x).all()
    for k, want in enumerate(grams):
        row, gram = language_id.presence(data, offsets[k : k + 2])
        assert (gram == want).all() and not row.any()


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    true = x @ np.array([2.0, -1.0, 0.0])
    i, j = rng.integers(0, 400, (2, 5000))
    win = rng.random(5000) < 1 / (1 + np.exp(true[j] - true[i]))
    w = quality.fit_pairs(x, np.where(win, i, j), np.where(win, j, i))
    assert np.allclose(w, [2, -1, 0], atol=0.15)
    d = x[np.where(win, i, j)] - x[np.where(win, j, i)]
    gradient = 1e-6 * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d)
    assert np.abs(gradient).max() < 1e-6


def test_quality_features_by_hand():
    x = quality.features(*_buffers(["AB cd cd 12!!", ""]))
    assert np.allclose(x[0, :6] ** 2, [2 / 10, 2 / 10, 2 / 10, 0, 1 / 10, 1 / 4]) and not x[1, :6].any()


def test_language_held_out(spark, big):
    docs, _, _ = big
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    odd = docs.where("doc_id % 2 = 1")
    out = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert np.mean([out[r.doc_id].language == r.lang for r in odd.select("doc_id", "lang").collect()]) > 0.95
    assert np.mean([r.keep for r in out.values()]) > 0.99
    other = spark.createDataFrame([(1, "Привет, как дела сегодня? Всё хорошо."), (2, "今天天气很好，我们去公园散步。")], "doc_id bigint, text string")
    assert not any(r.keep for r in language_id.identify(other, model).collect())


def test_a_language_of_long_texts_is_learnt(spark):
    rng = np.random.default_rng(5)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, text("abcdefg ", 200), "short") for i in range(30)] + [(100 + i, text("uvwxyz ", 60_000), "long") for i in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["long", "short"]
    new = spark.createDataFrame([(1, text("uvwxyz ", 50_000)), (2, text("uvwxyz ", 150)), (3, text("abcdefg ", 150))], "doc_id bigint, text string")
    assert {r.doc_id: r.language for r in language_id.identify(new, model).collect()} == {1: "long", 2: "long", 3: "short"}


def test_packed_ngrams_round_trip():
    for n in (0, 3, 9000, 200_000):
        gram = np.sort(np.random.default_rng(n).choice(1 << language_id.HASH_BITS, n, replace=False))
        assert (language_id._unpacked(language_id._packed(gram)) == gram).all() and len(language_id._packed(gram)) <= 1 << 15


def test_pieces_hold_whole_characters():
    raw = np.frombuffer("aé漢😀".encode(), np.uint8)
    for a in range(len(raw)):
        for b in range(a, len(raw) + 1):
            x, y = language_id._characters(raw, np.array([a, b]))
            assert a <= x <= y <= b and bytes(raw[x:y]).decode() in "aé漢😀"


def test_language_matrix_is_the_kernel_machine():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdef " if i % 2 else "uvwxyz "), 80)) for i in range(60)]
    grams = [language_id.each_presence(*_buffers([t]))[0] for t in texts]
    model, coefficients, marks = language_id.train(grams[:40], ["x" if i % 2 else "y" for i in range(40)], 16)
    slow = language_id.kernel(grams, marks) @ coefficients
    assert np.allclose(model.scores(*_buffers(texts)), slow, atol=1e-6)
    assert [model.languages[k] for k in slow[40:].argmax(1)] == ["x" if i % 2 else "y" for i in range(40, 60)]


def test_presence_by_hand():
    row, gram = language_id.presence(*_buffers(["abab", "AB", "", "a"]))
    assert np.bincount(row, minlength=4).tolist() == [2 + 2 + 1, 1, 0, 0]
    assert set(gram[row == 1]) <= set(gram[row == 0])


def test_toxicity_held_out(big):
    docs, half, held = big
    out = {r.doc_id: r for r in toxicity.grades(docs, toxicity.fit(docs, half)).collect()}
    toxic = [out[d] for d, r in held.items() if r.toxic and r.doc_id in out]
    clean = [out[d] for d, r in held.items() if not r.toxic]
    assert np.mean([r.toxic for r in clean]) < 0.03
    assert np.mean([r.severity for r in toxic]) > np.mean([r.severity for r in clean]) + 0.5
    # some documents are labelled toxic without any word that others share; of those with one, nearly all are found
    words = "trash idiot clown scum worthless moron pathetic loser stupid disgusting".split()
    telling = {r.doc_id for r in docs.collect() if set(words) & set((r.text or "").lower().replace(".", " ").replace(",", " ").split())}
    assert np.mean([out[d].toxic for d in held if d in telling]) >= 0.9
    assert np.mean([r.toxic for r in toxic]) >= 0.6  # 9 of the 51 in the table hold none of the words


def test_grades_and_telling_words_by_hand():
    # 40 clean documents hold word 0; toxic ones hold it and, each, one to three of the words 1 to 3
    y = np.array([0] * 40 + [1] * 12)
    held = [[0]] * 40 + [[0, 1], [0, 2], [0, 3], [0, 1], [0, 1, 2], [0, 1, 3], [0, 2, 3], [0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3], [0]]
    row, col = np.repeat(np.arange(52), [len(h) for h in held]), np.concatenate(held)
    assert toxicity.telling(row, col, y > 0, 4).tolist() == [False, True, True, True]
    assert toxicity.grade(row, col, y, 4).tolist() == [0] * 40 + [1] * 4 + [2] * 4 + [3] * 3 + [1]


def test_given_grades_are_learnt(spark):
    rng = np.random.default_rng(6)
    level = rng.integers(0, 3, 600)
    rows = [(i, " ".join(["the", "of", *(["mild"] if g > 0 else []), *(["grave"] if g > 1 else []), f"w{rng.integers(50)}"])) for i, g in enumerate(level.tolist())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(level)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.grades(docs, toxicity.fit(docs, labels.where("doc_id < 300"), graded=True)).collect()}
    assert np.mean([got[i].grade == level[i] for i in range(300, 600)]) > 0.98
    assert all(abs(got[i].severity - level[i]) < 0.6 for i in range(300, 600))


def test_the_penalty_is_chosen_by_held_out_loss():
    rng = np.random.default_rng(7)
    y = (rng.random(400) < 0.3).astype(int)
    telling = [np.flatnonzero((rng.random(400) < 0.8) & (y > 0)) for _ in range(3)]
    noise = [rng.choice(400, 4, replace=False) for _ in range(300)]
    row, col = np.concatenate(telling + noise), np.repeat(np.arange(303), [len(x) for x in telling + noise])
    penalty = toxicity.chosen_penalty(row, col, y, 303, 2)
    w, t = toxicity.fit_ordinal(row, col, y, 303, 2, penalty)
    assert penalty in toxicity.PENALTIES and (w[:3] > 1).all() and np.abs(w[3:]).mean() < 0.3
    # the loss is that of the slow formula
    s = np.array([w[col[row == k]].sum() for k in range(400)])
    p = 1 / (1 + np.exp(-(s - t[0])))
    assert toxicity.loss(w, t, row, col, y) == pytest.approx(-np.log(np.where(y > 0, p, 1 - p)).mean())


def test_ordinal_regression_recovers_weights():
    rng = np.random.default_rng(3)
    n, m = 6000, 6
    x = rng.random((n, m)) < 0.4
    true, cuts = np.array([3.0, 1.5, -2.0, 0.0, 0.0, 1.0]), np.array([0.5, 2.5])
    y = ((x @ true + rng.logistic(size=n))[:, None] > cuts).sum(1)
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, col, y, m, 3, steps=1500)
    assert np.allclose(w, true, atol=0.25) and np.allclose(t, cuts, atol=0.25) and t[0] < t[1]
    m_ = toxicity.Model(w, t)
    p = m_.above(np.array([0.0, 3.0]))
    assert (p[:, 0] >= p[:, 1]).all() and (p[1] > p[0]).all()


def test_awkward_rows(spark, awkward, awkward_rows, no_docs, labels, documents):
    n = len(awkward_rows)
    q = quality.fit(documents, labels)
    got = quality.score(awkward, q).collect()
    assert len(got) == n and all((r.score is None) == (not t or not t.strip()) for r, t in zip(sorted((r for r in got if r.doc_id in range(1, 7)), key=lambda r: r.doc_id), [r[1] for r in awkward_rows[:6]], strict=True))
    assert len({(r.score, r.keep) for r in got if r.doc_id == 30}) == 1
    kept = quality.keep_good(awkward, q)
    assert kept.schema == awkward.schema and kept.count() == sum(r.keep for r in got)
    lm = language_id.fit(documents)
    got = language_id.identify(awkward, lm).collect()
    assert len(got) == n and all(not r.keep and r.language is None for r in got if r.doc_id in (1, 2, 3))
    assert language_id.keep_known(awkward, lm).schema == awkward.schema
    tm = toxicity.fit(documents, labels)
    got = toxicity.grades(awkward, tm).collect()
    assert len(got) == n and all((r.severity is None) == (r.doc_id == 1) for r in got if r.doc_id in (1, 2, 3, 4, 5, 6)) and not any(r.toxic for r in got if r.severity is None)
    empty_labels = labels.limit(0)
    for fitted in (quality.fit(no_docs, labels), quality.fit(documents, empty_labels)):
        assert quality.score(no_docs, fitted).count() == 0
        assert all(r.keep for r in quality.score(documents, fitted).collect())
    assert language_id.identify(no_docs, language_id.fit(no_docs)).count() == 0
    assert not any(r.keep for r in language_id.identify(documents, language_id.fit(no_docs)).collect())
    none = toxicity.fit(documents, empty_labels)
    assert toxicity.grades(no_docs, none).count() == 0
    assert all(r.severity == 0 and not r.toxic for r in toxicity.grades(documents, none).collect())
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    assert np.allclose(quality.fit(documents.union(documents), twice).w, q.w)
