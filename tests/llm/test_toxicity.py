import random

import numpy as np
import pytest

from millrace.llm import toxicity

BAD = ["grumblefoot", "snotnose", "blockhead"]


def text(seed, bad, n=60):
    r = random.Random(seed)
    words = [r.choice("the a rain tree river stone cloud green walk slowly under over near old house".split()) for _ in range(n)]
    if bad:
        for _ in range(2):
            words[r.randrange(n)] = r.choice(BAD)
    return " ".join(words)


def rows(lo, hi):
    return [(i, text(i, i % 4 == 0), float(i % 4 == 0), "en") for i in range(lo, hi)]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(rows(0, 600) + [(9000, None, 1.0, "en"), (9001, "x", None, "en"), (9002, "12 3", 0.0, None)], "doc_id long, text string, toxic double, lang string")
    return toxicity.fit(df)


def test_held_out(spark, model):
    held = rows(1000, 1200)
    df = spark.createDataFrame(held, "doc_id long, text string, toxic double, lang string")
    got = {r["id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y, _ in held) >= 196


def test_odd_texts(docs_of, model):
    long = " ".join(["tree river"] * 120_000)
    got = {r["id"]: r["score"] for r in toxicity.score(docs_of([(1, None), (2, ""), (3, "12 !!"), (4, long), (5, long + " snotnose blockhead " + long), (6, "x" * 300_000), (7, "a")]), model).collect()}
    assert len(got) == 7 and got[1] == got[2] == got[3] and got[4] < 0.5 <= got[5]
    assert toxicity.score(docs_of([]), model).count() == 0
    assert [r["score"] for r in toxicity.score(docs_of([(1, "a")]), None).collect()] == [0.0]


def test_clean_keeps_columns(docs_of, model):
    docs = docs_of([(1, "tree river"), (2, "snotnose blockhead snotnose"), (3, None)])
    got = toxicity.clean(docs, model)
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [1, 3]


def test_parts_give_the_same_scores(model, monkeypatch):
    words = toxicity.Words()
    features = [words.features(words.letters(text(i, i % 3 == 0, 400))) for i in range(5)]
    whole = toxicity.scores_of(model, features)
    monkeypatch.setattr(toxicity, "CHUNK", 240)
    assert np.allclose(whole, toxicity.scores_of(model, features), atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    words = toxicity.Words()
    xs = [words.features(words.letters(text(i, i % 2 == 0, 12))) for i in range(6)]
    y = np.array([1.0, 0, 1, 0, 1, 0])
    m = toxicity.train(xs * 4, np.tile(y, 4))
    m.embed = (m.embed + rng.normal(0, 0.2, m.embed.shape)).astype(np.float64)
    m.filters, m.weight = [f.astype(np.float64) for f in m.filters], m.weight.astype(np.float64)
    x, bounds = np.concatenate(xs), np.concatenate(([0], np.cumsum([len(a) for a in xs])))

    def loss():
        p = toxicity._sigmoid(m.pooled(x, bounds) @ m.weight + m.bias)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = toxicity._gradients(m, x, bounds, y, np.ones(6), m.bias)
    spots = [(m.embed, g[0], tuple(np.unravel_index(np.abs(g[0]).argmax(), g[0].shape)))] + [(f, d, tuple(np.unravel_index(np.abs(d).argmax(), d.shape))) for f, d in zip(m.filters, g[1:4], strict=True)]
    for p, d, at in spots:
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert d[at] == pytest.approx((up - down) / 2e-5, rel=0.05, abs=2e-3)


def test_one_label_gives_no_model(spark):
    assert toxicity.fit(spark.createDataFrame(rows(1, 4), "doc_id long, text string, toxic double, lang string")) is None


def response(model, words, texts_words, i, span, k):
    """One filter's response to the window of words from i on, by plain sums; words past the end are zeros."""
    total = float(model.shift[toxicity.SPANS.index(span)][k])
    w = model.filters[toxicity.SPANS.index(span)].reshape(span, toxicity.WIDTH, -1)
    for o in range(span):
        if i + o < len(texts_words):
            vector = sum(model.embed[b] for b in texts_words[i + o])
            total += float((vector * w[o, :, k]).sum())
    return total


def brute_score(model, text):
    """A text's score by loops over words, filters and windows."""
    words = toxicity.Words()
    letters = words.letters(text or "")
    rows = []
    for run in "".join(chr(c) if c else " " for c in letters).split(" "):
        if run:
            rows.append(words.features(words.letters(run))[0].tolist())
    logit = model.bias
    for s, span in enumerate(toxicity.SPANS):
        for k in range(toxicity.FILTERS):
            starts = range(max(1, len(rows) - span + 1)) if rows else []
            best = max([0.0, *(response(model, words, rows, i, span, k) for i in starts)])
            logit += best * float(model.weight[s * toxicity.FILTERS + k])
    profile = np.zeros(toxicity.PROFILE)
    for c in letters[letters != 0].tolist():
        profile[c % toxicity.PROFILE] += 1
    near = [float(np.sqrt(profile) @ p) for p in model.profiles]
    cut = model.cuts[near.index(max(near))] if profile.any() else model.cuts[-1]
    return 1 / (1 + np.exp(-(logit - cut)))


def test_scores_match_brute_force(docs_of, model):
    texts = [None, "", "!!", "a", "tree", "snotnose", "Tree RIVER blockhead", "grumblefoot snotnose", "漢字 é tree", text(1, True), text(2, False), "the " * 300]
    got = {r["id"]: r["score"] for r in toxicity.score(docs_of(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_score(model, t), abs=1e-4), t


def test_long_labelled_texts_train(spark):
    """What makes a text toxic stands after 50,000 characters here, and in no short text."""
    long = [(i, ("tree river stone " * 3000) + ("grumblefoot blockhead " if i % 2 else "cloud green ") + "walk " * i, float(i % 2), "en") for i in range(60)]
    got = toxicity.fit(spark.createDataFrame(long, "doc_id long, text string, toxic double, lang string"))
    held = spark.createDataFrame([(1, "tree grumblefoot blockhead"), (2, "tree cloud green")], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in toxicity.score(held, got).orderBy("id").collect()] == [True, False]


def test_repeated_rows_null_ids_and_clashing_columns(spark, model):
    names = ["id", "score", "toxic", "predicted", "kept"]
    df = spark.createDataFrame([(i, t, *range(5)) for i, t in [(1, "snotnose"), (1, "snotnose"), (None, "tree"), (None, None)]], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = toxicity.score(df, model).collect()
    assert [r["id"] for r in got] == [1, 1, None, None] and got[0]["score"] == got[1]["score"]
    assert toxicity.clean(df, model).columns == df.columns
