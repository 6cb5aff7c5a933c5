import random

import numpy as np

from millrace.llm import langid

EN = "the quick brown fox jumps over a lazy dog and then it sleeps under the old tree while rain falls on every leaf "
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann unter dem alten baum während regen fällt "


def shuffled(text, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(text.split()) for _ in range(n))


def count_phrases(symbols, sample):
    """Brute force: the longest match from each phrase's start, or one symbol."""
    n = 0
    for a in range(0, len(symbols), langid.BLOCK):
        text, at = bytes(symbols[a : a + langid.BLOCK]), 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            at, n = at + k, n + 1
    return n


def parser_of(samples):
    letters = sorted({c for t in samples.values() for c in langid.fold_table()[[ord(x) for x in t]].tolist()} - {0})
    p = langid.Parser(sorted(samples), letters, [], [])
    p.ready()
    texts = [p.symbols(samples[k]).tolist() for k in p.languages]
    p.automata = [langid.automaton(t) for t in texts]
    p.sizes = [len(t) for t in texts]
    p._tables = None
    p.ready()
    return p, [bytes(t) for t in texts]


def test_phrases_match_brute_force():
    p, samples = parser_of({"en": shuffled(EN, 200, 1), "de": shuffled(DE, 200, 2)})
    texts = [p.symbols(t) for t in ("a", "zzz", "漢字 über", shuffled(EN, 900, 3), shuffled(DE, 40, 4), "x" * 5000, "The FOX!! 12 the-fox")]
    got = p.phrases(texts)
    assert got.tolist() == [[count_phrases(t.tolist(), s) for s in samples] for t in texts]


def test_symbols_fold_case_and_join_gaps():
    p, _ = parser_of({"en": EN})
    assert np.array_equal(p.symbols("  The... FOX?"), p.symbols("the fox "))


def test_predictions(spark, docs_of):
    train = spark.createDataFrame([(i, shuffled(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "x y", None)], "doc_id long, text string, lang string")
    parser = langid.fit(train)
    assert parser.languages == ["de", "en"]
    docs = docs_of([(1, shuffled(EN, 50, 99)), (2, shuffled(DE, 50, 98).upper()), (3, None), (4, ""), (5, "12 ... !"), (6, shuffled(EN, 30000, 97)), (1, "the"), (None, "der hund")])
    got = [(r["id"], r["lang"], r["score"]) for r in langid.predict(docs, parser).collect()]
    assert [(i, lang) for i, lang, _ in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (1, "en"), (None, "de")]
    assert all(0 <= s <= 1 for _, _, s in got)


def test_no_labelled_row(spark, docs_of):
    parser = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang"] for r in langid.predict(docs_of([(1, "the")]), parser).collect()] == ["und"]
    assert langid.predict(docs_of([]), parser).count() == 0


def test_every_part_of_a_text_can_be_learnt(spark, docs_of):
    """Two languages whose texts agree in their first 20,000 characters are told apart by what follows."""
    start = "zzz yyy xxx " * 1700
    rows = [(i, start + shuffled(EN if i % 2 else DE, 4000, i), "en" if i % 2 else "de") for i in range(6)]
    parser = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(docs_of([(1, shuffled(EN, 60, 9)), (2, shuffled(DE, 60, 8))]), parser).orderBy("id").collect()
    assert [r["lang"] for r in got] == ["en", "de"]


def test_sample_is_bounded(spark):
    rows = [(i, shuffled(EN, 500, i), "en") for i in range(60)]
    parser = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces=10, size=50)
    assert parser.sizes[0] <= 10 * 51


def test_clashing_columns(spark):
    names = ["rows_of_lang", "held", "nth", "key", "at", "id", "score", "phrases"]
    df = spark.createDataFrame([(i, shuffled(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de", *range(8)) for i in range(20)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    got = langid.predict(df, langid.fit(df)).collect()
    assert [r["lang"] for r in sorted(got, key=lambda r: r["id"])] == ["de", "en"] * 10
