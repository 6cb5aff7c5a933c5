import random
import re

import pytest

from millrace.llm import decontam


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def grams(w, k):
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if v:
                k = min(5, len(v))
                own = grams(v, k)
                n = len(own & grams(w, k))
                if n >= 0.8 * len(own) - 1e-9:
                    out.append((d, i, len(own), n))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["é", "Ünder", "漢", "the", "a"]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(r.choice([1, 2, 4, 5, 6, 12, 30, 45]))) for i in range(40)] + [(100, None), (101, ""), (102, "...!"), (None, prose(20)), (103, "Solo"), (104, prose(20)), (104, prose(20))]
    items.append((105, items[5][1]))
    docs = [(0, None), (1, ""), (2, "!!"), (3, "x" * 50_000), (4, items[7][1]), (4, items[7][1]), (5, "SOLO")]
    for d in range(10, 90):
        t = prose(r.randrange(1, 400))
        for _ in range(r.randrange(3)):
            x = (r.choice(items)[1] or "").split(" ")
            if r.random() < 0.6:
                x[r.randrange(len(x))] = "zz"
            if r.random() < 0.3:
                x = [y.upper() + "," for y in x]
            t += "\n" + " ".join(x) + "\t" + prose(r.randrange(60))
        docs.append((d, t))
    docs.append((90, prose(30_000) + " " + items[7][1] + " " + prose(30_000)))
    return docs, items


@pytest.mark.parametrize(("seed", "chunk", "block"), [(1, 1 << 21, 1 << 24), (2, 3000, 900)])
def test_matches_brute_force(spark, docs_of, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(decontam, "CHUNK", chunk)
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs_of(docs), bench, block=block).collect()
    assert sorted(((r["id"], r["item"], r["n_shingles"], r["n_shared"]) for r in got), key=str) == brute(docs, items)
    kept = decontam.clean(docs_of(docs), bench, block=block)
    assert kept.columns == docs_of(docs).columns
    leaked = {x[0] for x in brute(docs, items)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_long_texts_in_parts(monkeypatch):
    docs, items = corpus(3)
    index = decontam.Index(items, 5, 0.8)
    whole = decontam._matches(index, docs, decontam.Shingler())
    monkeypatch.setattr(decontam, "CHUNK", 64)
    assert {k: sorted(v) for k, v in decontam._matches(index, docs, decontam.Shingler()).items()} == {k: sorted(v) for k, v in whole.items()}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(docs_of([(1, "a")]), none).count() == 0
    assert decontam.contaminated(docs_of([]), some).count() == 0
    assert decontam.clean(docs_of([(1, "a")]), none).count() == 1
