import random

import xxhash

from millrace.llm import simhash


def brute(rows, shingle=3, radius=3):
    fps = {}
    for i, t in rows:
        w = []
        for c in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
            if c:
                w.append(c)
        grams = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= radius:
                a, b = root(x), root(y)
                comp[max(a, b)] = min(a, b)
    return {i: (fps[i], root(i)) for i in ids}


def corpus(n, seed):
    r = random.Random(seed)
    words = ["ab", "CD", "éx", "ef g", "hi", "k", "lm", "nop", "K"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b"), (6, "x" * 70000), (7, "ab cd ef " * 9000)]
    while len(rows) < n:
        if r.random() < 0.5 and len(rows) > 20:
            w = r.choice(rows[10:])[1].split(" ")
            if r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
        else:
            rows.append((len(rows), " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(r.randrange(1, 90)))))
    return rows


def test_groups_match_brute_force(docs_of):
    rows = corpus(400, 1)
    got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.simhash_groups(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_small_leaves_find_the_same_links(spark, docs_of):
    rows = corpus(300, 2)
    fps = simhash.fingerprints(docs_of(rows)).select("fp").distinct()
    pairs = lambda df: sorted(map(tuple, df.collect()))
    from millrace.llm._graph import components

    whole = components(simhash.links(fps, 3), "a", "b")
    split = components(simhash.links(fps, 3, leaf=4), "a", "b")
    assert pairs(whole) == pairs(split) and pairs(whole)


def test_empty_table(docs_of):
    assert simhash.simhash_groups(docs_of([])).count() == 0


def test_one_row_and_repeated_rows(docs_of):
    got = simhash.simhash_groups(docs_of([(5, "a b c"), (5, "a b c"), (9, None)])).collect()
    assert sorted((r["id"], r["component"]) for r in got) == [(5, 5), (5, 5), (9, 9)]


def test_least_of_groups(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f"), (5, "quite another text of its own"), (2, "quite another text of its own"), (None, "alone here"), (None, None), (1, "")]
    names = ["id", "fp", "component", "mark", "row", "kept_id"]
    df = spark.createDataFrame([(i, t, *range(6)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = simhash.least_of_groups(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, "a b c d e f")] * 2 + [(2, "quite another text of its own"), (None, "alone here"), (1, "")], key=str)
