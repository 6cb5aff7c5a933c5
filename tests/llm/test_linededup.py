import random
import re
import zlib

import pytest

from millrace.llm import linededup

NO_ID = -(2**63)


def split(t):
    return re.sub(r"(?:\n|[.!?] )[ \t\r\n]*", "\\g<0>\x01", (t or "").replace("\x01", " ")).split("\x01")


def words(key):
    return len(re.split(r"[ \t\r\n]+", key)) if key else 0


def rows_of(rows):
    """Rows in their order as key to (lines, keys, words)."""
    out = {}
    for i, v, t in sorted({(NO_ID if i is None else i, zlib.crc32((t or "").encode()), t or "") for i, t in rows}):
        own = split(t)
        keys = [x.strip(" \t\r\n") for x in own]
        out[i, v] = (own, keys, [words(k) for k in keys])
    return out


def outcome(docs, gone):
    out = {}
    for k, (own, _, _) in docs.items():
        flags = [(k, i) in gone for i in range(len(own))]
        runs = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        out[k] = (len(own), sum(flags), runs, "".join(x for x, f in zip(own, flags, strict=True) if not f))
    return out


def by_runs(rows, min_words=20):
    """The definition: for any two positions, the longest run that both share; key of a row to (lines, removed, runs, kept)."""
    docs = rows_of(rows)
    flat = [(k, i) for k, (own, _, _) in docs.items() for i in range(len(own))]
    key = [docs[k][1][i] for k, i in flat]
    last = [i + 1 == len(docs[k][0]) for k, i in flat]
    gone, before = set(), {}
    for q, (k, i) in enumerate(flat):
        now = {}
        for p in range(q):
            if key[p] == key[q]:
                now[p] = before.get(p - 1, 0) + 1 if i and flat[p][1] else 1
                if last[p] or last[q] or key[p + 1] != key[q + 1]:
                    a, z = i - now[p] + 1, i
                    w = docs[k][2]
                    while a <= z and not w[a]:
                        a += 1
                    while a <= z and not w[z]:
                        z -= 1
                    if sum(w[a : z + 1]) >= min_words:
                        gone |= {(k, x) for x in range(a, z + 1)}
        before = now
    return outcome(docs, gone)


def brute(rows, min_words=20):
    """The same by all runs of ``min_words`` words or more, up to the ones that add a line at most to such a run."""
    docs, seen, gone = rows_of(rows), set(), set()
    for k, (own, keys, w) in docs.items():
        for a in range(len(own)):
            total = 0
            for z in range(a, len(own)):
                total += w[z]
                if w[a] and w[z] and total >= min_words:
                    if tuple(keys[a : z + 1]) in seen:
                        gone |= {(k, x) for x in range(a, z + 1)}
                    seen.add(tuple(keys[a : z + 1]))
                    if total - w[a] >= min_words:
                        break
    return outcome(docs, gone)


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(["a", "be", "see", "é", "漢"]) + str(r.randrange(40)) for _ in range(n)) + r.choice([". ", "\n", "! ", "? ", ".\n"])
    passage = ["".join(line(r.randrange(2, 14)) for _ in range(r.randrange(1, 9))) for _ in range(6)] + [line(30), line(20), line(19)]
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, "one line"), (4, "x. " * 900), (5, "\x01 a\x01b. c"), (6, line(5) * 9)]
    for i in range(7, 90):
        t = "".join(line(r.randrange(1, 12)) for _ in range(r.randrange(6)))
        for _ in range(r.randrange(3)):
            t += r.choice(passage) + "".join(line(r.randrange(1, 12)) for _ in range(r.randrange(3)))
        rows.append((i, t))
    rows += [(30, rows[30][1]), (31, "other text. " + passage[0]), (None, passage[1]), (200, rows[40][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(docs_of, seed):
    rows = corpus(seed)
    want = by_runs(rows) if seed == 1 else brute(rows)
    assert want == brute(rows)
    got = linededup.dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        i, text = r["row"]["doc_id"], r["row"]["text"]
        n, m, k, kept = want[NO_ID if i is None else i, zlib.crc32((text or "").encode())]
        assert (r["n_lines"], r["n_removed"], r["n_runs"]) == (n, m, k), i
        assert r["kept"] == (text if not k else kept)
    assert sum(r["n_runs"] for r in got) > 10


def planted(seed, trials):
    """Two-line repeats of 22 words; runs of 12 words of two documents that touch; a run whose first lines stand earlier elsewhere."""
    r = random.Random(seed)
    line = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n)) + ". "
    rows, at, expect = [], 0, {}
    for _ in range(trials):
        two = line(12) + line(10)
        rows += [(at, line(7) + line(5) + two + line(9)), (at + 1, line(6) + line(8) + two + line(4))]
        expect[at + 1] = 2
        a, b = line(7) + line(5), line(5) + line(7)
        rows += [(at + 2, line(9) + a + line(3)), (at + 3, line(9) + b + line(3)), (at + 4, line(3) + a + b + line(3))]
        expect[at + 4] = 0
        x, y, z = line(7), line(7), line(9)
        rows += [(at + 5, line(4) + x + y + line(8)), (at + 6, line(5) + x + y + z + line(6)), (at + 7, x + y + z + line(7))]
        expect[at + 7] = 3
        at += 10
    return rows, expect


def test_planted_runs(docs_of):
    rows, expect = planted(5, 40)
    got = {r["row"]["doc_id"]: r["n_removed"] for r in linededup.dedup(docs_of(rows)).collect()}
    assert {i: got[i] for i in expect} == expect and sum(got.values()) == sum(expect.values())


def test_lines_join_to_the_text(spark, docs_of):
    rows = [(i, t) for i, t in corpus(3) if t and "\x01" not in t]
    docs = docs_of(rows)
    got = docs.select("text", linededup.lines_of(docs.text).alias("x")).collect()
    assert all("".join(r["x"]) == r["text"] for r in got)


def test_words_of_a_key(docs_of):
    keys = ["", "a", "a b", "a  b", "a\tb c", "a \r b", "é 漢 x"]
    docs = docs_of(list(enumerate(keys)))
    assert [r["n"] for r in docs.select(linededup._words(docs.text).alias("n")).collect()] == [words(k) for k in keys]


def test_empty_table_and_columns(docs_of):
    out = linededup.dedup(docs_of([]))
    assert out.count() == 0 and out.columns == ["row", "n_lines", "n_removed", "n_runs", "kept"]


def test_clashing_columns(spark):
    names = ["of", "crc", "n_lines", "n_removed", "n_runs", "kept", "lines", "run", "found", "row", "n", "h", "a.b"]
    text = "one line of ten words is here for the test. " * 3
    df = spark.createDataFrame([(i, text, *range(len(names))) for i in range(3)], ["doc_id", "text", *names])
    got = linededup.dedup(df).select("row.*", "n_removed", "n_lines").collect()
    assert [tuple(r)[2 : 2 + len(names)] for r in got] == [tuple(range(len(names)))] * 3
    assert sorted(r[-2] for r in got) == [2, 3, 3]


def test_frequent_fingerprints(docs_of):
    rows = [(i, f"first line {i}. the second line is common here. " * 2 + "and a third one follows with many words so that the run is long enough to go. end.") for i in range(1300)]
    want = brute(rows)
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["kept"]) for r in linededup.dedup(docs_of(rows)).collect()}
    assert got == {i: want[i, zlib.crc32(t.encode())] if want[i, zlib.crc32(t.encode())][2] else (*want[i, zlib.crc32(t.encode())][:3], t) for i, t in rows}


def test_very_long_text(docs_of):
    r = random.Random(1)
    long = "".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(6)) + ". " for _ in range(20_000))
    part = " ".join(long.split(" ")[60_000:60_030])
    got = {x["row"]["doc_id"]: x["n_removed"] for x in linededup.dedup(docs_of([(1, long), (2, "x. " + part + " y."), (3, long)])).collect()}
    assert got == {1: 0, 2: 5, 3: 20_000}


def test_keys_of_a_text(docs_of):
    r = random.Random(4)
    texts = ["", " ", "\n", " \n a", "a. ", "a.  \n b ", "a \r\n\r\n\tb", "a.\t\n", ". . .", "\x01a.\x01", "a" + " " * 70_000 + "b"]
    texts += ["".join(r.choice(["a", "é", ".", "!", "?", " ", " ", "\n", "\t", "\r", "\x01"]) for _ in range(r.randrange(30))) for _ in range(3000)]
    docs = docs_of(list(enumerate(texts)))
    for x in docs.select("text", linededup.keys_of(docs.text).alias("keys")).collect():
        assert x["keys"].split("\x01") == [k.strip(" \t\r\n") for k in split(x["text"])], x["text"][:40]


def test_short_common_lines_are_not_compared_again(docs_of, monkeypatch):
    """Texts that share lines but no run of enough words go through one shuffle and no more."""
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + ". "
    rows = [(i, "".join(line(9) + f"common line {r.randrange(5)}. " for _ in range(10))) for i in range(300)] + [(300, "x. " * 30), (301, "x. " * 30)]
    counts, real = {}, linededup.written

    def counted(df, name):
        counts[name] = (table := real(df, name)).count()
        return table

    monkeypatch.setattr(linededup, "written", counted)
    got = {x["row"]["doc_id"]: x["n_removed"] for x in linededup.dedup(docs_of(rows)).collect()}
    assert got == {i: 0 for i in range(300)} | {300: 29, 301: 30}
    assert max(counts.values()) < 400


@pytest.mark.parametrize("min_words", [1, 2, 7, 63])
def test_other_sizes_of_runs(docs_of, min_words):
    rows = corpus(11)
    want = brute(rows, min_words)
    for x in linededup.dedup(docs_of(rows), min_words=min_words).collect():
        i, text = x["row"]["doc_id"], x["row"]["text"]
        n, m, k, kept = want[NO_ID if i is None else i, zlib.crc32((text or "").encode())]
        assert (x["n_lines"], x["n_removed"], x["n_runs"], x["kept"]) == (n, m, k, kept if k else text), i


def test_frequent_runs_with_every_kind_of_end(docs_of, monkeypatch):
    """Runs that are dealt in parts: copies that go on differently, within a text and after it."""
    monkeypatch.setattr(linededup, "SHARE", 10**6)
    r = random.Random(9)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + ". "
    passage = [line(3) for _ in range(4)] + [line(24), line(2), line(2), line(15), line(30)]
    rows = [(i, line(4) * r.randrange(3) + "".join(passage[: r.randrange(1, 10)]) + line(5) * r.randrange(2)) for i in range(2500)]
    rows += rows[:5]
    written, hot = linededup.written, []

    def kept(df, name):
        table = written(df, name)
        if name == "frequent":
            hot.append(table.count())
        return table

    monkeypatch.setattr(linededup, "written", kept)
    want = brute(rows)
    for x in linededup.dedup(docs_of(rows)).collect():
        i, text = x["row"]["doc_id"], x["row"]["text"]
        n, m, k, left = want[i, zlib.crc32(text.encode())]
        assert (x["n_lines"], x["n_removed"], x["n_runs"], x["kept"]) == (n, m, k, left if k else text), i
    assert hot[0] > 0
