import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import suffixdedup


def brute(rows, length):
    """Mark each byte covered by a string that starts earlier in (id, version, start) order."""
    docs = sorted({(-(2**63) if i is None else i, zlib.crc32((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, v, raw in docs:
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = True
            else:
                seen.add(raw[a : a + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i, v] = (len(raw), len(raw) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "é", "beta", "漢字", "gamma", "x", "delta "]
    prose = lambda k: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(k))
    shared = [prose(40) for _ in range(4)]
    line = "a very common line that is shorter than the limit, over and over "
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 400), (4, "z" * 99), (5, "z" * 100), (6, "z" * 101), (None, prose(30) + shared[0])]
    for i in range(7, n):
        kind = r.random()
        if kind < 0.2 and len(rows) > 10:
            t = r.choice(rows[8:])[1]
            if r.random() < 0.6 and t:
                k = r.randrange(len(t))
                t = t[:k] + "#" + t[k + 1 :]
        else:
            t = prose(r.randrange(5, 80)) + (" " + r.choice(shared) if kind < 0.5 else "") + line * r.randrange(3) + prose(r.randrange(5, 60))
        rows.append((i, t))
    r.shuffle(rows)
    return rows


def check(got, rows, length):
    want = brute(rows, length)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        mine = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        assert mine in [want[-(2**63) if r["id"] is None else r["id"], zlib.crc32((t or "").encode())] for t in text[r["id"]]], r["id"]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, seed, monkeypatch):
    monkeypatch.setattr(suffixdedup, "FREQUENT", 0.05)
    rows = corpus(seed) + [(20, "another text with an id that is taken " * 6), (20, "another text with an id that is taken " * 6)]
    check(suffixdedup.dedup(docs_of(rows)).collect(), rows, 100)


@pytest.mark.parametrize("seed", range(8))
def test_buckets_match_brute_force(seed, monkeypatch):
    """The stages without Spark, on small pieces, so that documents are cut and every bucket has several blobs."""
    r = random.Random(seed)
    rows = [(i, t) for i, t in corpus(seed, 90) if t and i is not None]
    anchors = suffixdedup.Anchors(40, 16, np.array([r.randrange(1 << 24) for _ in range(1 << 20)]))
    blobs = {}
    for at in range(0, len(rows), 7):
        pieces = []
        for i, t in rows[at : at + 7]:
            raw = t.encode()
            pieces += [(i, zlib.crc32(raw), a, raw[a : a + 300 + 39]) for a in range(0, max(1, len(raw) - 39), 300)]
        into = suffixdedup.Blobs()
        suffixdedup.cut(pieces, anchors, 5, into)
        for b, blob in into.take():
            blobs.setdefault(b, []).append(blob)
    gone = {i: np.zeros(len(t.encode()), bool) for i, t in rows}
    for b in blobs.values():
        for i, _, s, e in suffixdedup.repeats(b, 40, 16).tolist():
            gone[i][s:e] = True
    want = brute(rows, 40)
    for i, t in rows:
        raw = t.encode()
        assert hashlib.sha256(bytes(x for x, g in zip(raw, gone[i], strict=True) if not g)).hexdigest() == want[i, zlib.crc32(raw)][3]


def test_empty_table(docs_of):
    assert suffixdedup.dedup(docs_of([])).count() == 0


def test_kept_and_spans(docs_of):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh") for _ in range(300))
    got = {r["id"]: r for r in suffixdedup.dedup(docs_of([(1, t), (2, "head " + t[50:200] + " tail")]), with_kept=True).collect()}
    assert bytes(got[1]["kept"]).decode() == t and got[1]["spans"] == []
    assert bytes(got[2]["kept"]).decode() == "head  tail" and got[2]["spans"] == [[5, 155]]


def test_very_long_text_and_clashing_columns(spark):
    import random

    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    names = ["id", "version", "start", "stop", "of", "crc", "key", "found", "bucket", "blob"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in [(1, long), (2, "x" + long[2_500_000:2_500_150] + "y"), (3, long), (None, None)]], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in suffixdedup.dedup(df).collect()}
    assert got == {1: (3_000_000, 0, 0), 2: (152, 150, 1), 3: (3_000_000, 3_000_000, 1), None: (0, 0, 0)}
