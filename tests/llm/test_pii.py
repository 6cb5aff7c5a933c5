import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(text):
    out = []
    for order, (kind, rule) in enumerate(PLAIN.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((order, kind, m.start(), m.end()))
    return out


def corpus(seed):
    r = random.Random(seed)
    bits = ["a@b.co", "x.y+z@mail7.example.com", "a@b.c@d.e.f", "@", "a@", "é@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4785380592391139", "5 -12", "+1 (968) 555-9369", "+123", "+12 34..", "++1 (429) 555-4428", "1" * 19, "0" * 16, "12", " ", "\n", "漢字", "a@b.co_x@d.e", "password=0030ef94f364d8386a", "-5-5-5-", "\x01", "9 8 7 6 5 4 3 2 1 0 9 8 7"]
    rows = [(0, None), (1, ""), (2, "no digit"), (3, "7" * 30_000), (4, "a" * 30_000 + "@b.c"), (5, "a@b.c " * 4000), (6, "+" * 5000 + "1 2")]
    return rows + [(10 + k, r.choice(["", " "]).join(r.choice(bits) for _ in range(r.randrange(1, 14)))) for k in range(300)] + [(20, "1.2.3.4"), (20, "1.2.3.4"), (None, "a@b.co")]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_matches_plain_rules(docs_of, seed):
    rows = corpus(seed)
    got = pii.find(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(base_of((t or "").replace("\x01", "\x03")))
    for r in got:
        base = [tuple(s) for s in r["base"]]
        assert base in want[r["id"]], r["id"]
        assert {tuple(s) for s in r["spans"]} >= set(base)


def key(r, n=40, whole=True):
    """A random hexadecimal key in which each decimal digit and a letter occur, or one that is no seed."""
    while True:
        k = "".join(r.choice("0123456789abcdef") for _ in range(n))
        if (len(set(k) & set("0123456789")) == 10 and not k.isdigit()) == whole:
            return k


def test_bootstrap_finds_unseen(docs_of):
    r = random.Random(3)
    rows = [(k, f"word here, contact: user{k}@mail.example.com and then more {k} words") for k in range(12)]
    rows += [(50, "contact: user77-at-nowhere9 is an odd one"), (51, "nothing: user77x-at-nowhere9"), (52, "we counted item12345 and so on")]
    rows += [(60 + k, f'token = "{key(r)}" end') for k in range(8)] + [(90, 'token = "short99x" end'), (91, f'token = "{key(r, whole=False)}" end'), (92, f"other {key(r, whole=False)} end")]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs_of(rows)).collect()}
    assert got[50] == [(0, "email", 9, 27)]
    assert got[51] == [] and got[52] == [] and got[92] == []
    assert [s[1:] for s in got[90]] == [("secret", 9, 17)] and [s[1:] for s in got[91]] == [("secret", 9, 49)]
    assert all([s[1:] for s in got[60 + k]] == [("secret", 9, 49)] for k in range(8))


def test_common_words_are_no_patterns(docs_of):
    """Each time that a word stands without an instance counts against it, in whatever text."""
    rows = [(k, f"see user{k}x@mail.example.com here") for k in range(6)] + [(20, "see number77x there"), (21, "see and see and see and see again")]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs_of(rows[:-1])).collect()}
    assert got[20] == [(0, "email", 4, 13)]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs_of(rows)).collect()}
    assert got[20] == []


def brute_patterns(rows, bare, rounds=3, confident=0.7, support=3):
    """The bootstrap by loops over distinct (cue, closer, value)."""
    edges = {}
    for cue, closer, value, text, seed in rows:
        now = edges.setdefault((cue, closer, value), [None, set()])
        now[0] = max(filter(None, (now[0], seed)), default=None)
        now[1].add(text)

    def shape(v):
        return tuple(bool(re.search(f"[{c}]", v)) for c in ("0-9", "a-f", "g-z", "A-Z", "^0-9A-Za-z")), len(v)

    seeds = {(v, s): 1.0 for (_, _, v), (s, _) in edges.items() if s}
    sure, found = dict(seeds), {}
    for k in range(rounds):
        found = {}
        for p in {e[:2] for e in edges}:
            own = [(v, x) for (c, q, v), x in edges.items() if (c, q) == p]
            for kind in {s for _, s in sure}:
                held = [v for v, _ in own if (v, kind) in sure]
                shapes = {shape(v) for v in held}
                mass = sum(sure[v, kind] for v in held)
                against = sum(shape(v) not in shapes for v, _ in own) + bare.get(p[0], 0)
                if len(held) >= support and len({min(x[1]) for v, x in own if v in held}) >= support and mass / (mass + against + 1) >= confident:
                    found[p, kind] = mass / (mass + against + 1)
        if k + 1 < rounds:
            sure = dict(seeds)
            for kind in {q for _, q in found}:
                for v in {e[2] for e in edges}:
                    doubt = 1.0
                    for p in {e[:2] for e in edges if e[2] == v}:
                        doubt *= 1 - min(found.get((p, kind), 0), 0.999)
                    if doubt < 1 and (v, kind) not in sure:
                        sure[v, kind] = 1 - doubt
    return found


@pytest.mark.parametrize("seed", range(2))
def test_patterns_match_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        value = r.choice(["v", "w", "X", "a1", "zz-"]) + str(r.randrange(10, 60))
        rows.append((r.choice(["p ", "q: ", "s = ", "t ", "u=", "v#"]), r.choice(["", "", '"']), value, r.randrange(40), {"v": "ip", "X": "email"}.get(value[0]) if r.random() < 0.5 else None))
    rows = [x for x in rows if x[0] != "q: " or x[2][0] == "v"] + [("n: ", "", f"v{k}", k, "ip") for k in range(10, 16)] + [("n: ", "", f"v{k}", k, None) for k in range(70, 80)] + [("m: ", "", f"v{k}", k, None) for k in range(70, 76)] + [("o ", "", f"v{k}", 7, "ip") for k in range(10, 19)]
    bare = {"q: ": 1, "p ": 30, "m: ": 0}
    got = pii.patterns(spark.createDataFrame(rows, "cue string, closer string, value string, text long, seed string"), spark.createDataFrame(list(bare.items()), "cue string, n long"))
    want = brute_patterns(rows, bare)
    assert {((x["cue"], x["closer"]), x["kind"]): round(x["confidence"], 9) for x in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert (("m: ", ""), "ip") in want and (("o ", ""), "ip") not in want


def test_very_long_cues_and_instances(docs_of):
    r = random.Random(4)
    word = "w" * 60
    rows = [(k, f"{word}: {key(r)}") for k in range(6)] + [(10, f"{word}: " + "x" * 100 + "7y"), (11, ("a" * 200_000 + " ") + f"{word}: {key(r, whole=False)}"), (12, "b" * 300_000 + "1")]
    got = {x["id"]: [tuple(s)[1:] for s in x["spans"]] for x in pii.find(docs_of(rows)).collect()}
    assert got[10] == [("secret", 62, 164)] and got[11] == [("secret", 200_063, 200_103)] and got[12] == []


def test_digest_columns_and_empty(docs_of):
    got = pii.find(docs_of([(1, "x 1.2.3.4 y a@b.c")])).select(pii.joined(F.col("base")).alias("s"), pii.count_of(F.col("base"), "ip").alias("n")).first()
    assert tuple(got) == ("email:12:17,ip:2:9", 1)
    assert pii.find(docs_of([])).count() == 0
