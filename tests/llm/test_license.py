import itertools
import random
import re
from re import _constants as rc
from re import _parser as rp

import pytest

from millrace.llm import license as lic

GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lic.UPPER, lic.LOWER)


def brute(text, book):
    words = [w.translate(FOLD) for w in GAP.split(text or "") if w]
    base = [(i, label) for p, label in lic.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    padded = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(book):
        if not lic.gate_of(r) or any(set(g) <= set(words) for g in lic.gate_of(r)):
            for m in re.finditer(" " + r.pattern.strip() + "(?= )", padded, re.ASCII):
                a = padded[: m.start()].count(" ")
                found.append((a, a + m.group().count(" ") - 1, r.label, r.priority, k))
    kept = []
    for a, z, label, p, k in found:
        if not any(b <= a and y >= z and (q > p or q == p and (y - b > z - a or j < k)) for b, y, _, q, j in found if (b, y, j) != (a, z, k)):
            kept.append((a, z, label, p))
    labels = sorted({x for _, x in base})
    score = max([0.8 if base else 0.0, *(lic.CONFIDENCE[p] for *_, p in kept)])
    return (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(labels), ",".join(sorted({*labels, *(x[2] for x in kept)})), score, sorted(kept))


def got_of(df):
    return {r["id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], [tuple(m) for m in r["matches"]]) for r in df.collect()}


TEXTS = [
    None, "", " .. ", "word", "CC BY", "cc-by-nc 4.0", "Licensed under CC BY-NC 4.0\nand CC BY", "ccc by cc byx", "éCC BY", "CC\x00BY", "cc by",
    "This work is licensed under the GNU General Public License, version 3.", "GENERAL public LICENSE general public license", "All rights reserved. All Rights\nReserved",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU GPL v2 or any later version", "GNU Lesser General Public License version 2.1 only",
    "Copyright (c) 2019 2020 Someone. Redistribution and use in source and binary forms", "Creative Commons Attribution-ShareAlike 4.0 International License", "new BSD license and BSD-3-Clause",
    "İ K all rightS reserved K", "ſome rights reserved", "spdx-license-identifier: MIT licence", "all rights reserved " * 3000, "x " * 40000 + "mit license",
]


def test_matches_brute_force(docs_of):
    r = random.Random(4)
    pool = " ".join(t for t in TEXTS if t and len(t) < 200).split()
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choice(pool) for _ in range(r.randrange(60)))) for i in range(150)]
    got = got_of(lic.scan(docs_of(rows)))
    book = lic.rules()
    small = [(i, t) for i, t in rows if len(t or "") < 5000]
    for i, t in small:
        assert got[i] == brute(t, book), t
    assert got[24][:4] == (9000, 3000, 0, 8997) and got[24][4:6] == ("reserved", "reserved")
    assert got[25][0] == 40002 and got[25][5] == "mit"


def test_rules_compile_and_are_many():
    book = lic.rules()
    assert len(book) >= 400 and len(lic.NAMED) + len(lic.NOTICES) + len(lic.SINGLE) + len(lic.FAMILIES) >= 250
    assert len({(r.label, r.pattern) for r in book}) == len(book)
    for r in book:
        re.compile(r.pattern)


def test_empty_and_repeated(docs_of):
    assert lic.scan(docs_of([])).count() == 0
    got = lic.scan(docs_of([(3, "cc by"), (3, "cc by"), (None, "mit license")])).collect()
    assert sorted((str(r["id"]), r["labels"]) for r in got) == [("3", "cc-by"), ("3", "cc-by"), ("None", "mit")]


@pytest.mark.parametrize("book", [[], [lic.Rule("foo", "a", 1, "foo bar"), lic.Rule("foo", "b", 2, "foo"), lic.Rule("bar", "c", 1, "bar"), lic.Rule("foo", "d", 1, "foo")]])
def test_own_rules(docs_of, book):
    rows = [(0, "foo bar"), (1, "bar foo foo bar"), (2, "x")]
    got = got_of(lic.scan(docs_of(rows), book=book))
    for i, t in rows:
        assert got[i] == brute(t, book)


def expansions(tree):
    """What a parsed pattern matches: each alternative, an optional part absent and present, a repeated one at its least and once more."""
    parts = []
    for op, arg in tree:
        if op is rc.LITERAL:
            parts.append([chr(arg)])
        elif op is rc.IN:
            parts.append([chr(a) if o is rc.LITERAL else {rc.CATEGORY_DIGIT: "2", rc.CATEGORY_WORD: "w"}[a] for o, a in arg])
        elif op is rc.SUBPATTERN:
            parts.append(expansions(arg[-1]))
        elif op is rc.BRANCH:
            parts.append([x for branch in arg[1] for x in expansions(branch)])
        else:
            assert op is rc.MAX_REPEAT, op
            inner = expansions(arg[2])
            parts.append([x * n for n in sorted({arg[0], min(arg[0] + 1, arg[1])}) for x in inner])
    return sorted({"".join(x) for x in itertools.product(*parts)})


def test_keywords_stand_in_every_match():
    for r in lic.rules():
        for x in expansions(rp.parse(r.pattern)):
            assert any(set(g) <= {w for w in GAP.split(x) if w} for g in lic.gate_of(r)), (r, x)


def test_keywords_drop_no_match(docs_of):
    """Against a brute force without the gate."""
    book, r = lic.rules(), random.Random(5)
    texts = ["Universal Permissive License 1.0", "the Q Public License", "ASL 2.0", "licenced under X", "reproduced without prior permission", "UPL"]
    texts += [x for rule in book for e in [expansions(rp.parse(rule.pattern))] for x in r.sample(e, min(3, len(e)))]
    got = got_of(lic.scan(docs_of(list(enumerate(texts)))))
    open_book = [x._replace(keyword="") for x in book]
    for i, t in enumerate(texts):
        assert got[i] == brute(t, open_book), t
    assert [got[i][5] for i in range(5)] == ["upl-1.0", "qpl", "apache-2.0", "licensed", "proprietary"]


def test_each_rule_matches_its_own_examples(docs_of):
    """A book of one rule finds what the rule's pattern spells, written as words with single spaces."""
    for rule in lic.rules():
        for x in expansions(rp.parse(rule.pattern)):
            words = " " + " ".join(w for w in GAP.split(x) if w) + " "
            if words.strip() == x.strip():
                assert re.search(" " + rule.pattern.strip() + "(?= )", words, re.ASCII), (rule, x)
    book = lic.rules()
    texts = [(k, next(x for x in expansions(rp.parse(r.pattern)) if "(" not in x)) for k, r in enumerate(book)]
    got = got_of(lic.scan(docs_of(texts)))
    assert all(got[k][7] for k, _ in texts)
    notices = [(0, "Copyright (c) 2019 Someone"), (1, "Copyright 2019-2021, 2024 X"), (2, "copyright (C) 2020"), (3, "copyright 12345")]
    got = got_of(lic.scan(docs_of(notices)))
    assert [got[i][5:] for i in range(4)] == [("copyright", 0.5, [(0, 2, "copyright", 1)]), ("copyright", 0.5, [(0, 3, "copyright", 1)]), ("copyright", 0.5, [(0, 2, "copyright", 1)]), ("", 0.0, [])]
