import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def rows():
    r = random.Random(3)
    out = [(0, None), (1, ""), (2, " "), (3, "a\n\n b  c"), (4, "<|endoftext|> é漢😀"), (4, "a<|endoftext|><|endoftext|>b <|endoftext| >"), (5, "word " * 5000), (6, "xyz" * 3000)]
    return out + [(i, " ".join(r.choice(["the", "Ouwhea", "12", "é!"]) for _ in range(r.choice([3, 50, 200, 400, 700])))) for i in range(7, 150)]


def test_round_trip(docs_of, tok):
    data = rows()
    got = packing.pack(docs_of(data), PATH, capacity=256, with_ids=True).collect()
    by = {}
    for r in got:
        assert 1 <= r["length"] <= 256 and len(r["ids"]) == r["length"]
        assert r["crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["id"], []).append(r)
    texts = {}
    for i, text in data:
        texts.setdefault(i, []).append(tok.encode(text or "", add_special_tokens=False).ids + [2])
    assert [50256] == tok.encode("<|endoftext|>", add_special_tokens=False).ids
    for i, ids_of in texts.items():
        if len(ids_of) > 1:
            # Rows with one id are packed each for itself.
            assert sorted(r["ids"] for r in by[i]) == sorted(ids_of)
            continue
        ids = ids_of[0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert all(r["length"] == 256 for r in own[1:])
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= 1.1 * -(-sum(r["length"] for r in got) // 256)


def test_sequences(docs_of):
    packed = packing.pack(docs_of(rows()), PATH, capacity=512, with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == r["n_tokens"] <= 512


def test_empty(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_search_empties_bins():
    # Best fit pairs 6 with 4 and leaves the 3s; the least number of bins is the total over the capacity.
    bins = Counter({(5, 2): 2, (4, 3): 2, (3, 3): 2, (2, 2): 1})
    better = packing.local_search(bins, 10)
    items = lambda b: Counter(x for p, n in b.items() for x in p * n)
    assert items(better) == items(bins)
    assert sum(better.values()) < sum(bins.values()) and all(sum(p) <= 10 for p in better)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_keeps_all(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 100) for _ in range(r.choice([1, 10, 400, 5000])))
    bins = packing.local_search(packing.best_fit(counts, 100), 100)
    assert Counter(x for p, n in bins.items() for x in p * n) == counts
    assert all(0 < sum(p) <= 100 for p in bins)
    assert sum(bins.values()) <= -(-sum(k * n for k, n in counts.items()) // 100) * 1.25 + 1
