"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles, in powers of two,
and each partition has an index of its own. Its items are represented by as
many of their smallest shingle hashes as the containment threshold lets a
document miss, and one more: a document that contains an item must hold one of
them, so the search loses nothing. A document is looked up only in partitions
whose items it has enough shingles for, and a partition's hits are verified
against that partition's items only, on the shingles themselves. Documents
stream past the indexes of a block of items of bounded size; more items mean
more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import filtered, trim

#: Words of a shingle and the share of an item's distinct shingles that makes a document contaminated.
SHINGLE = 5
THRESHOLD = 0.8
#: Characters of item texts in one block, about: what one pass keeps in memory.
BLOCK = 1 << 24
#: Bytes of documents that are searched at a time.
CHUNK = 1 << 21
SLOT = 20
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Byte to what it counts as: lower-case letters, digits and all bytes from 128 on make words, others are gaps (zero).
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


class Shingler:
    """Word shingles of a buffer of several texts."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def words(self, buf: np.ndarray, ends: np.ndarray) -> None:
        """Take in texts that end at ``ends`` (each followed by a gap byte, or the end)."""
        folded = _FOLD[buf]
        on = folded != 0
        keep = on.copy()
        keep[1:] |= on[:-1]
        place = np.cumsum(keep)
        self.text = folded[keep]
        n = len(self.text)
        inner = self.text != 0
        edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        self.start, self.stop = edge[::2], edge[1::2]
        self.owner = np.searchsorted(place[ends - 1], self.start, "right") if len(ends) else self.start
        self.text[~inner] = 32
        if len(self.powers) <= n:
            one = np.ones(1, np.uint64)
            self.powers = np.concatenate((one, np.cumprod(np.full(n, _MULT, np.uint64))))
            self.inverse = np.concatenate((one, np.cumprod(np.full(n, _INV, np.uint64))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(self.text.astype(np.uint64) * self.powers[:n])))

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each shingle of ``size`` words."""
        first = np.arange(max(0, len(self.start) - size + 1))
        first = first[self.owner[first] == self.owner[first + size - 1]]
        a, b = self.start[first], self.stop[first + size - 1]
        h = (self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MIX
        return first, h ^ (h >> np.uint64(29))

    def string(self, first: int, size: int) -> bytes:
        return self.text[self.start[first] : self.stop[first + size - 1]].tobytes()


class Partition:
    """Items of one shingle length and one size class: their sketch, and all their shingles for the verification."""

    def __init__(self) -> None:
        self.smallest: set[int] = set()
        self.rows: list[tuple[int, int]] = []
        #: Shingles that a document must have, repeats included, to contain any of the items.
        self.least: int = 1 << 62

    def add(self, item: int, hashes: list[int], need: int) -> None:
        self.smallest.update(sorted(hashes)[: len(hashes) - need + 1])
        self.rows.extend((h, item) for h in hashes)
        self.least = min(self.least, need)

    def seal(self) -> None:
        self.sketch = np.array(sorted(self.smallest), np.uint64)
        self.rows.sort()
        self.hashes, self.items = np.array([h for h, _ in self.rows], np.uint64), np.array([k for _, k in self.rows], np.int64)
        del self.smallest, self.rows


class Index:
    """A block of items, by partition."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int, threshold: float) -> None:
        self.ids, self.strings, self.need, self.partition = [], [], [], []
        #: Length of the shingles in words, then the bits of the number of distinct ones, to the partition.
        self.parts: dict[int, dict[int, Partition]] = {}
        s = Shingler()
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            s.words(raw, np.array([len(raw)] if len(raw) else [], np.int64))
            size = min(shingle, len(s.start))
            if not size:
                continue
            first, h = s.hashes(size)
            strings = {s.string(int(i), size): int(x) for i, x in zip(first, h, strict=True)}
            n = len(strings)
            need = math.ceil(threshold * n - 1e-9) or 1
            self.parts.setdefault(size, {}).setdefault(n.bit_length(), Partition()).add(len(self.ids), list(strings.values()), need)
            self.ids.append(item_id)
            self.strings.append(frozenset(strings))
            self.need.append(need)
            self.partition.append(n.bit_length())
        for sizes in self.parts.values():
            for p in sizes.values():
                p.seal()

    def ready(self) -> None:
        """Per length of shingles a table of slots, whose bits are the partitions with a sketch value there."""
        if not hasattr(self, "_seen"):
            self._seen = {}
            for m, sizes in self.parts.items():
                table = np.zeros(1 << SLOT, np.uint32)
                for bits, p in sizes.items():
                    np.bitwise_or.at(table, (p.sketch >> np.uint64(64 - SLOT)).view(np.int64), np.uint32(1 << min(bits, 31)))
                self._seen[m] = table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_seen"}

    def search(self, pieces: list[tuple[int, bytes, bool]], shingler: Shingler) -> Iterator[tuple[int, int, set[bytes]]]:
        """(document, item, shared shingles) for candidates among (document, bytes, whole); a part of a document is always one."""
        self.ready()
        ends = np.cumsum([len(p[1]) + 1 for p in pieces])
        shingler.words(np.frombuffer(b"\n".join([*(p[1] for p in pieces), b""]), np.uint8), ends)
        docs, whole = np.array([p[0] for p in pieces]), np.array([p[2] for p in pieces], bool)
        for size, sizes in self.parts.items():
            first, h = shingler.hashes(size)
            owner = shingler.owner[first]
            held = np.bincount(owner, minlength=len(pieces))
            marks = self._seen[size][(h >> np.uint64(64 - SLOT)).view(np.int64)]
            likely = np.flatnonzero(marks)
            for bits, part in sizes.items():
                # A document with fewer shingles than the partition's items ask for contains none of them.
                able = ~whole | (held >= part.least)
                mine = likely[(marks[likely] >> np.uint32(min(bits, 31)) & 1).astype(bool)]
                mine = mine[able[owner[mine]]]
                at = np.searchsorted(part.sketch, h[mine])
                hit = mine[(at < len(part.sketch)) & (part.sketch[np.minimum(at, len(part.sketch) - 1)] == h[mine])]
                chosen = ~whole
                chosen[owner[hit]] = True
                if not chosen.any():
                    continue
                # All shingles of the pieces that hold a sketch's value, against the partition's shingles.
                own = np.flatnonzero(chosen[owner])
                lo, hi = np.searchsorted(part.hashes, h[own]), np.searchsorted(part.hashes, h[own], "right")
                own, lo, n = own[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                item = part.items[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                place = np.repeat(own, n)
                shared: dict[tuple[int, int], set[bytes]] = {}
                for d, k, f in zip(docs[owner[place]].tolist(), item.tolist(), first[place].tolist(), strict=True):
                    shared.setdefault((d, k), set()).add(shingler.string(f, size))
                for (d, k), strings in shared.items():
                    yield d, k, strings & self.strings[k]


def _pieces(raw: bytes, lap: int) -> Iterator[bytes]:
    """A text in parts that end between words; each begins with the ``lap`` words before it."""
    at, width = 0, CHUNK
    while True:
        end = at + width
        if end >= len(raw):
            yield raw[at:]
            return
        on = _FOLD[np.frombuffer(raw, np.uint8, end - at, at)] != 0
        starts = np.flatnonzero(on & ~np.concatenate(([False], on[:-1])))
        if len(starts) <= lap + 1:
            width *= 2
            continue
        # The last word may go on; the part ends before it.
        yield raw[at : at + int(starts[-1])]
        at, width = at + int(starts[-1 - lap]), CHUNK


def _matches(index: Index, texts: list[tuple[int, str | None]], shingler: Shingler) -> dict[int, list[tuple[int, int]]]:
    """Row to (item, shared shingles) that reach the threshold."""
    lap = max(index.parts, default=1) - 1
    shared: dict[tuple[int, int], set[bytes]] = {}
    held: list[tuple[int, bytes, bool]] = []
    size = 0

    def flush() -> None:
        for d, k, strings in index.search(held, shingler) if held else ():
            shared.setdefault((d, k), set()).update(strings)
        held.clear()

    for i, text in texts:
        raw = (text or "").encode()
        for part in _pieces(raw, lap):
            held.append((i, part, len(part) == len(raw)))
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    out: dict[int, list[tuple[int, int]]] = {}
    for (d, k), strings in shared.items():
        if len(strings) >= index.need[k]:
            out.setdefault(d, []).append((k, len(strings)))
    return out


def _indexes(items: DataFrame, item_col: str, text_col: str, shingle: int, threshold: float, block: int) -> list[Index]:
    """Indexes of blocks of items, each of about ``block`` characters. A block is read by the driver and broadcast."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [Index([(r["item"], r["text"]) for r in rows.where(part == k).orderBy("item", "text").collect()], shingle, threshold) for k in range(n)]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(id, item, partition, n_shingles, n_shared, containment): documents that hold at least ``threshold`` of an item's distinct shingles.

    Words are runs of letters, digits and bytes from 128 on, A-Z lower-cased. An item of fewer words than a shingle is
    one shingle of all its words; items without a word (null, empty) match nothing, nor do such documents. A row per
    pair of rows: repeated items or documents repeat, and a null id is given as it is. Texts of any length are searched
    whole, in parts that overlap. Only the columns named are read, so others may have any name; an empty table of either
    kind gives an empty result. partition: bits of the item's number of shingles, which names its partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def passed(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, shingler = shared.value, Shingler()
            for batch in batches:
                found = _matches(index, [(i, t.as_py()) for i, t in enumerate(batch.column(1))], shingler)
                got = [(i, index.ids[k], index.partition[k], len(index.strings[k]), n) for i, own in sorted(found.items()) for k, n in sorted(own)]
                if got:
                    i, item, part, total, n = zip(*got, strict=True)
                    arrays = [batch.column(0).take(pa.array(i)), pa.array(item, pa.int64()), pa.array(part, pa.int32()), pa.array(total, pa.int64()), pa.array(n, pa.int64()), pa.array([a / b for a, b in zip(n, total, strict=True)])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "item", "partition", "n_shingles", "n_shared", "containment"])
            trim()

        return rows.mapInArrow(run, "id long, item long, partition int, n_shingles long, n_shared long, containment double")

    return reduce(DataFrame.unionByName, [passed(x) for x in _indexes(items, item_col, item_text, shingle, threshold, block)])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates. No shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def passed(rest: DataFrame, index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            for batch in batches:
                found = _matches(shared.value, [(i, t.as_py()) for i, t in enumerate(batch.column(at))], shingler)
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))
            trim()

        return filtered(rest, run)

    return reduce(passed, _indexes(items, item_col, item_text, shingle, threshold, block), docs)
