"""Packing of tokenised documents into sequences of a fixed length.

Which document goes where depends on lengths alone, and there are at most
``capacity`` of those. So the plan is made of bin patterns with multiplicities,
from a histogram with one row per length, whatever the number of documents:
best fit in decreasing length, then a swap-based local search among the
underfull bins. Documents take their places by rank within their length. A
length adds at most four patterns to the plan and an exchange two, so the plan
that is broadcast has a size that the capacity bounds, not the documents.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import shuffled, trim, written

Pattern = tuple[int, ...]

#: Pre-token pattern of byte-level BPE vocabularies of this family, and texts on which ``encoder`` verifies the outcome.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ("", " ", "<|endoftext", "It's we'll  go\n\n\tnow. 12345 x2", "éàü ñandú Ünïcödé — “q” 漢字 😀 é́", "a" * 600, "<|endoftext|> a b \r\n ...!!??", "İıſK 1٣4 _x_ {}[] \x00\x7f")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


@functools.lru_cache(maxsize=2)
def encoder(spec: str):
    """Text to ids (numpy uint32) by a tokenizer's JSON text, with ``add_special_tokens=False`` and all else at its defaults.

    A string of an added token in a text thus gets that token's id. Texts without such a string go to a faster encoder
    of the same vocabulary where it agrees on the probes; all others go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_str(spec)

    def plain(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

    layout = json.loads(spec)
    model = layout.get("model", {})
    if model.get("type") == "BPE" and not layout.get("normalizer") and (layout.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
        import tiktoken

        of = _byte_of()
        added = [t["content"] for t in layout.get("added_tokens", [])]
        ranks = {bytes(of[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
        fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def quick(text: str) -> np.ndarray:
            return plain(text) if any(t in text for t in added) else fast.encode_to_numpy(text, disallowed_special=())

        if all(np.array_equal(quick(x), plain(x)) for x in PROBES):
            return quick
    return plain


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit in decreasing length, for all documents of a length at once."""
    free: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in free:
                free[room] = Counter()
                insort(rooms, room)
            free[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            each = room // length
            for pattern, n in sorted(free[room].items()):
                full = min(n, left // each)
                some = left - full * each if full < n else 0
                for bins, k in ((full, each), (int(some > 0), some)):
                    if bins:
                        free[room][pattern] -= bins
                        put(room - k * length, pattern + (length,) * k, bins)
                        left -= bins * k
                if not left:
                    break
            free[room] = +free[room]
            if not free[room]:
                del free[room]
                rooms.remove(room)
            at = bisect_left(rooms, room + 1)
        each = capacity // length
        put(capacity - each * length, (length,) * each, left // each)
        put(capacity - left % each * length, (length,) * (left % each), int(left % each > 0))
    return sum(free.values(), Counter())


def _exchanges(a: Pattern, b: Pattern, capacity: int) -> Iterator[tuple[Pattern, Pattern]]:
    """(out of a, out of b): moves, one-for-one and two-for-one swaps that fill b and raise the sum of squared fills."""
    fa, fb = sum(a), sum(b)
    ones_a, ones_b = [(x,) for x in sorted(set(a), reverse=True)], [(x,) for x in sorted(set(b), reverse=True)]
    twos = lambda p: [(x, y) for i, x in enumerate(p) for y in p[i + 1 :]]
    for give, take in ((ones_a, [()]), (ones_a, ones_b), (sorted(set(twos(a)), reverse=True), ones_b), (ones_a, sorted(set(twos(b)), reverse=True))):
        for x in give:
            for y in take:
                gain = sum(x) - sum(y)
                if gain > 0 and fb + gain <= capacity and fb + gain > fa:
                    yield x, y


def _swapped(p: Pattern, out: Pattern, into: Pattern) -> Pattern:
    rest = Counter(p)
    rest.subtract(out)
    rest.update(into)
    return tuple(sorted(rest.elements(), reverse=True))


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchange documents between underfull bins while the sum of squared fills grows; bins that empty are dropped.

    Takes the emptiest kind of bin in turn against all underfull ones, the fullest first. Stops when the number of bins
    reaches the bound that the total length sets, or when no exchange is left: each one raises the sum of squares, so
    there is an end. Whether two kinds can exchange depends on them alone, so pairs that cannot are looked at once.
    """
    bins = Counter(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    barren: set[tuple[Pattern, Pattern]] = set()
    while sum(bins.values()) > least:
        open_bins = sorted((p for p in bins if sum(p) < capacity), key=lambda p: (sum(p), p))
        best = None
        for a in open_bins:
            for b in reversed(open_bins):
                n = min(bins[a], bins[b]) if a != b else bins[a] // 2
                if not n or (a, b) in barren:
                    continue
                if found := max(_exchanges(a, b, capacity), key=lambda e: sum(e[0]) - sum(e[1]), default=None):
                    best = (a, b, *found, n)
                    break
                barren.add((a, b))
            if best:
                break
        if not best:
            break
        a, b, x, y, n = best
        bins[a] -= n
        bins[b] -= n
        for p in (_swapped(a, x, y), _swapped(b, y, x)):
            if p:
                bins[p] += n
        bins = +bins
    return bins


def places(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (last rank + 1, first rank, documents of the length in a bin, first sequence, offset)."""
    rows: dict[int, list] = {}
    ranks: Counter[int] = Counter()
    first = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        at = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.setdefault(length, []).append((ranks[length] + n * each, ranks[length], each, first, at))
            ranks[length] += n * each
            at += length * each
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row per piece: (id, piece, start, length, crc32, part, nth [, ids]); nth counts the pieces of a length within a task's part."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = "id long, piece int, start long, length int, crc32 long, part long, nth long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(spec.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cut = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    rows.append((i, piece, a, b - a, zlib.crc32(tokens[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            if not rows:
                continue
            i, piece, start, length, crc, p, nth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            columns = [batch.column(0).take(pa.array(i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(p), pa.array(nth)]
            names = ["id", "piece", "start", "length", "crc32", "part", "nth"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc32, sequence, offset [, ids]), a row per piece.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Longer ones are cut into
    pieces of ``capacity``, of which the first may be shorter; texts of any length are encoded whole. Rows with equal
    ids, or a null id, are packed each for itself, and so are repeated rows. Only the two columns named are read, so
    others may have any name. An empty table gives an empty result. ``tokenizer``: path of a tokenizer's JSON file,
    read by the driver.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    dealt = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(local_search(best_fit(counts, capacity), capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per task and length: that grows with the documents, so the join is a shuffle.
    ranked = pieces.join(shuffled(dealt.select("part", "length", before.alias("before"))), ["part", "length"])
    kept = ["id", "piece", "start", "length", "crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, at = where.value[int(n)], np.flatnonzero(length == n)
                own = rows[np.searchsorted(rows[:, 0], rank[at], "right")]
                past = rank[at] - own[:, 1]
                sequence[at] = own[:, 3] + past // own[:, 2]
                offset[at] = own[:, 4] + past % own[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence", "offset"])

    shape = "id long, piece int, start long, length int, crc32 long" + ", ids array<int>" * with_ids + ", sequence long, offset long"
    return ranked.select(*kept, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, shape)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence, n_tokens, ids) of what ``pack(with_ids=True)`` returned; at most ``capacity`` ids a row."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
