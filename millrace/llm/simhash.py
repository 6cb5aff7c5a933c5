"""SimHash near-duplicates by vantage-point trees over fingerprints.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles. Distinct fingerprints are spread over the leaves of a vantage-point
tree whose vantage points come from a sample; a fingerprint is stored
in one leaf and also asked in each later leaf that the triangle inequality
cannot exclude. Inside a leaf a local tree of the same kind prunes further.
All pairs within the radius are found: the sample only affects the cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import discard, shuffle_width, shuffled, trim, written

#: Fingerprints for each leaf from which vantage points are chosen, 8 bytes each: what the driver holds is a
#: five-hundredth of what the leaves hold, and a leaf's size stays the same, however many there are.
SAMPLE = 8
#: Fingerprints that a leaf is meant to store.
LEAF = 4096
#: Size at which a local tree stops splitting.
SMALL = 256
SPAN = 4096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; zero where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    joined = b" ".join(words)
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SPAN):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + SPAN], stops[at : at + SPAN], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, mark): fp holds the fingerprint's 64 bits as a signed long; mark is a hash of the text, which tells rows with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["id", "fp", "mark"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _mark(text_col)).mapInArrow(run, "id long, fp long, mark long")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Heap-ordered inner nodes: vantage points and median distances, -1 for none. Takes of a few points the one with the widest distances."""
    at_node, mids = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, -1, np.int64)

    def build(at: int, own: np.ndarray) -> None:
        if at >= len(mids) or len(own) < 2:
            return
        some = own[:: max(1, len(own) // 4096)]
        best = max(some[:: max(1, len(some) // 24)][:24], key=lambda p: float(_apart(some, p).std()))
        d = _apart(own, best)
        at_node[at], mids[at] = best, int(np.median(d))
        build(2 * at + 1, own[d <= mids[at]])
        build(2 * at + 2, own[d > mids[at]])

    build(0, points)
    return at_node, mids


def leaves(points: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(positions, leaf, stored): each point's own leaf, and each later leaf that can hold a point within the radius."""

    def walk(at: int, which: np.ndarray, home: np.ndarray) -> Iterator:
        if not len(which):
            return
        if at >= len(nodes[1]) or nodes[1][at] < 0:
            yield which, at, home
            return
        vp, mid = nodes[0][at], int(nodes[1][at])
        d = _apart(points[which], vp).astype(np.int64)
        inner = d <= mid
        # A stored point goes to its own side, and as a question to the outer side, which comes later; the reverse
        # would find the same pairs again. A question goes wherever the bound allows.
        first = inner | (~home & (d - radius <= mid))
        later = ~inner | (d + radius > mid)
        yield from walk(2 * at + 1, which[first], (home & inner)[first])
        yield from walk(2 * at + 2, which[later], (home & ~inner)[later])

    yield from walk(0, np.arange(len(points)), np.ones(len(points), bool))


def near_pairs(stored: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in stored, in asked) of all pairs within the radius."""

    def walk(s: np.ndarray, q: np.ndarray) -> Iterator:
        if not len(s) or not len(q):
            return
        if len(s) > SMALL:
            vp = stored[s[len(s) // 2]]
            d = _apart(stored[s], vp).astype(np.int64)
            mid = int(np.median(d))
            inner = d <= mid
            if inner.all():
                inner = d < mid
            if inner.any() and not inner.all():
                dq = _apart(asked[q], vp).astype(np.int64)
                mid = int(d[inner].max())
                yield from walk(s[inner], q[dq - radius <= mid])
                yield from walk(s[~inner], q[dq + radius > mid])
                return
        for at in range(0, len(q), SPAN):
            part = q[at : at + SPAN]
            for lo in range(0, len(s), SPAN):
                own = s[lo : lo + SPAN]
                i, j = np.nonzero(_apart(stored[own][:, None], asked[part][None, :]) <= radius)
                if len(i):
                    yield own[i], part[j]

    yield from walk(np.arange(len(stored)), np.arange(len(asked)))


class Forest:
    """Union-find over positions 0 to n - 1 that keeps only links that join two trees. Pairs come in blocks."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            # One link for each tree that is not the smaller end: no two of them close a ring.
            high, first = np.unique(high, return_index=True)
            self.links.append((i[first], j[first]))
            up = np.arange(len(self.root))
            up[high] = low[first]
            while (up[up] != up).any():
                up = up[up]
            self.root = up[self.root]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int = 3, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that join all fingerprints within the radius of each other, without those that close a ring in one leaf.

    ``distinct``: column fp, no repeats.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    # Fingerprints are as good as random; their hash makes sure of it.
    likely = F.xxhash64("fp").cast("double") / 2.0**64 + 0.5
    taken = distinct.where(likely * total < SAMPLE << depth).select("fp").toArrow().column(0).to_numpy() if depth else np.zeros(0, np.int64)
    nodes = spark.sparkContext.broadcast(vantage_tree(np.sort(taken).view(np.uint64), depth))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for which, at, home in leaves(fp.view(np.uint64), nodes.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), at, np.int64)), pa.array(fp[which]), pa.array(home)], names=["leaf", "fp", "stored"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "leaf"):
            fp, home = group["fp"].to_numpy(), group["stored"].to_numpy()
            own, other = np.flatnonzero(home), np.flatnonzero(~home)
            forest = Forest(len(fp))
            for asked in (own, other):
                for i, j in near_pairs(fp[own].view(np.uint64), fp[asked].view(np.uint64), radius):
                    forest.add(own[i], asked[j])
            for i, j in forest.links:
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    spread_out = distinct.select("fp").mapInArrow(spread, "leaf long, fp long, stored boolean")
    width = max(shuffle_width(spark), 1 << max(0, depth - 1))
    return spread_out.repartition(width, "leaf").sortWithinPartitions("leaf").mapInArrow(search, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id whose fingerprint links reach.

    Null and empty texts have fingerprint zero and link like any other; texts
    of any length count whole. Copies meet in one fingerprint before any
    search; rows whose id is repeated or null are kept as they are, each with
    its own fingerprint. Only the two columns named are read, so others may
    have any name. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = _classes(marked, radius)
    return marked.join(shuffled(classes), "fp", "left").select("id", "fp", "component")


def least_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the least of their own fingerprint's group; null counts as an id where it is the only one."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = _classes(marked, radius)
    of_row = marked.join(shuffled(classes), "fp", "left").where(F.col("id").eqNullSafe(F.col("component")))
    # Names that no column of the documents has.
    wide = "_" * (1 + max(map(len, docs.columns)))
    kept = written(of_row.select(F.col("id").alias(wide + "id"), F.col("mark").alias(wide + "mark")).distinct(), "kept")
    return docs.join(shuffled(kept), docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col(wide + "id")) & (_mark(text_col) == F.col(wide + "mark")), "left_semi")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of each fingerprint of (id, fp)."""
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = links(distinct.select("fp"), radius)
    named = distinct.select("fp", "least")
    by_id = found.join(shuffled(named.withColumnsRenamed({"fp": "a", "least": "u"})), "a").join(shuffled(named.withColumnsRenamed({"fp": "b", "least": "v"})), "b")
    comp = components(by_id.select("u", "v"))
    classes = written(named.join(shuffled(comp), named["least"] == comp["id"], "left").select("fp", F.coalesce("component", "least").alias("component")), "classes")
    discard(distinct)
    return classes
