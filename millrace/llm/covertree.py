"""Exact near-duplicates among embeddings by dual traversal of cover trees.

Equal vectors become one class first. Classes are dealt to the nearest of some
centres, the top of a cover tree over a sample; neighbouring centres share a
block, and a centre with more classes than a block holds has several. Each
block gets a cover tree whose levels halve the radius. Pairs of blocks, then
pairs of nodes, are pruned where the distance of their centres exceeds both
covering radii and the threshold's distance, and counted as a whole where even
the farthest points are within it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._store import discard, shuffle_width, shuffled, written
from .simhash import Forest, _groups

#: Components of a block's vectors; centres that classes are dealt to, at most, and classes among which they are chosen.
BLOCK = 1 << 20
CENTRES = 1024
SAMPLE = 8192
#: Pairs whose distances are computed at a time.
PAIRS = 1 << 17
#: Slack of the bounds: distances from cosines are exact to about the root of double precision.
SLACK = 1e-6
#: Cosines that differ less from the threshold are recomputed from the vectors as they are.
CLOSE = 1e-12


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector (not zero) times the power of two that brings its largest component to between 0.5 and 1: its square is a number."""
    v = np.asarray(vectors, float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def unit_of(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class CoverTree:
    """Nodes over contiguous ranges of points; a node's centre is the first point of its range."""

    def __init__(self, vectors: np.ndarray, reach: float) -> None:
        n = len(vectors)
        unit = unit_of(vectors)
        rough = unit.astype(np.float32)
        order = np.arange(n)
        lo, hi, radius, first, last = [0], [n], [0.0], [0], [0]
        level, at = [2.0], 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            first[at] = last[at] = len(lo)
            if b - a > 1:
                own = order[a:b]
                radius[at] = float(distance(unit[own] @ unit[own[0]]).max())
            r = level[at]
            if radius[at] > reach / 4 and b - a > 1:
                while r >= radius[at]:
                    r /= 2
                child = self._greedy(rough[own], r)
                # Levels that hardly gather points are left out.
                while child.max() + 1 > (b - a) / 2 and r / 2 >= reach:
                    r /= 2
                    child = self._greedy(rough[own], r)
                by = np.argsort(child, kind="stable")
                order[a:b] = own[by]
                cuts = [*np.flatnonzero(np.diff(child[by], prepend=-1)).tolist(), b - a]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    lo.append(a + x)
                    hi.append(a + y)
                    radius.append(0.0)
                    first.append(0)
                    last.append(0)
                    level.append(r)
                last[at] = len(lo)
            at += 1
        self.order, self.raw = order, vectors[order]
        self.lo, self.hi, self.first, self.last = (np.array(x, np.int64) for x in (lo, hi, first, last))
        self.radius = np.array(radius)
        self._ready()

    def _ready(self) -> None:
        self.unit = unit_of(self.raw)
        self.rough = self.unit.astype(np.float32)

    def __getstate__(self) -> dict:
        """What travels: unit vectors follow from the vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("unit", "rough")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    @staticmethod
    def _greedy(points: np.ndarray, r: float) -> np.ndarray:
        """Child of each point: in order, a point that no child's centre covers becomes a centre. Radii are measured later."""
        made, least = 0, np.float32(1 - r * r / 2)
        child = np.full(len(points), -1)
        for a in range(0, len(points), 256):
            near = points[a : a + 256] @ points.T >= least
            for i in np.flatnonzero(child[a : a + 256] < 0).tolist():
                if child[a + i] < 0:
                    own = np.flatnonzero(near[i])
                    child[own[child[own] < 0]] = made
                    child[a + i] = made
                    made += 1
        return child


def _expand(a: np.ndarray, b: np.ndarray, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, x, y) for all x in [la, ha) and y in [lb, hb) of each pair, in bounded parts."""
    na, nb = ha - la, hb - lb
    size = na * nb
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS, prepend=-1, append=-1))
    for s, e in zip(cuts, cuts[1:], strict=False):
        k, m = np.arange(s, e), size[s:e]
        if e - s == 1 and m[0] > PAIRS:
            rows = max(1, PAIRS // int(nb[s]))
            for x in range(int(la[s]), int(ha[s]), rows):
                xs = np.arange(x, min(x + rows, int(ha[s])))
                yield np.full(len(xs) * int(nb[s]), s), np.repeat(xs, nb[s]), np.tile(np.arange(lb[s], hb[s]), len(xs))
            continue
        pair = np.repeat(k, m)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        yield pair, la[pair] + nth // nb[pair], lb[pair] + nth % nb[pair]


def _alike(radius: np.ndarray, lo: int, hi: int, reach: float) -> list[np.ndarray]:
    """The nodes from lo to hi by their radius: up to a quarter of the reach, up to it, and wider."""
    kind = np.digitize(radius[lo:hi], [reach / 4, reach], right=True)
    return [lo + own for k in range(3) if len(own := np.flatnonzero(kind == k))]


def dual(one: CoverTree, two: CoverTree, cos_min: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """('points', x, y): places of linked pairs; ('nodes', a, b): pairs of nodes all of whose points link.

    With ``one is two`` each pair comes once, and a node paired with itself stands for its points' pairs.
    """
    same, reach = one is two, float(distance(np.float64(cos_min)))
    one_leaf, two_leaf = one.first == one.last, two.first == two.last

    def sift(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        near = d <= one.radius[a] + two.radius[b] + reach + SLACK
        if same:
            near &= one.lo[a] <= two.lo[b]
        a, b, d = a[near], b[near], d[near]
        # Within one node two points are at most two radii apart.
        wide = one.radius[a] + two.radius[b] + np.where(same & (a == b), 0.0, d)
        inside = (wide <= reach - SLACK) & (one.hi[a] - one.lo[a] + two.hi[b] - two.lo[b] > 2)
        return a[inside], b[inside], a[~inside], b[~inside]

    waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        a, b = waiting.pop()
        leaves = one_leaf[a] & two_leaf[b]
        pa_, pb_ = a[leaves], b[leaves]
        if len(pa_):
            for _, x, y in _expand(pa_, pb_, one.lo[pa_], one.hi[pa_], two.lo[pb_], two.hi[pb_]):
                cos = np.einsum("ij,ij->i", one.unit[x], two.unit[y])
                hit = cos >= cos_min
                for i in np.flatnonzero(np.abs(cos - cos_min) < CLOSE).tolist():
                    u, v = scaled(one.raw[x[i]]), scaled(two.raw[y[i]])
                    hit[i] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cos_min
                if same:
                    hit &= x < y
                if hit.any():
                    yield "points", x[hit], y[hit]
        a, b = a[~leaves], b[~leaves]
        if not len(a):
            continue
        la, ha = np.where(one_leaf[a], a, one.first[a]), np.where(one_leaf[a], a + 1, one.last[a])
        lb, hb = np.where(two_leaf[b], b, two.first[b]), np.where(two_leaf[b], b + 1, two.last[b])
        large = (ha - la) * (hb - lb) > 4096
        for k in np.flatnonzero(large).tolist():
            for xs in _alike(one.radius, int(la[k]), int(ha[k]), reach):
                for ys in _alike(two.radius, int(lb[k]), int(hb[k]), reach):
                    # Single precision, with its slack, leaves out most pairs; the others' distances are computed anew.
                    widest = one.radius[xs].max() + two.radius[ys].max() + reach + SLACK
                    least = np.float32(1 - min(widest, 2.0) ** 2 / 2 - (one.unit.shape[1] + 8) * 2.0**-22)
                    theirs = two.rough[two.lo[ys]].T
                    for s in range(0, len(xs), 512):
                        own = xs[s : s + 512]
                        i, j = np.nonzero(one.rough[one.lo[own]] @ theirs >= least)
                        for t in range(0, len(i), PAIRS):
                            p, q = own[i[t : t + PAIRS]], ys[j[t : t + PAIRS]]
                            ia, ib, na, nb = sift(p, q, distance(np.einsum("ij,ij->i", one.unit[one.lo[p]], two.unit[two.lo[q]])))
                            if len(ia):
                                yield "nodes", ia, ib
                            if len(na):
                                waiting.append((na, nb))
        small = np.flatnonzero(~large)
        for _, x, y in _expand(a[small], b[small], la[small], ha[small], lb[small], hb[small]) if len(small) else ():
            d = distance(np.einsum("ij,ij->i", one.unit[one.lo[x]], two.unit[two.lo[y]]))
            ia, ib, na, nb = sift(x, y, d)
            if len(ia):
                yield "nodes", ia, ib
            if len(na):
                waiting.append((na, nb))


def links_of(one: CoverTree, two: CoverTree, mult_one: np.ndarray, mult_two: np.ndarray, cos_min: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(rows linked to each point of one, of two, forest): counts weigh classes by their rows; the forest's places are
    those of ``one`` and, unless it is the same, then those of ``two``."""
    same, n = one is two, len(one.order)
    forest = Forest(n if same else n + len(two.order))
    shift = 0 if same else n
    got_one, got_two = np.zeros(n, np.int64), np.zeros(len(two.order), np.int64)
    sum_one, sum_two = (np.concatenate(([0], np.cumsum(m))) for m in (mult_one, mult_two))
    for kind, a, b in dual(one, two, cos_min):
        if kind == "points":
            np.add.at(got_one, a, mult_two[b])
            np.add.at(got_one if same else got_two, b, mult_one[a])
            forest.add(a, b + shift)
            continue
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            xs, ys = slice(one.lo[x], one.hi[x]), slice(two.lo[y], two.hi[y])
            if same and x == y:
                got_one[xs] += (sum_one[one.hi[x]] - sum_one[one.lo[x]]) - mult_one[xs]
            else:
                got_one[xs] += sum_two[two.hi[y]] - sum_two[two.lo[y]]
                (got_one if same else got_two)[ys] += sum_one[one.hi[x]] - sum_one[one.lo[x]]
            px, py = np.arange(one.lo[x], one.hi[x]), np.arange(two.lo[y], two.hi[y]) + shift
            forest.add(np.concatenate([px, np.full(len(py), px[0])]), np.concatenate([np.full(len(px), py[0]), py]))
    return got_one, got_two, forest


def _centres(vectors: np.ndarray, n: int) -> np.ndarray:
    """Centres in the order of a cover tree's levels: each radius, half the one before, adds points that none covers."""
    chosen, r = [0], 2.0
    nearest = distance(vectors @ vectors[0])
    while len(chosen) < min(n, len(vectors)) and r > 1e-3:
        r /= 2
        for i in range(len(vectors)):
            if len(chosen) >= n:
                break
            if nearest[i] > r:
                chosen.append(i)
                nearest = np.minimum(nearest, distance(vectors @ vectors[i]))
    return vectors[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    """Components as they are stored: single precision stays so while it travels."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cos_min: float = 0.95, block: int | None = None) -> DataFrame:
    """(id, n_links, component) for each row: n_links counts other rows at a cosine of at least ``cos_min`` (positive).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, like rows without an
    id; so do vectors of different lengths. Components of any finite size count: vectors are scaled by a power of two
    before they are squared. Rows with one id are one vertex of the components; each counts as a row in n_links. Only
    the two columns named are read, so others may have any name. An empty table gives an empty result.
    ``block``: vectors of a block; by default as many as have ``BLOCK`` components.
    """
    spark = rows.sparkSession
    single = isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType)
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")
    fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    # Equal vectors meet by 128 bits of hashes, so that vectors travel once, and not again for the result.
    key = [F.when(fine, F.xxhash64(vec)).alias("h"), F.when(fine, F.xxhash64(F.lit(1), vec)).alias("k")]
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.when(fine, vec).alias("vec"), *key)
    classes = written(all_rows.where("vec is not null").groupBy("h", "k").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    found = [_links(spark, classes.where(F.size("vec") == dim), n, cos_min, block or max(256, BLOCK // dim)) for dim, n in sorted(sizes.items())]
    if not found:
        return all_rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    got = found[0]
    for more in found[1:]:
        got = got.unionByName(more)
    got = written(got, "links")
    counts = got.where("count is not null").groupBy("h", "k").agg(F.sum("count").alias("count"))
    comp = components(got.where("other is not null").select("least", "other"), "least", "other")
    of_class = classes.select("h", "k", "least", "n").join(shuffled(counts), ["h", "k"], "left").join(shuffled(comp), F.col("least") == F.col("id"), "left")
    of_class = written(of_class.select("h", "k", (F.coalesce("count", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "classes")
    discard(classes, got)
    alone = all_rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return all_rows.where("vec is not null").select("id", "h", "k").join(shuffled(of_class), ["h", "k"]).select("id", "n_links", "component").unionByName(alone)


class Cells:
    """Centres, how far their classes reach, and the blocks that hold them: ``first`` and how ``many``. At most CENTRES rows."""

    def __init__(self, centres: np.ndarray, size: np.ndarray, radius: np.ndarray, block: int) -> None:
        # Each centre follows its nearest neighbour among those that are left, so that blocks gather neighbours.
        order, left = [0], np.ones(len(centres), bool)
        left[0] = False
        while left.any():
            rest = np.flatnonzero(left)
            nearest = int(rest[(centres[rest] @ centres[order[-1]]).argmax()])
            order.append(nearest)
            left[nearest] = False
        self.centres, self.radius = centres, radius
        self.first, self.many = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
        at = held = 0
        for c in order:
            if held and held + size[c] > block:
                at, held = at + 1, 0
            self.first[c], self.many[c] = at, max(1, -(-int(size[c]) // block))
            held += int(size[c])
            if self.many[c] > 1:
                at, held = at + int(self.many[c]), 0
        self.blocks = at + (held > 0)

    def near(self, block: int, reach: float) -> np.ndarray:
        """Blocks that can hold a point within reach of one in ``block``, itself among them."""
        own = np.flatnonzero((self.first <= block) & (block < self.first + self.many))
        far = distance(self.centres @ self.centres[own].T)
        hit = np.flatnonzero((far <= self.radius[:, None] + self.radius[own][None, :] + reach + SLACK).any(axis=1))
        return np.unique(np.concatenate([[block], *(np.arange(self.first[c], self.first[c] + self.many[c]) for c in hit)])).astype(np.int64)


def _links(spark, classes: DataFrame, n: int, cos_min: float, block: int) -> DataFrame:
    """(h, k, count, least, other): rows linked to a class, and links that join classes. ``classes``: of one length of vectors."""
    wanted = 1 if n <= block else min(CENTRES, -(-4 * n // block))
    taken = unit_of(np.array([r["vec"] for r in classes.orderBy("h", "k").limit(min(SAMPLE, 4 * wanted)).collect()]))
    centres = _centres(taken, wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = unit_of(_matrix(batch.column(0))) @ centres.T
                near = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64)), pa.array(distance(cos.max(axis=1)))], names=["vec", "least", "n", "h", "k", "centre", "away"])

    shape = classes.select("vec", "least", "n", "h", "k").schema
    dealt = written(classes.select(*shape.names).mapInArrow(deal, T.StructType([*shape, T.StructField("centre", T.LongType()), T.StructField("away", T.DoubleType())])), "dealt")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in dealt.groupBy("centre").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        size[r["centre"]], radius[r["centre"]] = r["n"], r["away"]
    cells = Cells(centres, size, radius, block)
    first, many = (F.element_at(F.lit([int(x) for x in own]), (F.col("centre") + 1).cast("int")) for own in (cells.first, cells.many))
    cut = dealt.withColumn("block", (first + F.pmod(F.xxhash64("k"), many)).cast("long")).drop("centre", "away")
    reach = float(distance(np.float64(cos_min)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "block"):
            group = group.combine_chunks()
            tree = CoverTree(_matrix(group["vec"].chunk(0)), reach)
            fields = {k: group[k].to_numpy()[tree.order] for k in ("least", "n", "h", "k")}
            yield pa.RecordBatch.from_arrays([pa.array([group["block"][0].as_py()], pa.int64()), pa.array([pickle.dumps((tree, fields))], pa.binary())], names=["block", "tree"])

    width = max(shuffle_width(spark), min(2 * cells.blocks, 4096))
    trees = written(cut.repartition(width, "block").sortWithinPartitions("block").mapInArrow(build, "block long, tree binary"), "trees")
    discard(dealt)
    shared = spark.sparkContext.broadcast(cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                for other in shared.value.near(own, reach).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([f"{min(own, other)}-{max(own, other)}"]), pa.array([own], pa.int64()), batch.column(1).slice(i, 1)], names=["pair", "block", "tree"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "k", "count", "least", "other"]
        for group in _groups(batches, "pair"):
            both = [pickle.loads(x) for _, x in sorted(zip(group["block"].to_pylist(), group["tree"].to_pylist(), strict=True), key=lambda p: p[0])]
            (one, f1), (two, f2) = both[0], both[-1]
            if len(both) == 1:
                two = one
            got1, got2, forest = links_of(one, two, f1["n"], f2["n"], cos_min)
            for f, got in ((f1, got1), (f2, got2))[: len(both)]:
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(f["h"][at]), pa.array(f["k"][at]), pa.array(got[at]), *[pa.nulls(len(at), pa.int64())] * 2], names=names)
            least = f1["least"] if len(both) == 1 else np.concatenate([f1["least"], f2["least"]])
            for i, j in forest.links:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(i), pa.int64())] * 3, pa.array(least[i]), pa.array(least[j])], names=names)

    pairs = trees.mapInArrow(spread, "pair string, block long, tree binary")
    met = pairs.repartition(max(shuffle_width(spark), min(2 * cells.blocks * (cells.blocks + 1), 8192)), "pair").sortWithinPartitions("pair")
    return met.mapInArrow(compare, "h long, k long, count long, least long, other long")
