"""Exact substring deduplication by a partitioned suffix array with deep-shallow sorting.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus is removed. The suffix array is dealt out by content: each window of
``length`` bytes belongs to the smallest hash among its k-grams, its anchor, so
equal windows meet in one bucket, and the windows of one anchor occurrence
travel as one context of bytes. In a bucket, suffixes are sorted from their
anchors by multikey quicksort to a shallow depth; what stays tied is ordered by
blind tries: only the place and the byte of a branch are looked at, and one
comparison with a leaf settles the rest. numpy runs all groups of a level at
once. Windows are expanded only where one anchor has different contexts.

Frequent k-grams, found on a bounded sample, are anchors only where a window
has no other. That choice changes where windows meet, never the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_width, shuffled, written
from .simhash import _groups

LENGTH = 100
#: Bytes of a k-gram, a multiple of 8: the shallow depth at anchors. Windows are sorted to SHALLOW bytes before tries.
GRAM = 24
SHALLOW = 32
#: Bytes of documents that are cut into contexts at a time; longer documents are cut with an overlap.
CHUNK = 1 << 21
#: Rows, about, from which frequent k-grams are learnt, the share of them that makes one frequent, bits of a slot.
SAMPLE = 2000
FREQUENT = 0.005
SLOT = 24
#: Bytes of text for each bucket, which is a partition of the shuffle, and bytes of contexts that are gathered before they
#: are compressed. Contexts take about three times the bytes of their text.
SHARE = 1 << 24
GATHER = 1 << 26
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
NO_ID = -(2**63)


class Anchors:
    """Anchors of all windows of a buffer of several documents."""

    def __init__(self, length: int, gram: int, frequent: np.ndarray) -> None:
        self.length, self.gram = length, gram
        self.frequent = None
        if len(frequent):
            self.frequent = np.zeros(1 << SLOT, bool)
            self.frequent[frequent] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grams(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the rolling hash, and each k-gram's mixed hash."""
        n = len(buf)
        if len(self.powers) <= n:
            one = np.ones(1, np.uint64)
            self.powers = np.concatenate((one, np.cumprod(np.full(n, _MULT, np.uint64))))
            self.inverse = np.concatenate((one, np.cumprod(np.full(n, _INV, np.uint64))))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return sums, h

    def contexts(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, windows, anchor, hash of the anchor's k-gram, hash of the context); documents end at ``ends``."""
        empty = np.zeros(0, np.int64)
        if len(buf) < self.length:
            return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
        sums, h = self.grams(buf)
        key = (h >> np.uint64(1)) & ~_LOW | np.arange(len(h), dtype=np.uint64)
        if self.frequent is not None:
            key |= self.frequent[(h >> np.uint64(64 - SLOT)).view(np.int64)].astype(np.uint64) << np.uint64(63)
        width, wide = 1, self.length - self.gram + 1
        while 2 * width <= wide:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < wide:
            key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
        at = (key & _LOW).view(np.int64)
        valid = np.zeros(len(buf) + 1, np.int32)
        begins = np.concatenate(([0], ends[:-1]))
        long = ends - begins >= self.length
        np.add.at(valid, begins[long], 1)
        np.add.at(valid, ends[long] - self.length + 1, -1)
        valid = np.cumsum(valid)[: len(at)] > 0
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        # Two documents may follow each other without an invalid start only if a window spans them, which is invalid.
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        starts, sizes = starts[valid[starts]], sizes[valid[starts]]
        anchor = at[starts]
        stop = starts + sizes - 1 + self.length
        whole = (sums[stop] - sums[starts]) * self.inverse[starts]
        whole ^= whole >> np.uint64(31)
        whole = whole * _MIX + (sizes * 256 + anchor - starts).astype(np.uint64)
        return starts, sizes, anchor, h[anchor], whole


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that orders like the bytes; buf must end in 8 bytes of padding."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))


def multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes to a depth, 8 bytes a key: (members, group) of those still tied, stable within a group."""
    members = np.arange(len(at))
    for step in range(0, depth, 8):
        key = words[at[members] + step].astype(np.uint64)
        order = np.lexsort((key, group))
        members, group, key = members[order], group[order], key[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        members, group = members[tied], group[tied]
    return members, group


def blind_tries(buf: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, members: np.ndarray, skip: int = 0) -> np.ndarray:
    """For each member the first member of its group with the same string (itself if none).

    A group's first member is the leaf that the others are compared with; those that part from it branch by
    (place, byte) and are tried anew below that branch. ``members`` index ``at`` and ``size``; groups are contiguous
    or not, but their first member in this order is the earliest. Strings of a group agree in size and in ``skip`` bytes.
    """
    leaf = np.arange(len(at))
    members, group = members.copy(), group.copy()
    known = np.full(len(members), skip)
    while len(members):
        order = np.argsort(group, kind="stable")
        members, group, known = members[order], group[order], known[order]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(new)
        pivot = members[np.repeat(first, np.diff(np.append(first, len(group))))]
        far = size[members].copy()
        live = np.flatnonzero(members != pivot)
        place = known[live]
        words = _words(buf)
        while len(live):
            a, b = words[at[members[live]] + place].astype(np.uint64), words[at[pivot[live]] + place].astype(np.uint64)
            apart = a ^ b
            if (apart != 0).any():
                hit = np.flatnonzero(apart)
                # Leading equal bytes of the two keys.
                lead = np.zeros(len(hit), np.int64)
                x = apart[hit]
                for n in (32, 16, 8):
                    high = x >> np.uint64(64 - n) == 0
                    lead += high * (n // 8)
                    x = np.where(high, x << np.uint64(n), x)
                far[live[hit]] = np.minimum(place[hit] + lead, size[members[live[hit]]])
            more = (apart == 0) & (place + 8 < size[members[live]])
            live, place = live[more], place[more] + 8
        same = far >= size[members]
        leaf[members[same]] = pivot[same]
        members, pivot, group, far = members[~same], pivot[~same], group[~same], far[~same]
        if len(members):
            branch = buf[at[members] + far].astype(np.int64)
            _, group = np.unique(np.stack([group, far * 256 + branch], axis=1), axis=0, return_inverse=True)
            group = group.ravel()
        known = far
    return leaf


def _gather(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings one after another, and 8 bytes of padding."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(at - (ends - size), size)
    return np.concatenate([buf[index], np.zeros(8, np.uint8)])


def _later(doc: np.ndarray, version: np.ndarray, start: np.ndarray, leaf: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of ``which``, those that are another place than the first one with the same string."""
    first = leaf[which]
    return which[(doc[which] != doc[first]) | (version[which] != version[first]) | (start[which] != start[first])]


_NONE = np.zeros((0, 4), np.int64)
_FIELDS = (("doc", np.int64), ("version", np.uint32), ("start", np.int64), ("windows", np.uint8), ("rel", np.uint8))


class Blobs:
    """Contexts and found spans by bucket, gathered until there is enough of them to compress well."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, bucket: int, fields: dict[str, np.ndarray], strings: np.ndarray, gone: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append(({k: fields[k].astype(t) for k, t in _FIELDS}, strings, gone))
        self.size += len(strings) + gone.nbytes

    def take(self) -> Iterator[tuple[int, bytes]]:
        for bucket, parts in self.held.items():
            gone = np.concatenate([p[2] for p in parts])
            head = np.array([sum(len(p[0]["doc"]) for p in parts), len(gone)], np.int64).tobytes()
            fields = [p[0][k].tobytes() for k, _ in _FIELDS for p in parts]
            yield bucket, zstandard.compress(b"".join([head, *fields, gone.astype(np.int64).tobytes(), *(p[1].tobytes() for p in parts)]), 6)
        self.held, self.size = {}, 0


def _merged(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows (doc, version, start, stop) in which spans that touch are one; all of a kind of equal order."""
    order = np.lexsort((start, version, doc))
    rows = np.stack([doc[order], version[order].astype(np.int64), start[order], stop[order]], axis=1)
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] > rows[:-1, 3])
    first = np.flatnonzero(new)
    out = rows[first]
    out[:, 3] = np.maximum.reduceat(rows[:, 3], first)
    return out


def _unpack(blob: bytes, length: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, fields = 16, {}
    for k, t in _FIELDS:
        fields[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    gone = np.frombuffer(raw, np.int64, m * 4, at).reshape(m, 4)
    at += m * 32
    return fields, np.frombuffer(raw, np.uint8, len(raw) - at, at), gone


def cut(pieces: list[tuple[int, int, int, bytes]], anchors: Anchors, buckets: int, into: Blobs) -> None:
    """Contexts of (doc, version, offset, bytes) pieces, by bucket; of equal contexts only the first is sent on."""
    length = anchors.length
    ends = np.cumsum([len(p[3]) for p in pieces])
    buf = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    starts, sizes, anchor, gram, whole = anchors.contexts(buf, ends)
    if not len(starts):
        return
    piece = np.searchsorted(ends, starts, "right")
    doc = np.array([p[0] for p in pieces], np.int64)[piece]
    version = np.array([p[1] for p in pieces], np.uint32)[piece]
    start = starts + np.array([p[2] for p in pieces], np.int64)[piece] - np.concatenate(([0], ends[:-1]))[piece]
    order = np.lexsort((start, version, doc, whole))
    new = np.ones(len(order), bool)
    new[1:] = whole[order][1:] != whole[order][:-1]
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    # Equal hashes are only a hint: the strings decide.
    members = order[tied]
    alike = np.unique(np.stack([group[tied], sizes[members], (anchor - starts)[members]], axis=1), axis=0, return_inverse=True)[1].ravel() if len(members) else members
    leaf = blind_tries(padded, starts, sizes - 1 + length, alike, members)
    sent = leaf == np.arange(len(starts))
    later = _later(doc, version, start, leaf, np.flatnonzero(~sent))
    bucket = ((gram >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    keep = np.flatnonzero(sent)
    keep = keep[np.argsort(bucket[keep], kind="stable")]
    for own in np.split(keep, np.flatnonzero(np.diff(bucket[keep])) + 1):
        fields = {"doc": doc[own], "version": version[own], "start": start[own], "windows": sizes[own], "rel": (anchor - starts)[own]}
        into.add(int(bucket[own[0]]), fields, _gather(buf, starts[own], sizes[own] - 1 + length)[:-8], _NONE)
    gone = _merged(doc[later], version[later], start[later], start[later] + sizes[later] - 1 + length)
    if len(gone):
        none = np.zeros(0, np.int64)
        into.add(int(gone[0, 0] % buckets), dict.fromkeys((k for k, _ in _FIELDS), none), none.view(np.uint8), gone)


def repeats(blobs: list[bytes], length: int, gram: int) -> np.ndarray:
    """Rows (doc, version, start, stop) that cover what a bucket's contexts repeat of earlier ones."""
    parts = [_unpack(b, length) for b in blobs]
    found = [p[2] for p in parts]
    f = {k: np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k, _ in _FIELDS}
    size = f["windows"] - 1 + length
    buf = np.concatenate([*(p[1] for p in parts), np.zeros(8, np.uint8)])
    at = np.cumsum(size) - size
    order = np.lexsort((f["start"], f["version"], f["doc"]))
    f, size, at = {k: v[order] for k, v in f.items()}, size[order], at[order]
    words = _words(buf)
    tied, group = multikey(words, at + f["rel"], np.zeros(len(at), np.int64), gram)
    if not len(tied):
        return np.concatenate(found)
    by = np.argsort(tied, kind="stable")
    tied, group = tied[by], group[by]
    alike = np.unique(np.stack([group, f["rel"][tied], size[tied]], axis=1), axis=0, return_inverse=True)[1].ravel()
    leaf = blind_tries(buf, at, size, alike, tied)
    later = _later(f["doc"], f["version"], f["start"], leaf, tied)
    found.append(np.stack([f["doc"][later], f["version"][later], f["start"][later], f["start"][later] + size[later]], axis=1))
    own = leaf[tied] == tied
    tied, group = tied[own], group[own]
    several = np.bincount(group)[group] > 1
    tied, group = tied[several], group[several]
    if len(tied):
        n = f["windows"][tied]
        ctx = np.repeat(tied, n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        _, key = np.unique(np.repeat(group, n) * 256 + f["rel"][ctx] - j, return_inverse=True)
        place = at[ctx] + j
        members, key = multikey(words, place, key, min(SHALLOW, length // 8 * 8))
        by = np.argsort(members, kind="stable")
        members, key = members[by], key[by]
        first = blind_tries(buf, place, np.full(len(place), length), key, members, min(SHALLOW, length // 8 * 8))
        start = f["start"][ctx] + j
        late = np.sort(_later(f["doc"][ctx], f["version"][ctx], start, first, members))
        if len(late):
            new = np.ones(len(late), bool)
            new[1:] = (ctx[late][1:] != ctx[late][:-1]) | (j[late][1:] != j[late][:-1] + 1)
            a = late[np.flatnonzero(new)]
            z = late[np.append(np.flatnonzero(new)[1:] - 1, len(late) - 1)]
            found.append(np.stack([f["doc"][ctx[a]], f["version"][ctx[a]], start[a], start[z] + length], axis=1))
    return np.concatenate(found)


def frequent_grams(docs: DataFrame, id_col: str, text_col: str, gram: int, rows_in_all: int) -> np.ndarray:
    """Slots of k-grams that a notable share of a few thousand rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, anchors, rows = np.zeros(1 << SLOT, np.uint16), Anchors(LENGTH, gram, np.zeros(0, np.int64)), 0
        for batch in batches:
            for text in batch.column(0):
                raw = (text.as_py() or "").encode()
                rows += 1
                slots = [np.unique(anchors.grams(np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - a), a))[1] >> np.uint64(64 - SLOT)) for a in range(0, len(raw) - gram, CHUNK) if min(CHUNK, len(raw) - a) >= gram]
                if slots:
                    counts[np.unique(np.concatenate(slots)).view(np.int64)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > max(3, FREQUENT * rows)))], names=["slot"])

    # Rows from all over the table; the limit is there for the bound, copies of a text count each.
    likely = F.xxhash64(F.col(id_col), F.col(text_col)).cast("double") / 2.0**64 + 0.5
    few = docs.where(likely * rows_in_all < SAMPLE).select(F.col(text_col).alias("text")).limit(2 * SAMPLE).coalesce(1)
    return np.array([r["slot"] for r in few.mapInArrow(run, "slot long").collect()], np.int64)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, version, start, stop): byte ranges, overlapping or not, that cover exactly what is to be removed.

    version: CRC-32 of the text, which tells rows with one id apart.
    """
    if gram % 8 or not gram <= length < 128:
        raise ValueError("gram must be a multiple of 8, at most length; length less than 128")
    spark = docs.sparkSession
    held = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, id_col, text_col, gram, held["n"]))
    # What a task reads and what a bucket holds in memory stay the same, however large the input.
    buckets = max(shuffle_width(spark), -(-held["bytes"] // SHARE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, blobs = Anchors(length, gram, frequent.value), Blobs()
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(enough: int) -> Iterator[pa.RecordBatch]:
            if held:
                cut(held, anchors, buckets, blobs)
                held.clear()
            if blobs.size >= enough:
                for b, blob in blobs.take():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < length:
                    continue
                version = zlib.crc32(raw)
                for a in range(0, len(raw) - length + 1, CHUNK):
                    held.append((NO_ID if i is None else i, version, a, raw[a : a + CHUNK + length - 1]))
                    size += len(held[-1][3])
                    if size >= CHUNK:
                        yield from flush(GATHER)
                        size = 0
        yield from flush(0)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "bucket"):
            rows = repeats(group["blob"].to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], names=["id", "version", "start", "stop"])

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(deal, "bucket long, blob binary")
    met = dealt.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return met.mapInArrow(sort, "id long, version long, start long, stop long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans [, kept]) for each row; spans lists the removed runs as [start, stop).

    A null text is empty. Rows that agree in id and text are one document and judged alike; of rows with one id and
    different texts the one with the smaller CRC-32 comes first; a null id comes before all others. Texts shorter than
    ``length`` stay whole, longer ones of any length are cut with overlaps. Only the two columns named are read, so
    others may have any name; an empty table gives an empty result. ``kept`` are the remaining bytes, which may cut a character.
    """
    gone = written(repeated_spans(docs, id_col, text_col, length, gram), "repeats")
    listed = gone.groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
    joined = rows.join(shuffled(listed.withColumnRenamed("id", "of")), (F.col("key") == F.col("of")) & (F.col("crc") == F.col("version")), "left").select("id", "text", F.col("found.start").alias("start"), F.col("found.stop").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, start, stop in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for a, b in zip(start.as_py() or [], stop.as_py() or [], strict=True):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for ab in merged for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged, kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            arrays = [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 + with_kept], names=names[: 6 + with_kept])

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept binary" * with_kept)
