"""Toxicity by a convolutional text classifier, trained in numpy.

Words become sums of hashed embeddings (of the word and of its first letters),
filters of several widths run over them, each filter's largest response over
the whole text feeds a logistic output. Thresholds are calibrated for each
language that a text's letters suggest, then moved to 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import filtered, trim
from .langid import fold_table

#: Labelled rows that are read for training, at most, chosen by a hash of their key.
TRAIN_ROWS = 8000
#: Embedding rows, and their width.
BUCKETS = 1 << 15
WIDTH = 8
#: Filter widths in words, filters of each.
SPANS = (1, 2, 3)
FILTERS = 8
#: First letters of a word that have embeddings, besides the word.
PREFIXES = (3, 4, 5)
#: Training texts that must hold a hashed feature for it to have an embedding.
LEAST = 4
EPOCHS = 8
BATCH = 128
#: Every so many training rows, one is kept for calibration.
CALIBRATE = 5
#: Letters that are scored at a time, and words that a step of training holds at a time.
CHUNK = 1 << 18
PROFILE = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.float32(-1e9)
_SALTS = [np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(len(PREFIXES) + 1)]


class Words:
    """Hashed features of the words of texts."""

    def __init__(self) -> None:
        self.fold = fold_table()
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)
        self._inv = np.uint64(pow(int(_MULT), -1, 1 << 64))

    def letters(self, text: str) -> np.ndarray:
        return self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _MULT))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, self._inv))))

    def features(self, letters: np.ndarray) -> np.ndarray:
        """A row of buckets for each word (run of letters)."""
        on = letters != 0
        edge = np.flatnonzero(np.diff(on, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        self._grow(len(letters) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(7)) * self.powers[: len(letters)])))
        base, back = sums[start], self.inverse[start]
        out = np.empty((len(start), len(PREFIXES) + 1), np.int64)
        for k, n in enumerate((*PREFIXES, None)):
            end = stop if n is None else np.minimum(stop, start + n)
            h = (sums[end] - base) * back + _SALTS[k]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            out[:, k] = h >> np.uint64(64 - 15)
        return out


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    weight: np.ndarray
    bias: float
    profiles: np.ndarray = field(default_factory=lambda: np.zeros((0, PROFILE)))
    languages: list[str] = field(default_factory=list)
    #: Per language: the logit that becomes 0.5; the last holds for texts without a letter.
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text; features[bounds[i]:bounds[i + 1]] are text i's words, no text is empty."""
        vectors = self.embed[features[:, 0]]
        for k in range(1, features.shape[1]):
            vectors = vectors + self.embed[features[:, k]]
        out = []
        left, size = _left(bounds)
        for span, w, b in zip(SPANS, self.filters, self.shift, strict=True):
            parts = vectors @ w.reshape(span, WIDTH, -1).transpose(1, 0, 2).reshape(WIDTH, -1)
            n = w.shape[1]
            got = parts[:, :n] + b
            for o in range(1, span):
                # A filter sees zeros past the end of a text that is shorter than it; others it sees by whole windows.
                later = np.zeros_like(got)
                later[: len(got) - o] = parts[o:, o * n : (o + 1) * n]
                later[left <= o] = 0
                got = got + later
            got[(left < span) & (size >= span)] = _NEVER
            out.append(np.maximum(np.maximum.reduceat(got, bounds[:-1], axis=0), 0))
        return np.concatenate(out, axis=1)

    def language(self, profiles: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(profiles, axis=1)
        if not self.languages:
            return np.zeros(len(profiles), np.int64)
        return np.where(size > 0, (profiles @ self.profiles.T).argmax(axis=1), len(self.languages))


def profile(letters: np.ndarray) -> np.ndarray:
    """Frequencies of letters, square-rooted, of length 1; zeros without a letter."""
    got = np.sqrt(np.bincount(letters[letters != 0] % PROFILE, minlength=PROFILE))
    return got / max(1e-9, np.linalg.norm(got))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Fit embeddings, filters and output by Adam. texts: feature rows, none of them empty."""
    rng = np.random.default_rng(seed)
    n_features = len(PREFIXES) + 1
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(texts, labels, strict=True):
        u = np.unique(x)
        seen[u] += 1
        toxic[u] += y
    known = (seen >= LEAST).astype(np.float32)[:, None]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    rate = labels.mean()
    # The first component starts from how much oftener toxic texts hold the feature; rare ones start near zero.
    embed[:, 0] = np.clip(np.log((toxic + 4 * rate) / (seen - toxic + 4 * (1 - rate))) - np.log(rate / (1 - rate)), -3, 3) / n_features
    embed *= known
    model = Model(embed, [rng.normal(0, 0.3, (s * WIDTH, FILTERS)).astype(np.float32) for s in SPANS], [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32), float(np.log(rate / (1 - rate))))
    for w in model.filters:
        w[::WIDTH, : FILTERS // 2] = 1.0
    model.weight = model.weight.reshape(len(SPANS), FILTERS)
    model.weight[:, : FILTERS // 2] = 0.5
    model.weight = model.weight.ravel()
    params = [model.embed, *model.filters, *model.shift, model.weight, np.array([model.bias], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pos = np.where(labels > 0, 0.5 / max(rate, 1e-6), 0.5 / max(1 - rate, 1e-6))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            # Long texts make a batch several parts, whose gradients add up to the batch's.
            words = np.cumsum([len(texts[i]) for i in ids])
            grads = None
            for part in np.split(ids, np.flatnonzero(np.diff(words // (CHUNK // 8))) + 1):
                x = np.concatenate([texts[i] for i in part])
                bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in part])))
                share = np.float32(len(part) / len(ids))
                got = [g * share for g in _gradients(model, x, bounds, labels[part], pos[part], float(params[-1][0]))]
                grads = got if grads is None else [a + b for a, b in zip(grads, got, strict=True)]
            t += 1
            step = 0.02 * min(1.0, 2 * (1 - epoch / EPOCHS))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            model.embed *= known
            model.bias = float(params[-1][0])
    return model


def _left(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: words from it to its text's end, words of its text."""
    size = np.diff(bounds)
    return np.repeat(bounds[1:], size) - np.arange(bounds[-1]), np.repeat(size, size)


def _gradients(model: Model, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float) -> list[np.ndarray]:
    vectors = model.embed[x].sum(axis=1)
    left, size = _left(bounds)
    padded = np.concatenate([vectors, np.zeros((max(SPANS), WIDTH), np.float32)])
    pools, where = [], []
    for span, w, b in zip(SPANS, model.filters, model.shift, strict=True):
        windows = np.concatenate([padded[o : o + len(vectors)] * (left > o)[:, None] for o in range(span)], axis=1)
        got = windows @ w + b
        got[(left < span) & (size >= span)] = _NEVER
        top = np.maximum.reduceat(got, bounds[:-1], axis=0)
        hit = got == np.repeat(top, np.diff(bounds), axis=0)
        place = np.maximum.reduceat(np.where(hit, left[:, None], 0), bounds[:-1], axis=0)
        where.append((bounds[1:, None] - place, windows))
        pools.append(top)
    pooled = np.concatenate(pools, axis=1)
    live = np.maximum(pooled, 0)
    p = _sigmoid(live @ model.weight + bias)
    d = ((p - y) * weight / len(y)).astype(np.float32)
    g_embed = np.zeros_like(model.embed)
    g_filters, g_shift = [], []
    for k, span in enumerate(SPANS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g = d[:, None] * model.weight[cols] * (pooled[:, cols] > 0)
        place, windows = where[k]
        g_filters.append(np.einsum("bf,bfd->df", g, windows[place]) + 1e-5 * model.filters[k])
        g_shift.append(g.sum(axis=0))
        back = (g[:, :, None] * model.filters[k].T[None]).reshape(*g.shape, span, WIDTH)
        ends = np.repeat(bounds[1:, None], FILTERS, axis=1)
        for o in range(span):
            at = place + o
            ok = (at < ends) & (g != 0)
            rows = x[at[ok]]
            for c in range(rows.shape[1]):
                np.add.at(g_embed, rows[:, c], back[:, :, o][ok])
    return [g_embed, *g_filters, *g_shift, live.T @ d + 1e-4 * model.weight, np.array([d.sum()], np.float32)]


def calibrated(model: Model, features: list[np.ndarray], profiles: np.ndarray, labels: np.ndarray) -> None:
    """Set each language's cut where F1 on these texts is best, in the middle of the gap; with few toxic texts, all languages' cut."""

    def cut(logits: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-logits, kind="stable")
        z, hits = logits[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, y.sum()))
        k = int(f1.argmax())
        return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)

    logits = scores_of(model, features)
    langs = model.language(profiles)
    overall = cut(logits, labels) if len(labels) and labels.any() else 0.0
    model.cuts = np.full(len(model.languages) + 1, overall)
    for k in range(len(model.languages)):
        own = langs == k
        if labels[own].sum() >= 10:
            model.cuts[k] = cut(logits[own], labels[own])


def scores_of(model: Model, features: list[np.ndarray]) -> np.ndarray:
    """Logits of texts given as feature rows; long texts run in parts that overlap by a filter's width."""
    out = np.zeros((len(features), FILTERS * len(SPANS)), np.float32)
    owner, parts, size, lap = [], [], 0, max(SPANS) - 1

    def flush() -> None:
        if parts:
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            np.maximum.at(out, owner, model.pooled(np.concatenate(parts), bounds))
            owner.clear()
            parts.clear()

    for i, x in enumerate(features):
        for a in range(0, max(1, len(x) - lap), CHUNK // 8):
            part = x[a : a + CHUNK // 8 + lap]
            if len(part):
                owner.append(i)
                parts.append(part)
                size += len(part)
            if size >= CHUNK // 8:
                flush()
                size = 0
    flush()
    return out @ model.weight + model.bias


def _prepared(taken: DataFrame) -> DataFrame:
    """(features, profile, y, lang): what training needs of each whole text, made where the text is; 8 bytes a word, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            features, profiles = [], []
            for text in batch.column(0):
                letters = words.letters(text.as_py())
                made = _features_of(words, letters).astype("<u2").tobytes()
                features.append(zlib.compress(made, 1) if made else b"")
                profiles.append(profile(letters).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array(profiles, pa.binary()), batch.column(1), batch.column(2)], names=["features", "profile", "y", "lang"])
        trim()

    return taken.mapInArrow(run, "features binary, profile binary, y double, lang string")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """Train on at most ``rows`` rows of (text, label, language), their whole texts; None without a row of each label.

    Rows without a text, a label or a word are left out. The language only groups texts whose letter frequencies give
    each language's profile.
    """
    taken = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("y"), F.col(lang_col).cast("string").alias("lang"))
    got = _prepared(taken.where("text is not null and y is not null").limit(rows)).collect()
    keep = sorted(((zlib.decompress(r["features"]), r["y"], r["lang"] or "", r["lang"], bytes(r["profile"])) for r in got if r["features"]), key=lambda r: r[:3])
    y = np.array([float(r[1] > 0) for r in keep])
    if not len(y) or y.min() == y.max():
        return None
    features = [np.frombuffer(r[0], "<u2").reshape(-1, len(PREFIXES) + 1) for r in keep]
    profiles, langs = np.array([np.frombuffer(r[4], "<f4") for r in keep], float), [r[3] for r in keep]
    order = np.random.default_rng(1).permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[::CALIBRATE]] = True
    if y[~held].min() == y[~held].max():
        held[:] = False
    model = train([x for x, h in zip(features, held, strict=True) if not h], y[~held])
    model.languages = sorted({x for x in langs if x is not None})
    if model.languages:
        model.profiles = np.array([profiles[[x == k for x in langs]].mean(axis=0) for k in model.languages])
        model.profiles /= np.linalg.norm(model.profiles, axis=1, keepdims=True)
    calibrated(model, features if not held.any() else [x for x, h in zip(features, held, strict=True) if h], profiles[held] if held.any() else profiles, y[held] if held.any() else y)
    del got, keep, features
    trim()
    return model


def _scores(model: Model | None, words: Words, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    at = 0
    while model is not None and at < len(column):
        first, size, held, profiles = at, 0, [], []
        while at < len(column) and size < CHUNK:
            letters = words.letters(column[at].as_py() or "")
            held.append(_features_of(words, letters))
            profiles.append(profile(letters))
            size += len(letters)
            at += 1
        logits = scores_of(model, held)
        out[first:at] = _sigmoid(logits - model.cuts[model.language(np.array(profiles))])
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): whole texts, 0 to 1, at least 0.5 means toxic.

    Null texts and texts without a letter get the score of no evidence; without a model every score is 0. Rows are
    scored each for itself, repeated ones alike; a null id stays null, an empty table gives an empty result, and only
    the two columns named are read, so others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, words, batch.column(1)))], names=["id", "score"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def clean(docs: DataFrame, model: Model | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than ``limit``. No shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, words, batch.column(at)) < limit))
        trim()

    return filtered(docs, run)


def _features_of(words: Words, letters: np.ndarray) -> np.ndarray:
    """Features of a text of any length, by parts that end between words."""
    if len(letters) <= CHUNK:
        return words.features(letters)
    gaps = np.flatnonzero(letters == 0)
    parts, at = [], 0
    while at < len(letters):
        end = len(letters) if at + CHUNK >= len(letters) else at + CHUNK
        if end < len(letters):
            k = np.searchsorted(gaps, end)
            end = int(gaps[k]) if k < len(gaps) else len(letters)
        parts.append(words.features(letters[at:end]))
        at = end
    return np.concatenate(parts)
