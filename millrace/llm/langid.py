"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is
parsed from left to right into phrases, each the longest match that occurs in
the language's sample; the language with the fewest phrases for its sample's
size wins. The automata are laid out as tables in which a failed match leads
straight to the next phrase's start, so that numpy advances thousands of texts
by one letter at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces of labelled text per language from which an automaton is built, at most, and characters of a piece.
SAMPLE_PIECES = 150
PIECE = 400
#: Letters with a symbol of their own; the others share about a seventh as many.
OWN_LETTERS = 111
#: Texts are parsed in blocks of so many letters: a phrase never spans two. All languages see the same blocks.
BLOCK = 2048
#: Bytes of text that are parsed at a time.
CHUNK = 1 << 22
#: Blocks that advance together.
LANES = 2048
SHARPNESS = 12.0


def fold_table() -> np.ndarray:
    """Code point to its folded letter's code point; zero for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@dataclass
class Parser:
    """Languages, their automata as rows (state, symbol, next state) and the letters with own symbols."""

    languages: list[str]
    letters: list[int]
    automata: list[np.ndarray]
    sizes: list[int]

    def __post_init__(self) -> None:
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None, "_symbol": None, "_width": 0}

    def ready(self) -> None:
        if self._tables is not None:
            return
        fold = fold_table()
        own = np.zeros(0x110000, np.uint8)
        self._width = 1 << (len(self.letters) * 8 // 7 + 4).bit_length()
        shared = self._width - 1 - len(self.letters)
        codes = np.flatnonzero(fold)
        own[codes] = 1 + len(self.letters) + fold[codes] % shared
        for i, c in enumerate(self.letters):
            own[np.flatnonzero(fold == c)] = 1 + i
        self._symbol = own
        self._tables = [_table(rows, self._width) for rows in self.automata]

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of the text: letters, and zero for each run of other characters between them."""
        got = self._symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = got != 0
        keep[1:] |= got[:-1] != 0
        got = got[keep]
        return got[1:] if len(got) and got[0] == 0 else got

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        cuts = [(i, t[a : a + BLOCK]) for i, t in enumerate(texts) for a in range(0, len(t), BLOCK)]
        cuts.sort(key=lambda x: -len(x[1]))
        for lo in range(0, len(cuts), LANES):
            part = cuts[lo : lo + LANES]
            sizes = np.array([len(t) for _, t in part])
            grid = np.zeros((sizes[0], len(part)), np.int64)
            for k, (_, t) in enumerate(part):
                grid[: len(t), k] = t
            alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left").tolist()
            owner = np.array([i for i, _ in part])
            for j, table in enumerate(self._tables):
                # A state is the place of its row; rows are an even number long, which leaves the lowest bit free.
                state, count = np.full(len(part), len(table) - self._width), np.zeros(len(part), np.int64)
                for row, n in zip(grid, alive, strict=True):
                    step = table.take(state[:n] + row[:n])
                    count[:n] += step & 1
                    state[:n] = step & -2
                np.add.at(out[:, j], owner, count)
        return out


def automaton(text: list[int]) -> np.ndarray:
    """Transitions of the suffix automaton of a text, as rows (state, symbol, next state)."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        now = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return np.array([(s, c, t) for s, row in enumerate(nxt) for c, t in row.items()], np.int32).reshape(-1, 3)


def _table(rows: np.ndarray, width: int) -> np.ndarray:
    """Step table: place of the next state, with the lowest bit set where a phrase begins.

    The last state is where a text starts, and where a symbol leads that the sample lacks: a phrase of its own.
    """
    states = int(rows[:, [0, 2]].max(initial=0)) + 1
    first = np.full(width, states * width, np.int32)
    root = rows[rows[:, 0] == 0]
    first[root[:, 1]] = root[:, 2] * width
    table = np.tile(first + 1, (states + 1, 1))
    table[rows[:, 0], rows[:, 1]] = rows[:, 2] * width
    return table.ravel()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", pieces: int = SAMPLE_PIECES, size: int = PIECE) -> Parser:
    """Build the automata from a bounded sample of labelled text.

    All labelled texts are cut, whole, into rows of ``size`` characters; per language at most ``pieces`` of these rows
    are read, chosen by a hash of the key and the row's place, so that every part of a text is as likely as any other.
    Rows with a null text or language are left out. Other columns may have any name. Without a row the parser knows no
    language.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).cast("string").alias("key")).where("text is not null and lang is not null")
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / size)
    counts = rows.groupBy("lang").agg(F.sum(last + 1).alias("held"))
    # A language is a row here, and languages are few; a text travels with the numbers of its rows only.
    numbered = rows.join(F.broadcast(counts), "lang").select("lang", "key", "text", "held", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    order = F.xxhash64("key", "at")
    # A hash threshold keeps about 1.5 times the rows asked for; the exact bound is set among these.
    some = numbered.where((order.cast("double") / 2.0**64 + 0.5) * F.col("held") < 1.5 * pieces + 30)
    some = some.select("lang", "key", "at", F.substring("text", (F.col("at") * size + 1).cast("int"), F.lit(size)).alias("text"), order.alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "at", "text"))
    taken = some.select("lang", "text", rank.alias("nth")).where(F.col("nth") <= pieces)
    got: dict[str, list[str]] = {}
    for r in taken.orderBy("lang", "nth").collect():
        got.setdefault(r["lang"], []).append(r["text"])
    fold = fold_table()
    of = lambda t: fold[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
    seen = Counter()
    for texts in got.values():
        codes, n = np.unique(of(" ".join(texts)), return_counts=True)
        total = n.sum()
        for c, k in zip(codes.tolist(), n.tolist(), strict=True):
            seen[c] += k / total
    seen.pop(0, None)
    parser = Parser(sorted(got), [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OWN_LETTERS]], [], [])
    parser.ready()
    for lang in parser.languages:
        text: list[int] = []
        for t in got[lang]:
            text += [0, *parser.symbols(t).tolist()]
        parser.automata.append(automaton(text))
        parser.sizes.append(max(2, len(text)))
    parser._tables = None
    return parser


def predict(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score, phrases): whole texts are parsed; phrases has each language's count.

    ``und`` with score 0 for a null text, a text without a letter, or a parser without languages. Equal counts go to
    the first language in alphabetical order. The score is the winner's share after each language's phrases per
    letter are weighed against the others'. Rows are judged each for itself, repeated ones alike; a null id stays null,
    an empty table gives an empty result, and only the two columns named are read, so others may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    weights = np.log2(np.array(parser.sizes, float)) if parser.sizes else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        p.ready()
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            langs, scores, counts = ["und"] * n, np.zeros(n), np.zeros((n, len(p.languages)), np.int64)
            at = 0
            while at < n:
                held, texts, size = [], [], 0
                while at < n and size < CHUNK:
                    s = p.symbols(column[at].as_py() or "")
                    if s.any() and p.languages:
                        held.append(at)
                        texts.append(s)
                        size += len(s)
                    at += 1
                if held:
                    counts[held] = p.phrases(texts)
            held = np.flatnonzero(counts.any(axis=1))
            if len(held):
                cost = counts[held] * weights
                best = cost.argmin(axis=1)
                share = (cost / cost.min(axis=1, keepdims=True)) ** -SHARPNESS
                scores[held] = share[np.arange(len(held)), best] / share.sum(axis=1)
                for i, b in zip(held.tolist(), best.tolist(), strict=True):
                    langs[i] = p.languages[b]
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(p.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], names=["id", "lang", "score", "phrases"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang string, score double, phrases array<long>")
