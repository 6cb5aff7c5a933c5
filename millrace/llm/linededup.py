"""Line deduplication by smallest repeated runs, in DataFrame functions only.

A text's lines end at line breaks and after sentences, blanks behind them
included. What is deleted is defined without any hash: a line goes if it lies in
a run of lines of at least ``min_words`` words that stands earlier too, in an
earlier row or further up in the same one, word for word but for blanks at the
ends of lines. Each such run is judged for itself; runs that only touch never
add up.

A pattern takes from each line of a text the smallest run of so many words that
begins there. With them go the runs that are smallest seen from their last line:
such a run is a line and the beginning of the smallest run from the next one.
Each of both kinds is compared with all earlier positions by the first position
of its hash, in one shuffle. Their union is all of a repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import discard, shuffled, written

#: Words of a repeated run that is deleted.
MIN_WORDS = 20
#: Values with more than this part of all positions are frequent; there cannot be more of them than this. Each is dealt in so many parts.
SHARE, PARTS = 2000, 256
#: What ends a line: a line break or a sentence's end, with the blanks that follow.
ENDS = ("\n", ". ", "! ", "? ")
END = r"(?:\n|[.!?] )[ \t\r\n]*"
#: All blanks at a line's end, with those in front of a line break.
BLANKS_AT_END = r"(?=[ \t\r\n])(?<![ \t\r\n])(?:(?<=[.!?]) |[ \t\r]*+\n)[ \t\r\n]*+"
CUT = "\x01"
BLANK = " \t\r\n"
#: A word of the lines that ``keys_of`` joins, and what stands between two.
WORD, GAP = r"[^ \t\r\x01]++", r"[ \t\r\x01]++"
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    """The lines of a text; put together again they are the text, but for the cut character, which counts as a space."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(CUT), F.lit(" "))
    quick = plain
    for end in ENDS:
        quick = F.replace(quick, F.lit(end), F.lit(end + CUT))
    # Only where blanks follow an end does its line have to be found by the pattern.
    odd = lambda m: _all_or([F.contains(m, F.lit(CUT + b)) for b in BLANK])
    marked = F.transform(F.array(quick), lambda m: F.when(odd(m), F.regexp_replace(plain, END, "$0" + CUT)).otherwise(m))
    return F.split(F.get(marked, F.lit(0)), CUT)


def _all_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _words(key: Column, odd: Column | None = None) -> Column:
    """Words of a key. Only where there are other blanks than spaces, or several together, is a pattern needed; ``odd`` says so for a whole text."""
    spaces = F.octet_length(key) - F.octet_length(F.replace(key, F.lit(" "), F.lit("")))
    return F.when(key == "", 0).when(_odd(key) if odd is None else odd, F.size(F.split(key, f"[{BLANK}]+"))).otherwise(spaces + 1)


def _odd(text: Column) -> Column:
    return _all_or([F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r")])


def keys_of(text: Column) -> Column:
    """The lines of a text without the blanks at their ends, joined by the cut character. Only a text's first and last line can be empty."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(CUT), F.lit(" "))
    quick = plain
    for end in ENDS:
        quick = F.replace(quick, F.lit(end), F.lit(end.rstrip(BLANK) + CUT))
    # Only where several blanks stand at a line's end does it have to be found by the pattern.
    odd = lambda m: _all_or([F.contains(m, F.lit(x)) for b in (" ", "\t", "\r", CUT) for x in dict.fromkeys((b + CUT, CUT + b))])
    marked = F.transform(F.array(quick), lambda m: F.btrim(F.when(odd(m), F.regexp_replace(plain, BLANKS_AT_END, CUT)).otherwise(m), F.lit(BLANK)))
    return F.get(marked, F.lit(0))


def _smallest(keys: Column, min_words: int) -> Column:
    """The smallest run of so many words from each line on that has one. These lines stand together; the first one is the first line that is not empty."""
    run = f"(?:{WORD}{GAP}){{{min_words - 1}}}+{WORD}[^{CUT}]*+"
    return F.regexp_extract_all(F.concat(F.lit(CUT), keys), F.lit(f"{CUT}(?=({run}))"), F.lit(1))


def _cuts(keys: Column) -> Column:
    return F.octet_length(keys) - F.octet_length(F.replace(keys, F.lit(CUT), F.lit("")))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Rows in their order: by id (null first), then by the text's CRC-32, which tells rows with one id apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("of"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc")]


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(of, crc, span, h, k) from (of, crc, text): the runs of lines that are smallest seen from their first or last line, with two hashes; and for each row its number of lines as a negative span."""
    keys, ends, runs = F.col("keys"), F.col("ends"), F.col("runs")
    rows = rows.select("of", "crc", keys_of(F.col("text")).alias("keys"))
    rows = rows.select("of", "crc", "keys", (_cuts(keys) + 1).alias("n"), F.startswith(keys, F.lit(CUT)).cast("int").alias("lead"), _smallest(keys, min_words).alias("runs"))
    # What follows the last line that begins a run counts as the run from the next line, up to a line more than there is.
    rest = F.rtrim(F.call_function("substring_index", keys, F.lit(CUT), F.col("lead") + F.size(runs) - F.col("n")), F.lit(CUT))
    rows = rows.select("of", "crc", "n", "lead", "runs", rest.alias("rest"))
    last = F.col("lead") + F.size(runs) + F.when(F.col("rest") == "", 0).otherwise(_cuts(F.col("rest")) + 1)
    ends_of = F.concat(F.transform(runs, lambda run, i: F.col("lead") + i + _cuts(run)), F.array(last))
    rows = rows.select("of", "crc", "n", "lead", "runs", F.concat(runs, F.array("rest")).alias("ahead"), ends_of.alias("ends"))
    window = lambda a, z, run: F.struct((F.shiftleft(a.cast("long"), 32) + z).alias("span"), F.xxhash64(run).alias("h"), F.xxhash64(F.lit(1), run).alias("k"))
    from_first = F.transform(runs, lambda run, i: window(F.col("lead") + i, F.get(ends, i), run))
    # Where the runs from two neighbouring lines end more than a line apart, runs up to the lines between begin at the first one.
    apart = F.filter(F.transform(runs, lambda run, i: F.when(F.get(ends, i + 1) - F.get(ends, i) > 1, i)), lambda i: i.isNotNull())
    joined = lambda i, n: F.concat_ws(CUT, F.call_function("substring_index", F.get("ahead", i), F.lit(CUT), F.lit(1)), F.call_function("substring_index", F.get("ahead", i + 1), F.lit(CUT), n))
    up_to_last = F.transform(apart, lambda i: F.transform(F.sequence(F.get(ends, i) + 1, F.get(ends, i + 1) - 1), lambda z: window(F.col("lead") + i, z, joined(i, z - i - F.col("lead")))))
    size = F.struct((-F.col("n")).cast("long").alias("span"), F.xxhash64("of", "crc").alias("h"), F.lit(0).cast("long").alias("k"))
    return rows.select("of", "crc", F.inline(F.concat(from_first, F.flatten(up_to_last), F.array(size))))


def _frequent(rows: DataFrame, min_words: int) -> DataFrame:
    """(h): runs that would be a notable share of one task's work, at most SHARE of them, going by each sixteenth row. They are dealt otherwise, with the same result."""
    some = rows.where(F.pmod(F.xxhash64("of", "crc"), F.lit(16)) == 0)
    several = written(_windows(some, min_words).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several")
    limit = max(60, -(-several.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // SHARE))
    frequent = written(several.where(F.col("n") > limit).select("h"), "frequent")
    discard(several)
    return frequent


def _runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(of, crc, n, found) for each (of, crc): the number of lines; the runs [a, z] of lines, counted from 0, that stand earlier too, in order. These runs do not touch."""
    frequent = _frequent(rows, min_words)
    windows = _windows(rows, min_words).join(F.broadcast(frequent.select("h", F.lit(True).alias("hot"))), "h", "left")
    # The first position of a frequent run is first found in each of its parts.
    windows = windows.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("crc", "of"), F.lit(PARTS))).otherwise(F.lit(0).cast("long")))
    windows = windows.withColumn("nth", F.rank().over(Window.partitionBy("h", "k", "part").orderBy("of", "crc", "span")))
    own = (F.col("span") >= 0) & F.coalesce("hot", F.lit(False)) & (F.col("nth") == 1)
    seen = windows.where((F.col("span") < 0) | (F.col("nth") > 1) | F.col("hot"))
    seen = written(seen.select("of", "crc", "span", F.when(own, F.col("h")).alias("h"), F.when(own, F.col("k")).alias("k")), "seen")
    heads = seen.where("h is not null")
    first = written(heads.groupBy("h", "k").agg(F.min(F.struct("of", "crc", "span")).alias("first")), "first")
    heads = heads.join(F.broadcast(first), ["h", "k"]).where(F.struct("of", "crc", "span") != F.col("first"))
    spans = seen.where("h is null").select("of", "crc", "span").unionByName(heads.select("of", "crc", "span"))
    # Rows that agree in id and text are one text.
    by_row = spans.repartition("of", "crc").groupBy("of", "crc").agg((-F.min("span")).cast("int").alias("n"), F.sort_array(F.collect_set(F.when(F.col("span") >= 0, F.col("span")))).alias("spans"))
    # A run begins after a line that is in none: spans that begin later end no earlier.
    a, z = lambda p: F.shiftright(p, 32).cast("int"), lambda p: p.bitwiseAND(F.lit(2**32 - 1)).cast("int")
    begins = F.filter("spans", lambda p, i: (i == 0) | (a(p) > z(F.get("spans", F.greatest(i - 1, F.lit(0)))) + 1))
    ends = F.filter("spans", lambda p, i: F.coalesce(a(F.get("spans", i + 1)) > z(p) + 1, F.lit(True)))
    pairs = F.arrays_zip(F.transform(begins, a).alias("a"), F.transform(ends, z).alias("z"))
    found = written(by_row.select("of", "crc", "n", pairs.cast("array<struct<a:int,z:int>>").alias("found")), "found")
    discard(frequent, seen, first)
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, n_lines, n_removed, n_runs, kept) for each row of ``docs``; ``row`` holds its columns, whatever their names.

    ``kept`` is the text without the lines of repeated runs of at least ``min_words`` words. An earlier row has a
    smaller id, a null id coming first; of rows with one id and different texts the one with the smaller CRC-32 is
    earlier, and rows that agree in both are one text and judged alike. A null text has no run and stays null; texts of
    any length are cut whole, and the smallest runs of one text are held at once; an empty table gives an empty result.
    Two hashes of 64 bits stand for a run's lines.
    """
    if not 0 < min_words < 64:
        raise ValueError("min_words must be from 1 to 63")
    found = _runs(docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")), min_words)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    joined = rows.join(shuffled(found), ["of", "crc"], "left")
    run = F.coalesce(F.col("found"), F.array().cast("array<struct<a:int,z:int>>"))
    joined = joined.select("row", "text", F.col("n").cast("long").alias("n_lines"), run.alias("run"), F.when(F.size(run) > 0, lines_of(F.col("text"))).alias("lines"))
    # What stays lies between the end of one run and the start of the next.
    run = F.col("run")
    from_ = lambda k: F.when(k == 0, 0).otherwise(F.get(run, F.greatest(k - 1, F.lit(0)))["z"] + 1)
    upto = lambda k: F.coalesce(F.get(run, k)["a"], F.size("lines"))
    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size(run)), lambda k: F.slice("lines", from_(k) + 1, F.greatest(upto(k) - from_(k), F.lit(0)))))
    removed = F.aggregate(run, F.lit(0), lambda n, r: n + r["z"] - r["a"] + 1)
    kept = F.when(F.size(run) == 0, F.col("text")).otherwise(F.array_join(stay, ""))
    return joined.select("row", "n_lines", removed.cast("long").alias("n_removed"), F.size(run).cast("long").alias("n_runs"), kept.alias("kept"))
