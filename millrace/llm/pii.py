"""Personal data by rules and by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers.
These, and strings that cannot but be keys, are the seeds of a bootstrap: the
word and sign before a seed and the quote after it are a pattern, what stands
in a pattern is an instance. On the graph of patterns and instances, Spark
scores in turn patterns by the instances they hold and instances by the
patterns they stand in; instances in patterns of high confidence are
identifiers that no rule finds. Against a pattern count instances of another
shape than its known ones, and each time that its word and sign stand in the
text without an instance, so that a common word is no pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import discard, shuffled, written
from .linededup import row_key

OPEN, CLOSE = "\x01", "\x02"

#: Kinds in the order of the digest, and their rules; each equals the plain rule that the comment gives. Lookbehinds
#: and possessive quantifiers only spare attempts that must fail again inside a run.
KINDS = ("email", "ip", "card", "phone")
RULES = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Seeds of one more kind, ``secret``: shapes of keys that services hand out, and hexadecimal strings of the length of a
#: digest in which each decimal digit and a letter occur, which hardly a number or a code does. Other keys are for the patterns.
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|" + "".join(f"(?=[0-9a-f]*?{d})" for d in "0123456789") + r"(?=[0-9]*[a-f])[0-9a-f]{32,64})(?![A-Za-z0-9])"
#: A cue (a word and an assignment sign, or a word) and an instance: a token of six or more characters with a digit.
WORD = r"(?<![\p{L}0-9_])[\p{L}_]++"
SIGN = r"""\x20?[=:#]\x20?["']?"""
INSTANCE = r"""(?=[^\s"'0-9]*+[0-9])[A-Za-z0-9+][A-Za-z0-9._%+@/-]{4,}[A-Za-z0-9]"""
#: Assignments count without an instance, too; a word alone is counted only if it may become a pattern.
CONTEXT = WORD + "(?:" + SIGN + "(?:" + INSTANCE + ")?+|\\x20" + INSTANCE + """)["']?"""
CUE = "^" + WORD + "(?:" + SIGN + "|\\x20)"

#: Rounds of scoring, the confidence from which a pattern finds, and the distinct known instances that it must hold at
#: least, in as many texts.
ROUNDS = 3
CONFIDENT = 0.7
SUPPORT = 3
#: Instances without evidence that a pattern's confidence is weighed against.
DOUBT = 1.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, 9 taken off where it exceeds 9; the sum is a multiple of ten."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: Column, x: Column) -> Column:
    digits = _digits(x)
    parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 4) & (F.when(F.length(p) < 4, p).otherwise("0").cast("int") <= 255))
    card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _pieces(text: Column, rule: str) -> Column:
    """The text cut at each match's start and end, so that matches stand at the odd places; null without a match. One pass."""
    marked = F.array(F.regexp_replace(text, rule, OPEN + "$0" + CLOSE))
    return F.get(F.transform(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), F.split(m, f"[{OPEN}{CLOSE}]"))), F.lit(0))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None, gates: dict[str, str | None] | None = None) -> DataFrame:
    """(of, crc, kind, start, stop, value) of the leftmost non-overlapping matches of each rule; a row is known by its id and its text's CRC-32.

    Starts and stops count code points; a running sum over a text's pieces gives them, so that a text's length matters once.
    """
    rules, gates = RULES if rules is None else rules, GATES if gates is None else gates
    text = F.coalesce(F.col(text_col), F.lit(""))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\x03"))
    rows = docs.select(*row_key(id_col, text_col), text.alias("text")).where(F.rlike("text", F.lit("[0-9@=:#]")))
    named = []
    for kind, rule in rules.items():
        cut = _pieces(F.col("text"), rule)
        named.append(F.struct(F.lit(kind).alias("kind"), (F.when(F.contains("text", F.lit(gates[kind])), cut) if gates.get(kind) else cut).alias("pieces")))
    # Only lengths and matches travel, not the text between them.
    sized = lambda p: F.transform(p, lambda x, i: F.struct(F.length(x).cast("long").alias("n"), F.when(i % 2 == 1, x).alias("value")))
    kinds = rows.select("of", "crc", F.explode(F.filter(F.array(*named), lambda k: k["pieces"].isNotNull())).alias("k"))
    flat = kinds.select("of", "crc", "k.kind", F.posexplode(sized(F.col("k.pieces"))).alias("nth", "piece")).select("of", "crc", "kind", "nth", "piece.*")
    # Rows that agree in id and text have the same pieces.
    flat = flat.dropDuplicates(["of", "crc", "kind", "nth"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of", "crc", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return flat.withColumn("start", before).where("value is not null").select("of", "crc", "kind", "start", (F.col("start") + F.col("n")).alias("stop"), "value")


def _shape(value: Column) -> Column:
    """Length and the kinds of characters of an instance: what its known companions are compared by."""
    kinds = [F.when(F.rlike(value, F.lit(f"[{k}]")), F.lit(str(n))).otherwise("") for n, k in enumerate(("0-9", "a-f", "g-z", "A-Z", "^0-9A-Za-z"))]
    return F.concat(*kinds, F.lit(":"), F.length(value).cast("string"))


def patterns(instances: DataFrame, bare: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(cue, closer, kind, confidence) of the bootstrap on (cue, closer, value, text, seed), seed being the kind of a seed or null; bare: (cue, n).

    A round gives a pattern, for a kind, its known instances' confidence as evidence, and weighs it against the
    instances of a shape that no known one has, the times its cue stands without an instance, and the doubt. Then an
    instance's confidence is one minus the product of its patterns' doubts; seeds stay certain. Only patterns that hold
    ``support`` distinct known instances, from as many texts, count. All steps are joins and aggregations by pattern,
    shape or instance, which aggregate before they shuffle.
    """
    key = ["cue", "closer"]
    edges = instances.groupBy(*key, "value").agg(F.max("seed").alias("seed"), F.min("text").alias("text")).withColumn("shape", _shape(F.col("value")))
    edges = written(edges, "edges")
    shapes = edges.groupBy(*key, "shape").agg(F.count("*").alias("n"))
    total = edges.groupBy(*key).agg(F.count("*").alias("values")).join(shuffled(bare.select("cue", F.col("n").alias("bare"))), "cue", "left")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("sure", F.lit(1.0))
    scored, found, spent = seeds, None, [edges]
    for k in range(rounds):
        known = edges.join(scored, "value").groupBy(*key, "kind", "shape").agg(F.sum("sure").alias("mass"), F.count("*").alias("held"), F.approx_count_distinct("text", 0.02).alias("texts"))
        alike = known.join(shuffled(shapes), [*key, "shape"])
        held = alike.groupBy(*key, "kind").agg(F.sum("mass").alias("mass"), F.sum("held").alias("held"), F.sum("texts").alias("texts"), F.sum("n").alias("alike"))
        against = F.col("values") - F.col("alike") + F.coalesce("bare", F.lit(0))
        found = held.join(shuffled(total), key).withColumn("confidence", F.col("mass") / (F.col("mass") + against + DOUBT))
        found = written(found.where((F.col("held") >= support) & (F.col("texts") >= support) & (F.col("confidence") >= confident)).select(*key, "kind", "confidence"), "patterns")
        if k + 1 < rounds:
            new = edges.join(found, key).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("sure"))
            scored = written(seeds.unionByName(new.join(seeds, ["value", "kind"], "left_anti")), "instances")
            spent += [scored, found]
    discard(*spent)
    return found


def _word_counts(docs: DataFrame, text_col: str, cues: DataFrame) -> DataFrame:
    """(cue, n): how often each cue that is a word and a space stands in all texts, as a token between blanks."""
    tokens = docs.select(F.explode(F.split(F.lower(F.col(text_col)), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("all"))
    words = cues.where(F.rlike("cue", F.lit(r"^[\p{L}_]+ $"))).select("cue", F.rtrim("cue").alias("word")).distinct()
    return words.join(shuffled(tokens), "word").select("cue", "all")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: str = SECRET) -> DataFrame:
    """(id, base, spans) for each row: arrays of (order, kind, start, stop); base holds the valid matches of the rules.

    ``spans`` adds what overlaps no base match: secrets of the shape of a seed, and instances found by bootstrap under
    their pattern's kind. A null text is empty; texts of any length are searched whole. Rows that agree in id and text
    get the same result, rows with one id and different texts each its own, a null id stays null. Only the two columns
    named are read, so others may have any name; an empty table gives an empty result.
    """
    everything = written(matches(docs, id_col, text_col, RULES | {"context": CONTEXT, "secret": seeds}, GATES), "matches")
    order = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0)).otherwise(len(KINDS))
    base = written(everything.where(F.col("kind").isin(*KINDS) & _valid(F.col("kind"), F.col("value"))).select("of", "crc", order.alias("order"), "kind", "start", "stop", "value"), "base")
    secrets = everything.where("kind = 'secret'").select("of", "crc", F.lit(len(KINDS)).alias("order"), "kind", "start", "stop", "value")
    contexts = everything.where("kind = 'context'").withColumn("lead", F.regexp_extract("value", CUE, 0)).withColumn("rest", F.expr("substring(value, length(lead) + 1)"))
    contexts = contexts.withColumn("closer", F.regexp_extract("rest", """["']$""", 0)).withColumn("value", F.expr("substring(rest, 1, length(rest) - length(closer))"))
    cue = F.lower(F.regexp_replace("lead", r"\s", " ")).alias("cue")
    contexts = contexts.select("of", "crc", cue, "closer", (F.col("start") + F.length("lead")).alias("start"), (F.col("stop") - F.length("closer")).alias("stop"), "value")
    bare = contexts.where("value = ''").groupBy("cue").agg(F.count("*").alias("n"))
    contexts = contexts.where("value <> ''")
    certain = base.select("of", "crc", "kind", "start", "stop").unionByName(secrets.select("of", "crc", "kind", "start", "stop"))
    # An instance is a seed if a seed of the same text lies inside it or around it.
    sure = contexts.join(certain.withColumnsRenamed({"start": "a", "stop": "z"}), ["of", "crc"], "left").withColumn("seed", F.when((F.col("a") < F.col("stop")) & (F.col("z") > F.col("start")), F.col("kind")))
    marked = written(sure.groupBy("of", "crc", "cue", "closer", "start", "stop", "value").agg(F.max("seed").alias("seed")), "contexts")
    edges = marked.select("cue", "closer", "value", F.xxhash64("of", "crc").alias("text"), "seed")
    best = patterns(edges, bare)
    # Words that would be patterns are counted in all texts; only if there are any do texts have to be read for that.
    words = written(_word_counts(docs, text_col, best.select("cue")), "words") if best.where(F.rlike("cue", F.lit(r"^[\p{L}_]+ $"))).head(1) else None
    if words is not None:
        followed = marked.groupBy("cue").agg(F.count("*").alias("n"))
        alone = words.join(shuffled(followed), "cue").select("cue", F.greatest(F.col("all") - F.col("n"), F.lit(0)).alias("n"))
        best = patterns(edges, bare.unionByName(alone).groupBy("cue").agg(F.sum("n").alias("n")))
    top = best.groupBy("cue", "closer").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    found = marked.where("seed is null").join(top, ["cue", "closer"]).select("of", "crc", order.alias("order"), "kind", "start", "stop")
    # Neither secrets nor found instances may overlap a base match.
    more = secrets.select("of", "crc", "order", "kind", "start", "stop").unionByName(found)
    overlap = base.select("of", "crc", F.col("start").alias("a"), F.col("stop").alias("z"))
    free = more.join(overlap, (more["of"] == overlap["of"]) & (more["crc"] == overlap["crc"]) & (F.col("a") < F.col("stop")) & (F.col("z") > F.col("start")), "left_anti").distinct()
    span = F.struct("order", "kind", "start", "stop")
    listed = base.select("of", "crc", span.alias("span"), F.lit(True).alias("basic")).unionByName(free.select("of", "crc", span.alias("span"), F.lit(False).alias("basic")))
    by_row = listed.groupBy("of", "crc").agg(F.sort_array(F.collect_list(F.when(F.col("basic"), F.col("span")))).alias("base"), F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<order:int,kind:string,start:bigint,stop:bigint>>")
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"))
    return rows.join(shuffled(by_row), ["of", "crc"], "left").select("id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
