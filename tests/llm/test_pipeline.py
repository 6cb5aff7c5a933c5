import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import toxicity
from millrace.llm.queries import toxicity_model

from .test_decontam import brute as brute_leaks
from .test_linededup import brute as brute_lines
from .test_simhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and returns, written and read between stages as in a run."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_toxicity(spark, steps):
    before, after = steps[0]
    bad = toxicity.score(before, toxicity_model(spark, before, SF)).where("score >= 0.5")
    gone = {r["id"] for r in bad.collect()}
    assert gone and sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in gone)


def test_line_dedup(steps):
    before, after = steps[1]
    want = brute_lines(rows(before))
    assert dict(rows(after)) == {i: want[i, zlib.crc32(t.encode())][3] for i, t in rows(before)}
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_simhash(steps):
    before, after = steps[2]
    groups = brute_groups(rows(before))
    assert sorted(rows(after)) == sorted(r for r in rows(before) if groups[r[0]][1] == r[0])


def test_decontamination(spark, steps):
    before, after = steps[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {x[0] for x in brute_leaks(rows(before), items)}
    assert leaked and sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in leaked)


def test_packing(steps):
    before, after = steps[4]
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in rows(before)}
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 1024 or n <> end").count() == 0


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1][1].count()


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that some operator gives to a column of its own.
NAMES = ["id", "toxic", "score", "kept", "n_lines", "n_removed", "n_runs", "row", "of", "crc", "fp", "mark", "component", "kept_id", "item", "partition", "found", "lang_pred", "part", "length", "rank", "a.b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, null, empty and very long texts, and extra columns with names of the operators' own."""
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    line = "this line has ten words and stands in two texts. "
    long = " ".join(f"word{k}" for k in range(60_000)) + ". " + line * 2
    rows = real + [(900, None), (900, None), (901, ""), (None, "no id here"), (None, None), (902, long), (903, line * 2 + "more."), (1, "another text of an id that is there"), real[0], (904, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(NAMES))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))
    return df, rows


@pytest.mark.parametrize("k", range(4))
def test_odd_rows_and_columns(spark, odd, k):
    df, given = odd
    name, stage = corpus_pipeline.STAGES[k]
    after = stage(spark, df, SF)
    assert after.dtypes == df.dtypes
    got = sorted(rows(after), key=str)
    if name == "toxicity":
        bad = {i for i, t in given if (i, t) not in got}
        assert set(got) <= set(given) and None not in bad and not bad & {900, 901, 902, 903, 904}
    elif name == "line dedup":
        want = brute_lines(given)
        kept = lambda i, t: t if not want[-(2**63) if i is None else i, zlib.crc32((t or "").encode())][2] else want[-(2**63) if i is None else i, zlib.crc32((t or "").encode())][3]
        assert got == sorted([(i, kept(i, t)) for i, t in given], key=str) and (903, "more.") in got
    elif name == "simhash":
        assert set(got) <= set(given) and (None, "no id here") in got and (902, given[35][1]) in got
        # Null and empty texts are one group; the null id is not its least.
        assert [i for i, t in got if not t] == [900, 900]
    else:
        assert set(got) <= set(given) and {i for i, _ in given if i is None or i >= 900} <= {i for i, _ in got}
    assert after.select(*[f"`{n}`" for n in NAMES]).distinct().collect() == [tuple(range(len(NAMES)))]


def test_odd_rows_are_packed(spark, odd):
    df, given = odd
    after = corpus_pipeline.STAGES[4][1](spark, df, SF)
    assert after.where("piece = 0").count() == len(given) and after.where("doc_id is null").count() == 2
    assert after.where("doc_id = 900").select("length").distinct().collect() == [(1,)]


def test_empty_tables_stage_by_stage(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
