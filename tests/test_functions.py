"""Scalar functions, quantiles, counts and reshaping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import quantiles
from plumbline.functions.columns import (
    col, groupable_columns, nan_to_null, number_columns, numeric_columns, text_columns,
    with_file_position,
)
from plumbline.functions.counts import distinct_counts, modes, value_counts
from plumbline.functions.longform import STACK_WIDTH, stack
from plumbline.functions.values import bands, clip, not_a_number, parse_number


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("72", 72.0), (" 72 ", 72.0), ("-1.5e3", -1500.0), ("5.", 5.0), (".5", 0.5), ("+3", 3.0),
        ("inf", math.inf), ("-Infinity", -math.inf),
        ("1d", None), ("1f", None), ("1_000", None), ("high", None), ("", None), ("nan", None),
        ("1e", None), (".", None), ("0x10", None), (None, None),
    ],
)
def test_numbers_parse_like_pandas(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(parse_number(col("t")).alias("n"), not_a_number(col("t")).alias("bad")).first()
    assert row["n"] == number
    assert row["bad"] == (text is not None and number is None)


def test_bands_are_closed_on_the_right(spark):
    ages = [-1.0, 0.0, 40.0, 40.5, 60.0, 61.0, 100.0, 100.1, None]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    found = [r[0] for r in df.select(bands(F.col("a"), (0, 40, 60, 100), ("<40", "40-60", ">60"))).collect()]
    assert found == [None, "<40", "<40", "40-60", "40-60", ">60", ">60", None, None]


def test_bands_need_matching_labels():
    with pytest.raises(ValueError):
        bands(F.lit(1), (0, 1), ("a", "b"))


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (0.5,), (9.0,)], "a double")
    assert [r[0] for r in df.select(clip(F.col("a"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "k int, a double"))
    assert [r["a"] for r in df.orderBy("k").collect()] == [None, 1.0, None]


def test_column_kinds(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, date'2020-01-01' AS t, "
        "1.5 AS dec, map('a', 1) AS m, array(1) AS arr, struct(map(1, 2) AS inner) AS st"
    )
    names = df.columns
    assert numeric_columns(df, names) == ["i", "d", "b", "dec"]
    assert number_columns(df, names) == ["i", "d", "dec"]
    assert text_columns(df, names) == ["s"]
    assert groupable_columns(df, names) == ["i", "d", "b", "s", "t", "dec", "arr"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c ``d` int")
    assert df.select(col("a.b"), col("c `d")).first() == (1, 2)


def test_file_position(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).coalesce(1).write.parquet(path)
    keyed, key = with_file_position(spark.read.parquet(path))
    assert key == ["__file", "__row"]
    assert sorted(r["__row"] for r in keyed.collect()) == list(range(10))


def test_stack_takes_any_number_of_columns(spark):
    width = 2 * STACK_WIDTH + 3
    df = spark.range(3).select("id", *[(F.col("id") * i).alias(f"c{i}") for i in range(width)])
    entries = [[F.lit(f"c{i}"), F.col(f"c{i}")] for i in range(width)]
    long = stack(df, entries, ["column", "value"], [F.col("id")])
    assert long.count() == 3 * width
    assert long.filter("column = 'c82' and id = 2").first()["value"] == 164


# --- quantiles ---------------------------------------------------------------

CASES = {
    "uniform": lambda r, i: r.random(),
    "hot value": lambda r, i: 5.0 if i % 3 == 0 else r.random() * 10,
    "two values": lambda r, i: float(i % 2),
    "constant": lambda r, i: 7.0,
    "heavy tail": lambda r, i: math.exp(r.gauss(0, 20)),
    "gaps": lambda r, i: None if i % 4 == 0 else float(r.randrange(50)),
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("size", [2000, 2001])
def test_narrowing_finds_the_exact_percentile(spark, monkeypatch, kind, size):
    # Small limits force several rounds.
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 40)
    r = random.Random(size)
    values = [CASES[kind](r, i) for i in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    present = np.array([v for v in values if v is not None])
    for fraction in (0.0, 0.1, 0.5, 0.93, 1.0):
        found = quantiles.percentiles(df, ["v"], fraction, exact_rows=10)["v"]
        assert found == pytest.approx(np.percentile(present, 100 * fraction), rel=1e-12)


def test_small_columns_use_one_aggregate(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, None), (float("nan"), None)], "a double, b double")
    assert quantiles.medians(df, ["a", "b"]) == {"a": 2.5, "b": None}


def test_medians_of_mixed_sizes(spark):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("all"),
        F.when(F.col("id") < 3, F.col("id").cast("double")).alias("few"),
    )
    assert quantiles.medians(df, ["all", "few"], exact_rows=100) == {"all": 499.5, "few": 1.0}


# --- counts ------------------------------------------------------------------


def test_counts_and_modes(spark):
    df = spark.createDataFrame(
        [("b", 1, 0.0), ("a", 2, -0.0), ("b", 2, 1.0), ("a", 1, None), (None, 3, None)],
        "s string, i int, d double",
    )
    found = {r["column"]: r["unique_count"] for r in distinct_counts(df, ["s", "i", "d"]).collect()}
    assert found == {"s": 2, "i": 3, "d": 2}
    rough = distinct_counts(df, ["s", "i", "d"], approximate=True)
    assert {r["column"]: r["unique_count"] for r in rough.collect()} == found
    assert {r["column"]: r["mode"] for r in modes(df, ["s", "i"]).collect()} == {"s": "a", "i": "1"}
    counted = {(r["column"], r["value"]): r["n"] for r in value_counts(df, ["s"], "string").collect()}
    assert counted == {("s", "a"): 2, ("s", "b"): 2}


def test_numeric_modes_break_ties_by_number(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,)], "i int")
    assert modes(df, ["i"], "bigint").first()["mode"] == 9


def test_csv_keeps_64_bit_numbers_and_never_rounds_longer_ones(spark, tmp_path):
    from plumbline.sources.readers import read_csv

    path = tmp_path / "ids.csv"
    path.write_text(
        "long,longer,mixed\n1234567890123456781,92233720368547758080,1.5\n"
        "1234567890123456782,92233720368547758081,92233720368547758080\n9223372036854775807,-3,2\n"
    )
    got = read_csv(spark, str(path))
    assert dict(got.dtypes) == {"long": "bigint", "longer": "string", "mixed": "double"}
    assert got.select("long").distinct().count() == 3
    assert {r["longer"] for r in got.collect()} == {"92233720368547758080", "92233720368547758081", "-3"}


def test_scratch_deletes_what_was_written_inside(spark):
    import os

    from plumbline.functions.storage import pin, scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch():
        kept = pin(spark.range(10))
        assert kept.count() == 10
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_percentiles_in_batches(spark):
    from plumbline.functions.quantiles import medians

    df = spark.range(101).selectExpr("cast(id as double) as a", "id * 2 as b", "id * 3 as c")
    assert medians(df, ["a", "b", "c"], exact_cells=150) == {"a": 50.0, "b": 100.0, "c": 150.0}


def test_long_texts_are_counted_by_digest(spark):
    from plumbline.functions.counts import distinct_counts, modes, value_counts
    from plumbline.operators import facts, profile

    head = "x" * 300
    rows = [(head + "a",), (head + "b",), (head + "b",), ("1" * 300,), ("short",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert distinct_counts(df, ["t"]).first()["unique_count"] == 4
    assert modes(df, ["t"]).first()["mode"] == head + "b"
    assert [r["value"] for r in profile.top_values(df, ["t"], 1).collect()] == [head + "b"]
    assert facts.text_facts(value_counts(df, ["t"], "string")).first()["unparsable"] == 4
    plan = distinct_counts(df, ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan


def test_long_texts_that_tie_go_by_their_whole(spark):
    from plumbline.functions.counts import modes
    from plumbline.operators import profile

    head = "x" * 300
    texts = sorted(head + tail for tail in "qwertzuiopas")
    rows = [(t,) for t in texts for _ in range(2)] + [(head,), ("z" * 400,), ("a" * 300 + "b",)]
    df = spark.createDataFrame(rows, "t string")
    assert modes(df, ["t"]).first()["mode"] == texts[0]
    top = [r["value"] for r in profile.top_values(df, ["t"], 5).collect()]
    assert top == texts[:5]
    # Below the tie, single texts in order; a text as long as its head comes before longer ones.
    top = [r["value"] for r in profile.top_values(df, ["t"], 14).collect()]
    assert top == [*texts, "a" * 300 + "b", head]
    short = spark.createDataFrame([(head[:256],), (head[:256] + "a",)], "t string")
    assert [r["value"] for r in profile.top_values(short, ["t"], 2).collect()] == [head[:256], head[:256] + "a"]


def test_no_exchange_carries_long_texts(spark):
    from plumbline.functions.counts import value_counts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = value_counts(docs, ["text"], "string")
    longest = counted.selectExpr("max(length(value)) as n").first()["n"]
    assert longest == 256
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
