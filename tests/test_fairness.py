"""Sensitive columns, groups, violations, the proxy model and the full audit."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.config import FairnessConfig
from plumbline.operators import groups, scoring
from plumbline.operators.sensitive import detect_sensitive, prepare_sensitive
from plumbline.plans.audit import audit, fairness_advice

CONFIG = FairnessConfig()


# --- detection ---------------------------------------------------------------


def empty(spark, *names):
    return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["Gender", "PATIENT_AGE", "race_code"], {"sex": "Gender", "age": "PATIENT_AGE", "race": "race_code"}),
        (["RIAGENDR", "RIDAGEYR", "RIDRETH3"], {"sex": "RIAGENDR", "age": "RIDAGEYR", "race": "RIDRETH3"}),
        (["language", "trace"], {"age": "language", "race": "trace"}),
        (["sex", "gender"], {"sex": "sex"}),
        (["nationality", "marital_status", "faith", "disabled", "insured"],
         {"nationality": "nationality", "marital": "marital_status", "religion": "faith",
          "disability": "disabled", "insurance": "insured"}),
        # A second match for a type that is taken moves on to later types.
        (["age", "coverage_age"], {"age": "age", "insurance": "coverage_age"}),
        (["height"], {}),
    ],
)
def test_detection_by_name(spark, names, expected):
    assert detect_sensitive(empty(spark, *names)) == expected


@pytest.mark.parametrize(
    ("values", "hit"),
    [
        (["Male", "FEMALE"], True), (["m", "f", "x"], True), (["Man", "Woman", None], True),
        (["0", "1"], True), (["male", "other"], False), ([" m", "f"], False), (["a", "b"], False),
    ],
)
def test_detection_by_value(spark, values, hit):
    df = spark.createDataFrame([(v,) for v in values], "var_01 string")
    assert detect_sensitive(df) == ({"sex": "var_01"} if hit else {})


def test_value_rule_comes_first_in_column_order(spark):
    df = spark.createDataFrame(
        [(0, "M", 25), (1, "F", 65)], "id long, gender_col string, dob_years long"
    )
    assert detect_sensitive(df) == {"sex": "id"}
    assert detect_sensitive(df, exclude=["id"]) == {"sex": "gender_col"}
    assert detect_sensitive(df, include=["dob_years"]) == {}
    assert detect_sensitive(df.withColumn("id", F.col("id").cast("double"))) == {"sex": "gender_col"}


def test_distinct_limit_protects_row_numbers(spark):
    df = spark.range(100).select("id", F.lit("x").alias("gender"))
    assert detect_sensitive(df)["sex"] == "id"
    assert detect_sensitive(df, max_distinct=10) == {"sex": "gender"}


def test_custom_patterns_do_not_leak(spark):
    custom = {"sex": [r"^geschlecht$"], "blood": [r"^blood_group$"]}
    names = ["geschlecht", "blood_group"]
    assert detect_sensitive(empty(spark, *names), custom) == {"sex": "geschlecht", "blood": "blood_group"}
    assert detect_sensitive(empty(spark, *names)) == {}


# --- preparation -------------------------------------------------------------


def test_preparation(spark):
    rows = [(1, 10, "a"), (2, 40, "?"), (3, 41, "Unknown"), (4, 150, "b"), (5, None, None), (6, 99, "b")]
    df = spark.createDataFrame(rows, "k int, age int, race string")
    prepared = prepare_sensitive(df, {"age": "age", "race": "race"})
    got = prepared.data.orderBy("k").collect()
    assert [r["age_group"] for r in got] == ["<40", "<40", "40-60", "<40", "<40", ">60"]
    assert [r["race"] for r in got] == ["a", "b", "b", "b", "b", "b"]
    notes = {r["attribute"]: (r["n"], r["pct"]) for r in prepared.diagnostics.collect()}
    assert notes == {"age_group": (2, pytest.approx(100 / 3)), "race": (3, 50.0)}


def test_banded_ages_stay_as_they_are(spark):
    df = spark.createDataFrame([("[0-10)",), ("[10-20)",)], "age string")
    prepared = prepare_sensitive(df, {"age": "age"})
    assert {r["age_group"] for r in prepared.data.collect()} == {"[0-10)", "[10-20)"}
    assert [r["kind"] for r in prepared.diagnostics.collect()] == ["age_already_banded"]
    plain = prepare_sensitive(df, {"age": "age"}, create_age_groups=False)
    assert plain.attributes == ["age"]


def test_nothing_to_impute_from(spark):
    df = spark.createDataFrame([("?",), (None,)], "race string")
    assert [r["race"] for r in prepare_sensitive(df, {"race": "race"}).data.collect()] == ["?", None]


def test_own_bands(spark):
    df = spark.createDataFrame([(17,), (18,), (70,)], "age int")
    prepared = prepare_sensitive(df, {"age": "age"}, age_edges=(0, 17, 120), age_labels=("minor", "adult"))
    assert [r["age_group"] for r in prepared.data.collect()] == ["minor", "adult", "adult"]


# --- figures against a plain computation -------------------------------------


def plain_figures(rows, attribute, minimum=30, strict=False):
    members = {}
    for t, p, *values in rows:
        members.setdefault(tuple(values[i] for i in attribute), []).append((t, p))

    def ratio(part, whole):
        return part / whole if whole else 0.0

    rates = {}
    for group, pairs in members.items():
        positive = [p for t, p in pairs if t == 1]
        negative = [p for t, p in pairs if t == 0]
        rates[group] = (
            len(pairs), ratio(sum(p for _, p in pairs), len(pairs)),
            ratio(sum(positive), len(positive)), ratio(sum(negative), len(negative)),
        )
    large = {g: r for g, r in rates.items() if r[0] >= minimum}
    if len(large) < 2:
        return None
    used = large if strict else rates

    def spread(group_rates, i):
        values = [r[i] for r in group_rates.values()]
        return max(values) - min(values)

    selection = [r[1] for r in used.values()]
    return (
        min(selection) / max(selection), spread(used, 1),
        max(spread(used, 2), spread(used, 3)), spread(large, 2),
    )


@pytest.fixture(scope="module")
def decisions():
    r = random.Random(11)
    rows = []
    for _ in range(3000):
        sex = r.choice("MF")
        race = r.choices(["x", "y", "z_&", "rare"], [50, 30, 19, 0.5])[0]
        age = r.choice(["<40", "40-60", ">60"])
        t = int(r.random() < 0.4)
        p = int(r.random() < (0.75 if t else 0.2) - (0.2 if sex == "F" else 0))
        rows.append((t, p, sex, race, age))
    return rows


@pytest.mark.parametrize("small", ["as_coded", "strict"])
def test_figures_equal_a_plain_computation(spark, decisions, small):
    df = spark.createDataFrame(decisions, "t int, p int, sex string, race string, age_group string")
    names = ["sex", "race", "age_group"]
    report = audit(df, "t", "p", names, FairnessConfig(small_groups=small))
    got = {}
    for r in report.attribute_metrics.collect():
        got.setdefault(r["attribute"], {})[r["metric"]] = r["value"]
    expected = {}
    for size in (1, 2, 3):
        for members in itertools.combinations(range(3), size):
            figures = plain_figures(decisions, members, strict=small == "strict")
            if figures:
                expected["_&_".join(names[i] for i in members)] = figures
    assert set(got) == set(expected)
    for attribute, figures in expected.items():
        assert [got[attribute][m] for m in groups.METRICS] == pytest.approx(list(figures))
    assert report.overall_status == "BIAS_DETECTED"
    assert report.dataset_info["total_samples"] == 3000
    assert report.dataset_info["groups_analyzed"][3] == "sex_&_race"


def test_intersections_add_up_to_their_base_groups(spark, decisions):
    df = spark.createDataFrame(decisions, "t int, p int, sex string, race string, age_group string")
    counts = groups.additive_counts(df, "t", "p", ["sex", "race", "age_group"])
    rolled = groups.group_counts(counts, ["sex", "race", "age_group"], 3)
    totals = rolled.groupBy("attribute").agg(F.sum("n").alias("n"), F.sum("hits").alias("h")).collect()
    assert len(totals) == 7
    assert len({(r["n"], r["h"]) for r in totals}) == 1


def test_depth_limits_the_combinations():
    names = list("abcd")
    assert len(groups.attribute_sets(names, 3)) == 4 + 6 + 4
    assert len(groups.attribute_sets(names, 1)) == 4
    assert len(groups.attribute_sets(["a"], 3)) == 1


def test_groups_with_equal_text_stay_apart(spark):
    rows = [(1, 1, "a_b", "c")] * 40 + [(1, 0, "a", "b_c")] * 40
    df = spark.createDataFrame(rows, "t int, p int, u string, v string")
    rolled = groups.group_counts(groups.additive_counts(df, "t", "p", ["u", "v"]), ["u", "v"], 3)
    both = rolled.filter("attribute = 'u_&_v'").collect()
    assert [(r["grp"], r["n"]) for r in both] == [("a_b_c", 40), ("a_b_c", 40)]
    assert audit(df, "t", "p", ["u", "v"]).violations.count() == 12


def test_labels_must_be_binary(spark):
    for bad in (2, None):
        df = spark.createDataFrame([(1, 1, "a"), (0, bad, "b")], "t int, p int, g string")
        with pytest.raises(ValueError, match="binary"):
            audit(df, "t", "p", ["g"])
    with pytest.raises(ValueError):
        audit(spark.createDataFrame([(1, 1)], "t int, p int"), "t", "p", [])


def test_small_groups_are_noted_and_lonely_attributes_skipped(spark):
    rows = [(1, 1, "big", str(i)) for i in range(40)] + [(0, 0, "small", "x")] * 5
    df = spark.createDataFrame(rows, "t int, p int, g string, h string")
    report = audit(df, "t", "p", ["g", "h"])
    assert report.attribute_metrics.count() == 0
    assert report.overall_status == "PASS"
    assert report.recommendations == ["No bias violations detected. Continue monitoring with new data."]
    notes = report.diagnostics.filter("attribute = 'g'").collect()
    assert [(r["kind"], r["n"]) for r in notes] == [("small_group", 5)]


def biased(spark):
    male = [(1, 1, "male")] * 60 + [(0, 0, "male")] * 60
    female = [(1, 1, "female")] * 28 + [(1, 0, "female")] * 12 + [(0, 0, "female")] * 40
    return spark.createDataFrame(male + female, "t int, p int, sex string")


def test_violations_and_their_wording(spark, tmp_path):
    report = audit(biased(spark), "t", "p", ["sex"])
    rows = {r["metric"]: r for r in report.violations.collect()}
    assert rows["demographic_parity_ratio"]["value"] == pytest.approx(0.7)
    assert rows["demographic_parity_ratio"]["severity"] == "MEDIUM"
    assert rows["demographic_parity_ratio"]["interpretation"] == (
        "Female patients flagged as high-risk 30% less often than male patients"
    )
    assert rows["demographic_parity_difference"]["severity"] == "MEDIUM"
    assert rows["demographic_parity_difference"]["interpretation"] == (
        "Prediction rate differs by 15.0% across sex groups; female patients may be under-identified"
    )
    assert rows["equalized_odds_difference"]["severity"] == "HIGH"
    assert rows["equal_opportunity_difference"]["interpretation"] == (
        "Model misses 30% more actual high-risk cases in female patients (lower sensitivity)"
    )
    values = report.violation_groups.filter("metric = 'equal_opportunity_difference' and grp = 'female'")
    assert values.first()["tpr"] == pytest.approx(0.7)
    assert report.recommendations[0].startswith("⚠️ HIGH SEVERITY")
    assert report.recommendations[1:3] == [
        "Review training data for sex-based representation imbalance",
        "Consider threshold adjustment for female patient predictions",
    ]
    assert report.recommendations[-1].startswith("Document bias findings")
    assert report.violation_groups.count() == 8
    report.write_json(str(tmp_path / "a"))
    written = spark.read.json(str(tmp_path / "a" / "violations"))
    assert written.count() == 4
    head = spark.read.json(str(tmp_path / "a" / "summary")).first()
    assert head["overall_status"] == "BIAS_DETECTED"


def test_custom_metric(spark):
    extra = {"fnr": F.try_divide(F.col("positives") - F.col("hits"), F.col("positives"))}
    report = audit(biased(spark), "t", "p", ["sex"], custom_metrics=extra)
    got = {r["grp"]: r["fnr"] for r in report.group_metrics.collect()}
    assert got == {"male": 0.0, "female": pytest.approx(0.3)}


def test_title_case(spark):
    df = spark.createDataFrame([("african_american",), ("40-60_MALE",), ("<40",), ("élan vital",)], "s string")
    got = [r[0] for r in df.select(groups.title_case(F.col("s"))).collect()]
    assert got == [s.title() for s in ("african_american", "40-60_MALE", "<40", "élan vital")]


def test_advice_keeps_attribute_order():
    rows = [
        {"attribute": a, "metric": "equalized_odds_difference", "severity": "LOW",
         "lowest_rate_group": "g", "lowest_tpr_group": "h"}
        for a in ("b", "a")
    ]
    lines = fairness_advice(rows)
    assert [x for x in lines if x.startswith("Review")] == [
        "Review training data for b-based representation imbalance",
        "Review training data for a-based representation imbalance",
    ]
    # Odds alone name no group.
    assert not [x for x in lines if x.startswith("Consider threshold")]


# --- proxy model -------------------------------------------------------------


def test_targets(spark):
    df = spark.createDataFrame(
        [(1.0, " no "), (2.0, "Yes"), (3.0, "FALSE"), (None, None), (9.0, "\t0\n")], "n double, s string"
    )
    rows = df.select(
        scoring.binarize_target(df, "n").alias("n"), scoring.binarize_target(df, "s").alias("s")
    ).collect()
    assert [r["n"] for r in rows] == [1, 1, 0, 0, 0]
    assert [r["s"] for r in rows] == [0, 1, 0, 1, 0]


def test_codes_are_alphabetical_however_many_values(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CODES_PER_TASK", 30)
    words = [f"w{(i * 7919) % 1000:04d}" for i in range(700)] + ["same"] * 300
    df = spark.createDataFrame([(w, "b" if i % 2 else "a") for i, w in enumerate(words)], "w string, x string")
    rows = scoring.label_codes(df, ["w", "x"]).collect()
    got = {r["value"]: r["code"] for r in rows if r["column"] == "w"}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}
    assert {r["value"]: r["code"] for r in rows if r["column"] == "x"} == {"a": 0, "b": 1}


def test_split_is_stable(spark):
    df = spark.range(5000)
    one = {r["id"] for r in df.filter(scoring.in_test_part("id")).collect()}
    two = {r["id"] for r in df.repartition(7).filter(scoring.in_test_part("id")).collect()}
    assert one == two
    assert 1400 < len(one) < 1600


def cases(spark, n=1500):
    r = random.Random(3)
    rows = []
    for i in range(n):
        sex, age = r.choice(["Male", "Female"]), r.randrange(0, 100)
        risk = (age > 50) or (sex == "Male" and age > 30)
        rows.append((i, sex, age if i % 9 else None, r.random(), None, "Yes" if risk else "No"))
    return spark.createDataFrame(
        rows, "k long, gender string, age int, noise double, unused double, outcome string"
    )


def test_proxy_model_learns_and_keeps_original_columns(spark):
    scored = pl.score_proxy(cases(spark), "outcome", "k")
    rows = scored.data.collect()
    assert scored.data.columns == ["k", "gender", "age", "noise", "unused", "outcome", "y_true", "y_pred"]
    assert any(r["age"] is None for r in rows)
    right = sum(r["y_true"] == r["y_pred"] for r in rows)
    assert right / len(rows) > 0.85


def test_full_audit(spark):
    report = pl.audit_table(cases(spark), "outcome", "k")
    assert report.overall_status == "BIAS_DETECTED"
    assert report.dataset_info["groups_analyzed"] == ["sex", "age_group", "sex_&_age_group"]
    assert report.diagnostics.filter("kind = 'imputed_with_mode'").count() == 1


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([(i, float(i), "Yes") for i in range(20)], "k long, a double, y string")
    with pytest.raises(ValueError, match="single class"):
        pl.score_proxy(df, "y", "k")
