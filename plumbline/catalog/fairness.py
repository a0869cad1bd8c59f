"""Sensitive-attribute and fairness queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.views import DECISIONS, LANGUAGES, SCORES, table
from plumbline.config import FairnessConfig
from plumbline.functions.columns import col
from plumbline.functions.storage import pin
from plumbline.functions.values import bands
from plumbline.operators import classes, groups, lattice, mergeable, sensitive
from plumbline.plans.audit import audit

CONFIG = FairnessConfig()
STRICT = FairnessConfig(small_groups="strict")
DETECTED = {"sex": "gender", "age": "age", "race": "race"}
ATTRIBUTES = ["sex", "age_group", "race"]

# --- preparation -------------------------------------------------------------

BAND_SQL = """CASE WHEN age >= 0 AND age <= 40 THEN '<40' WHEN age > 40 AND age <= 60 THEN '40-60'
  WHEN age > 60 AND age <= 100 THEN '>60' END"""
INVALID_SQL = "('nan', 'None', 'NaN', 'unknown', 'Unknown', 'Unknown/Invalid', '?', '')"


def _mode_sql(name: str) -> str:
    return (
        f"(SELECT {name} FROM labelled WHERE {name} IS NOT NULL AND {name} NOT IN {INVALID_SQL} "
        f"GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"
    )


PREPARED_SQL = f"""labelled AS (SELECT row_key, y_true, y_pred, gender AS sex,
  {BAND_SQL} AS age_group, race FROM ({DECISIONS.sql})),
prepared AS (SELECT row_key, y_true, y_pred, {', '.join(
    f"CASE WHEN {a} IS NULL OR {a} IN {INVALID_SQL} THEN {_mode_sql(a)} ELSE {a} END AS {a}"
    for a in ATTRIBUTES)} FROM labelled)"""


def age_bands(spark: SparkSession, folder: str) -> DataFrame:
    decisions = DECISIONS.frame(spark, folder)
    return decisions.select(
        "row_key", "age", bands(F.col("age"), sensitive.AGE_EDGES, sensitive.AGE_LABELS).alias("band")
    )


AGE_BANDS_SQL = f"SELECT row_key, age, {BAND_SQL} AS band FROM ({DECISIONS.sql})"


def detect_sex_by_value(spark: SparkSession, folder: str) -> DataFrame:
    decisions, region = DECISIONS.frame(spark, folder), table(spark, folder, "region")
    names = [c for c in decisions.columns if c != "row_key"]
    return (
        sensitive.sex_value_hits(decisions, names)
        .unionByName(sensitive.sex_value_hits(region, region.columns))
        .select("column", "hit")
    )


def _hit_sql(name: str, source: str) -> str:
    text = f"lower(CAST({name} AS VARCHAR))"
    pairs = " OR ".join(
        f"(bool_or({text} = '{a}') AND bool_or({text} = '{b}'))"
        for a, b in (("male", "female"), ("m", "f"), ("man", "woman"), ("0", "1"))
    )
    return f"SELECT '{name}' AS \"column\", ({pairs}) AS hit FROM {source}"


DETECT_SQL = f"WITH v AS ({DECISIONS.sql}) " + " UNION ALL ".join(
    [_hit_sql(c, "v") for c in ("y_true", "y_pred", "gender", "age", "race")]
    + [_hit_sql(c, "region") for c in ("r_regionkey", "r_name")]
)


def prepare_age_group(spark: SparkSession, folder: str) -> DataFrame:
    prepared = sensitive.prepare_sensitive(DECISIONS.frame(spark, folder), {"age": "age"})
    return prepared.data.select("row_key", "age_group")


def impute_sensitive_mode(spark: SparkSession, folder: str) -> DataFrame:
    detected = {"race": "race", "sex": "gender"}
    prepared = sensitive.prepare_sensitive(DECISIONS.frame(spark, folder), detected)
    return prepared.data.select("row_key", "race", "sex")


def sensitive_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    labelled, names = sensitive.raw_labels(DECISIONS.frame(spark, folder), DETECTED)
    return sensitive.invalid_counts(labelled, names)


DIAGNOSTICS_SQL = f"WITH {PREPARED_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, 'imputed_with_mode' AS kind, "
    f"count_if({a} IS NULL OR {a} IN {INVALID_SQL}) AS n, "
    f"count_if({a} IS NULL OR {a} IN {INVALID_SQL}) * 1.0 / count(*) * 100 AS pct FROM labelled"
    for a in ATTRIBUTES
) + ") WHERE n > 0"

# --- groups ------------------------------------------------------------------


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    prepared = sensitive.prepare_sensitive(DECISIONS.frame(spark, folder), DETECTED)
    # Few rows, read by several branches of the queries below.
    return pin(groups.additive_counts(prepared.data, "y_true", "y_pred", ATTRIBUTES))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_counts(_counts(spark, folder), ATTRIBUTES, CONFIG.max_intersection_depth)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_metrics(_groups(spark, folder))


def _summary(spark: SparkSession, folder: str, config: FairnessConfig = CONFIG) -> DataFrame:
    return groups.attribute_summary(_metrics(spark, folder), config)


_COUNTS_SQL = """count(*) AS n, count_if(y_pred = 1) AS predicted,
  count_if(y_pred = 1 AND y_true = 1) AS hits,
  count_if(y_pred = 1 AND y_true = 0) AS false_alarms, count_if(y_true = 1) AS positives"""


def groups_sql(source: str, attributes: list[str], with_: str) -> str:
    """CTE bodies ``grouped``, ``rates`` and ``summary`` of the attributes of a relation."""
    sets = groups.attribute_sets(attributes, 3)
    parts = " UNION ALL ".join(
        f"SELECT '{'_&_'.join(s)}' AS attribute, {number} AS set_number, "
        f"concat_ws('_', {', '.join(s)}) AS grp, {_COUNTS_SQL} FROM {source} GROUP BY {', '.join(s)}"
        for number, s in enumerate(sets)
    )
    return f"""{with_},
grouped AS ({parts}),
rates AS (SELECT attribute, set_number, contains(attribute, '_&_') AS is_intersection, grp, n,
  predicted * 1.0 / n AS selection_rate,
  (hits + n - positives - false_alarms) * 1.0 / n AS accuracy,
  coalesce(hits * 1.0 / nullif(predicted, 0), 0) AS "precision",
  coalesce(hits * 1.0 / nullif(positives, 0), 0) AS recall,
  coalesce(hits * 1.0 / nullif(positives, 0), 0) AS tpr,
  coalesce(false_alarms * 1.0 / nullif(n - positives, 0), 0) AS fpr,
  predicted, hits, false_alarms, positives FROM grouped),
summary AS (SELECT attribute, is_intersection, set_number,
  count(*) AS n_groups, count_if(n >= 30) AS n_retained,
  min(selection_rate) / nullif(max(selection_rate), 0) AS demographic_parity_ratio,
  max(selection_rate) - min(selection_rate) AS demographic_parity_difference,
  greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS equalized_odds_difference,
  max(tpr) FILTER (n >= 30) - min(tpr) FILTER (n >= 30) AS equal_opportunity_difference,
  round_even(max(round_even(tpr, 4)) FILTER (n >= 30) - min(round_even(tpr, 4)) FILTER (n >= 30), 4)
    AS listed_opportunity,
  arg_min(grp, (round_even(selection_rate, 4), grp)) FILTER (n >= 30) AS lowest_rate_group,
  arg_min(grp, (-round_even(selection_rate, 4), grp)) FILTER (n >= 30) AS highest_rate_group,
  arg_min(grp, (round_even(tpr, 4), grp)) FILTER (n >= 30) AS lowest_tpr_group
  FROM rates GROUP BY attribute, is_intersection, set_number HAVING count_if(n >= 30) >= 2)"""


DECISION_GROUPS_SQL = groups_sql("prepared", ATTRIBUTES, PREPARED_SQL)


def intersectional_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).drop("set_number")


INTERSECTIONS_SQL = f"""WITH {DECISION_GROUPS_SQL}
SELECT attribute, grp, n, predicted, hits, false_alarms, positives FROM grouped"""


def group_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return groups.retained_groups(_metrics(spark, folder), CONFIG).drop("set_number")


GROUP_METRICS_SQL = f"""WITH {DECISION_GROUPS_SQL}
SELECT attribute, is_intersection, grp, n, selection_rate, accuracy, "precision", recall, tpr, fpr
FROM rates WHERE n >= 30 AND attribute IN (SELECT attribute FROM summary)"""


def small_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.small_groups(_metrics(spark, folder), CONFIG)


SMALL_SQL = f"WITH {DECISION_GROUPS_SQL} SELECT attribute, grp, n FROM rates WHERE n < 30"


def custom_metric(spark: SparkSession, folder: str) -> DataFrame:
    hits, missed = F.col("hits"), F.col("positives") - F.col("hits")
    both = 2 * hits + F.col("false_alarms") + missed
    extra = {
        "f1": F.coalesce(F.try_divide(2 * hits, both), F.lit(0.0)),
        "fnr": F.coalesce(F.try_divide(missed, F.col("positives")), F.lit(0.0)),
    }
    return groups.group_metrics(_groups(spark, folder), extra).select("attribute", "grp", "f1", "fnr")


CUSTOM_SQL = f"""WITH {DECISION_GROUPS_SQL} SELECT attribute, grp,
  coalesce(2.0 * hits / nullif(hits + false_alarms + positives, 0), 0) AS f1,
  coalesce((positives - hits) * 1.0 / nullif(positives, 0), 0) AS fnr FROM rates"""

# --- figures per attribute ---------------------------------------------------


def _figure(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _summary(spark, folder).select("attribute", "n_groups", "n_retained", name)

    sql = f"WITH {DECISION_GROUPS_SQL} SELECT attribute, n_groups, n_retained, {name} FROM summary"
    return query, sql


def attribute_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = groups.attribute_metrics(_summary(spark, folder), CONFIG)
    return found.select("attribute", "is_intersection", "metric", "value", "threshold", "status")


METRICS_SQL = f"""{DECISION_GROUPS_SQL},
metrics AS (SELECT *, 'demographic_parity_ratio' AS metric, demographic_parity_ratio AS value,
    CASE WHEN demographic_parity_ratio > 1.25 THEN 1.25 ELSE 0.8 END AS threshold,
    demographic_parity_ratio < 0.8 OR demographic_parity_ratio > 1.25 AS broken FROM summary
  UNION ALL SELECT *, 'demographic_parity_difference', demographic_parity_difference, 0.1,
    abs(demographic_parity_difference) > 0.1 FROM summary
  UNION ALL SELECT *, 'equalized_odds_difference', equalized_odds_difference, 0.1,
    equalized_odds_difference > 0.1 FROM summary
  UNION ALL SELECT *, 'equal_opportunity_difference', equal_opportunity_difference, 0.1,
    listed_opportunity > 0.1 FROM summary)"""
ATTRIBUTE_METRICS_SQL = f"""WITH {METRICS_SQL}
SELECT attribute, is_intersection, metric, value, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN coalesce(broken, FALSE) THEN 'fail' ELSE 'pass' END AS status FROM metrics"""


def strict_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The four figures with small groups left out of all of them."""
    return _summary(spark, folder, STRICT).select("attribute", *groups.METRICS)


STRICT_SQL = f"""WITH {DECISION_GROUPS_SQL}
SELECT attribute, min(selection_rate) / nullif(max(selection_rate), 0) AS demographic_parity_ratio,
  max(selection_rate) - min(selection_rate) AS demographic_parity_difference,
  greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS equalized_odds_difference,
  max(tpr) - min(tpr) AS equal_opportunity_difference
FROM rates WHERE n >= 30 GROUP BY attribute HAVING count(*) >= 2"""


def _violations(spark: SparkSession, folder: str) -> DataFrame:
    metrics = groups.attribute_metrics(_summary(spark, folder), CONFIG)
    return groups.violations(metrics, CONFIG)


def bias_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = _violations(spark, folder)
    return found.select("metric", "attribute", "value", "threshold", "severity")


VIOLATIONS_SQL = f"""{METRICS_SQL},
violations AS (SELECT *, CASE WHEN metric = 'demographic_parity_ratio'
    THEN abs(value - threshold) ELSE abs(value) END AS size FROM metrics WHERE broken)"""
BIAS_VIOLATIONS_SQL = f"""WITH {VIOLATIONS_SQL}
SELECT metric, attribute, value, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN size > 0.2 THEN 'HIGH' WHEN size > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM violations"""


def bias_interpretation(spark: SparkSession, folder: str) -> DataFrame:
    return _violations(spark, folder).select("metric", "attribute", "interpretation")


_TITLE = """array_to_string(list_transform(
  regexp_extract_all(lower(lowest_rate_group), '\\p{L}+|\\P{L}+'),
  lambda x: upper(x[1]) || x[2:]), '')"""
_SENTENCE = f"""CASE metric
  WHEN 'demographic_parity_ratio' THEN {_TITLE} || ' patients flagged as high-risk ' ||
    printf('%.0f', (1 - value) * 100) || '% less often than ' || highest_rate_group || ' patients'
  WHEN 'demographic_parity_difference' THEN 'Prediction rate differs by ' ||
    printf('%.1f', abs(value) * 100) || '% across ' || attribute || ' groups; ' ||
    lowest_rate_group || ' patients may be under-identified'
  WHEN 'equalized_odds_difference' THEN 'Model accuracy differs by ' ||
    printf('%.1f', value * 100) || '% across ' || attribute ||
    ' groups; TPR and/or FPR are unequal'
  ELSE 'Model misses ' || printf('%.0f', value * 100) ||
    '% more actual high-risk cases in ' || lowest_tpr_group || ' patients (lower sensitivity)'
  END AS interpretation"""
INTERPRETATION_SQL = f"""WITH {VIOLATIONS_SQL}
SELECT metric, attribute, {_SENTENCE} FROM violations"""
AUDIT_SQL = f"""WITH {VIOLATIONS_SQL}
SELECT metric, attribute, value, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN size > 0.2 THEN 'HIGH' WHEN size > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {_SENTENCE} FROM violations"""


def violation_groups(spark: SparkSession, folder: str) -> DataFrame:
    metrics = _metrics(spark, folder)
    found = groups.violations(
        groups.attribute_metrics(groups.attribute_summary(metrics, CONFIG), CONFIG), CONFIG
    )
    return groups.violation_groups(found, groups.retained_groups(metrics, CONFIG))


VIOLATION_GROUPS_SQL = f"""WITH {VIOLATIONS_SQL}
SELECT v.attribute, v.metric, r.grp, r.n, r.selection_rate AS rate, r.tpr, r.fpr
FROM violations v JOIN rates r ON v.attribute = r.attribute WHERE r.n >= 30"""


def bias_dataset_info(spark: SparkSession, folder: str) -> DataFrame:
    return groups.dataset_info(_counts(spark, folder))


INFO_SQL = f"""SELECT count(*) AS total_samples, count_if(y_true = 1) AS positive_count,
  count_if(y_true = 0) AS negative_count, avg(y_true) AS positive_rate,
  avg(y_pred) AS prediction_positive_rate FROM ({DECISIONS.sql})"""


def audit_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Detection, preparation and full audit of the decisions, as one call."""
    decisions = DECISIONS.frame(spark, folder)
    detected = sensitive.detect_sensitive(decisions, exclude=["row_key", "y_true", "y_pred"])
    prepared = sensitive.prepare_sensitive(decisions, detected)
    report = audit(
        prepared.data, "y_true", "y_pred", prepared.attributes, CONFIG,
        diagnostics=prepared.diagnostics,
    )
    return report.violations.select(
        "metric", "attribute", "value", "threshold", "severity", "interpretation"
    )


def audit_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status of the full audit, and the number of its recommendations by metric found broken."""
    prepared = sensitive.prepare_sensitive(
        DECISIONS.frame(spark, folder),
        sensitive.detect_sensitive(DECISIONS.frame(spark, folder), exclude=["row_key", "y_true", "y_pred"]),
    )
    report = audit(prepared.data, "y_true", "y_pred", prepared.attributes, CONFIG)
    attributes = sum(line.startswith("Review training data for") for line in report.recommendations)
    return spark.createDataFrame(
        [(report.overall_status, report.dataset_info["total_samples"], attributes)],
        "status string, total_samples long, attributes_to_review int",
    )


AUDIT_STATUS_SQL = f"""WITH {VIOLATIONS_SQL}
SELECT CASE WHEN count(*) > 0 THEN 'BIAS_DETECTED' ELSE 'PASS' END AS status,
  (SELECT count(*) FROM ({DECISIONS.sql})) AS total_samples,
  CAST(count(DISTINCT attribute) AS INTEGER) AS attributes_to_review FROM violations"""


# --- natural groups, some attributes with small groups only ------------------

LABELS_SQL = """labelled AS (SELECT l.doc_id AS row_key, l.quality AS y_true,
  CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS y_pred, d.lang, d.source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def label_metrics(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, folder, "labels").join(documents, "doc_id")
    guessed = joined.withColumn("y_pred", F.when(col("n_chars") > 1000, 1).otherwise(0))
    counts = groups.additive_counts(guessed, "quality", "y_pred", ["lang", "source"])
    rates = groups.group_metrics(groups.group_counts(counts, ["lang", "source"], 3))
    found = groups.attribute_metrics(groups.attribute_summary(rates, CONFIG), CONFIG)
    return found.select("attribute", "metric", "value")


LABEL_METRICS_SQL = f"""WITH {groups_sql("labelled", ["lang", "source"], LABELS_SQL)}
SELECT attribute, 'demographic_parity_ratio' AS metric, demographic_parity_ratio AS value FROM summary
UNION ALL SELECT attribute, 'demographic_parity_difference', demographic_parity_difference FROM summary
UNION ALL SELECT attribute, 'equalized_odds_difference', equalized_odds_difference FROM summary
UNION ALL SELECT attribute, 'equal_opportunity_difference', equal_opportunity_difference FROM summary"""

# --- metrics beyond counts, and pruned intersections ---------------------------


def group_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the curve and calibration error of every group and pair of groups."""
    metrics = {"auc": mergeable.AreaUnderCurve(), "calibration_error": mergeable.CalibrationError()}
    found = mergeable.group_values(
        SCORES.frame(spark, folder), "y_true", "score", ["gender", "status", "urgency"], metrics, depth=2
    )
    return found.withColumns({c: F.round(c, 9) for c in metrics})


_SCORED_SETS = " UNION ALL ".join(
    f"SELECT y_true, score, '{groups.JOIN_NAMES.join(m)}' AS attribute, "
    f"concat_ws('{groups.JOIN_VALUES}', {', '.join(m)}) AS grp FROM v"
    for m in groups.attribute_sets(["gender", "status", "urgency"], 2)
)
AUC_SQL = f"""WITH v AS ({SCORES.sql}), s AS ({_SCORED_SETS}),
b AS (SELECT attribute, grp, least(floor(score * 1000), 999) AS bin, count(*) FILTER (y_true = 1) AS pos,
  count(*) FILTER (y_true = 0) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY attribute, grp ORDER BY bin
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
a AS (SELECT attribute, grp, sum(pos * (2 * below + neg)) / (2.0 * nullif(sum(pos) * sum(neg), 0)) AS auc
  FROM c GROUP BY ALL),
t AS (SELECT attribute, grp, least(floor(score * 10), 9) AS bin, count(*) AS n,
  abs(sum(score) - sum(y_true)) AS off FROM s GROUP BY ALL),
e AS (SELECT attribute, grp, CAST(sum(n) AS BIGINT) AS n, sum(off) / sum(n) AS calibration_error FROM t GROUP BY ALL)
SELECT e.attribute, e.grp, e.n, round(a.auc, 9) AS auc, round(e.calibration_error, 9) AS calibration_error
FROM e JOIN a ON a.attribute = e.attribute AND a.grp = e.grp"""

# --- more than two classes ---------------------------------------------------------

_CLASS_COLUMNS = (
    "attribute", "grp", "class", "n", "support", "predicted", "hits", "selection_rate", "precision", "tpr", "fpr",
    "accuracy",
)
_CLASS_SETS = ["source", "size"]


def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    counts = classes.confusion_counts(LANGUAGES.frame(spark, folder), "y_true", "y_pred", _CLASS_SETS)
    return pin(classes.group_confusion(pin(counts), _CLASS_SETS, depth=2))


def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every language against the rest, by source, size and both."""
    return classes.class_metrics(_confusion(spark, folder)).select(*_CLASS_COLUMNS)


def macro_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = classes.macro_metrics(classes.class_metrics(_confusion(spark, folder))).drop("members")
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("macro")})


def class_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return classes.class_gaps(classes.class_metrics(_confusion(spark, folder)))


_LABELLED = " UNION ALL ".join(
    f"SELECT '{groups.JOIN_NAMES.join(m)}' AS attribute, concat_ws('_', {', '.join(m)}) AS grp, y_true, y_pred FROM v"
    for m in groups.attribute_sets(_CLASS_SETS, 2)
)
_CLASSES_SQL = f"""WITH v AS ({LANGUAGES.sql}), g AS ({_LABELLED}),
t AS (SELECT attribute, grp, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT attribute, grp, class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
  CAST(sum(h) AS BIGINT) AS hits FROM (
    SELECT attribute, grp, y_true AS class, 1 AS s, 0 AS p, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS h FROM g
    UNION ALL SELECT attribute, grp, y_pred, 0, 1, 0 FROM g) GROUP BY ALL),
m AS (SELECT c.*, n, predicted / n AS selection_rate, coalesce(hits / nullif(predicted, 0), 0) AS precision,
  coalesce(hits / nullif(support, 0), 0) AS tpr, coalesce((predicted - hits) / nullif(n - support, 0), 0) AS fpr,
  (2 * hits + n - support - predicted) / n AS accuracy
  FROM c JOIN t ON t.attribute = c.attribute AND t.grp = c.grp)"""
CLASS_SQL = f"{_CLASSES_SQL} SELECT {', '.join(_CLASS_COLUMNS)} FROM m"
MACRO_SQL = f"""{_CLASSES_SQL} SELECT attribute, grp, max(n) AS n, count(*) AS n_classes, sum(hits) / max(n) AS accuracy,
  round(avg(precision), 9) AS macro_precision,
  round(avg(tpr), 9) AS macro_tpr, round(avg(fpr), 9) AS macro_fpr FROM m GROUP BY attribute, grp"""
CLASS_GAPS_SQL = f"""{_CLASSES_SQL} SELECT attribute, class, count(*) AS n_groups,
  max(selection_rate) - min(selection_rate) AS parity_difference,
  greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS odds_difference,
  max(tpr) - min(tpr) AS opportunity_difference FROM m WHERE n >= 30 GROUP BY attribute, class"""

LATTICE = ["gender", "status", "urgency", "race"]
PRUNED = FairnessConfig(intersection_tolerance=0.03)


def lattice_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Attribute sets looked at, with their large groups and those that show something new."""
    counts = pin(groups.additive_counts(SCORES.frame(spark, folder), "y_true", "y_pred", LATTICE))
    _, facts = lattice.pruned_counts(counts, LATTICE, PRUNED)
    rows = [(f.attribute, f.n_groups, f.n_retained, f.n_changed, f.kept) for f in facts]
    return spark.createDataFrame(
        rows, "attribute string, n_groups long, n_retained long, n_changed long, kept boolean"
    )


def lattice_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the kept sets."""
    counts = pin(groups.additive_counts(SCORES.frame(spark, folder), "y_true", "y_pred", LATTICE))
    return lattice.pruned_counts(counts, LATTICE, PRUNED)[0].drop("set_number")


def _lattice_sql() -> str:
    sets = groups.attribute_sets(LATTICE, CONFIG.max_intersection_depth)
    parents = [
        (i, sets.index(tuple(m for m in members if m != out)))
        for i, members in enumerate(sets) if len(members) > 1 for out in members
    ]
    rolled = " UNION ALL ".join(
        f"SELECT {i} AS s, {len(m)} AS size, '{groups.JOIN_NAMES.join(m)}' AS attribute, "
        f"concat_ws('_', {', '.join(m)}) AS grp, "
        + ", ".join(a if a in m else f"NULL AS {a}" for a in LATTICE)
        + ", count(*) AS n, sum(y_pred) AS predicted, sum(y_pred * y_true) AS hits, "
        f"sum(y_pred * (1 - y_true)) AS false_alarms, sum(y_true) AS positives FROM v GROUP BY {', '.join(m)}"
        for i, m in enumerate(sets)
    )
    rates = {
        "selection_rate": "predicted / n", "tpr": "coalesce(hits / nullif(positives, 0), 0)",
        "fpr": "coalesce(false_alarms / nullif(n - positives, 0), 0)",
    }
    outside = " OR ".join(
        f"any_value(g.{r}) < min(p.{r}) - {PRUNED.intersection_tolerance} "
        f"OR any_value(g.{r}) > max(p.{r}) + {PRUNED.intersection_tolerance}" for r in rates
    )
    same = " AND ".join(f"(p.{a} IS NULL OR p.{a} = g.{a})" for a in LATTICE)
    levels = []
    for size in range(1, CONFIG.max_intersection_depth + 1):
        ready = "TRUE" if size == 1 else (
            f"(SELECT count(*) FROM links WHERE child = f.s AND parent IN (SELECT s FROM l{size - 1} "
            f"WHERE kept AND n_retained > 0)) = {size}"
        )
        levels.append(
            f"l{size} AS (SELECT f.*, {'TRUE' if size == 1 else 'n_changed > 0'} AS kept FROM f "
            f"WHERE size = {size} AND {ready})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{i + 1}" for i in range(len(levels)))
    return f"""WITH v AS ({SCORES.sql}),
g AS (SELECT *, {', '.join(f'{e} AS {r}' for r, e in rates.items())} FROM ({rolled})),
links(child, parent) AS (VALUES {', '.join(map(str, parents))}),
x AS (SELECT g.s, g.grp, ({outside}) AS changed FROM g JOIN links ON links.child = g.s
  JOIN g AS p ON p.s = links.parent AND {same}
  WHERE g.n >= {CONFIG.min_group_size} GROUP BY g.s, g.grp),
f AS (SELECT g.s, size, attribute, count(*) AS n_groups, count(*) FILTER (n >= {CONFIG.min_group_size}) AS n_retained,
  CASE WHEN size = 1 THEN count(*) FILTER (n >= {CONFIG.min_group_size})
    ELSE (SELECT count(*) FROM x WHERE x.s = g.s AND changed) END AS n_changed FROM g GROUP BY g.s, size, attribute),
{', '.join(levels)}, every AS ({every})"""


LATTICE_SETS_SQL = f"{_lattice_sql()} SELECT attribute, n_groups, n_retained, n_changed, kept FROM every"
LATTICE_GROUPS_SQL = f"""{_lattice_sql()}
SELECT g.attribute, grp, n, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits,
  CAST(false_alarms AS BIGINT) AS false_alarms, CAST(positives AS BIGINT) AS positives
FROM g JOIN every ON every.s = g.s WHERE every.kept"""

QUERIES = {
    "class_metrics": (class_metrics, CLASS_SQL),
    "macro_metrics": (macro_metrics, MACRO_SQL),
    "class_gaps": (class_gaps, CLASS_GAPS_SQL),
    "group_auc": (group_auc, AUC_SQL),
    "lattice_sets": (lattice_sets, LATTICE_SETS_SQL),
    "lattice_groups": (lattice_groups, LATTICE_GROUPS_SQL),
    "age_bands": (age_bands, AGE_BANDS_SQL),
    "detect_sex_by_value": (detect_sex_by_value, DETECT_SQL),
    "prepare_age_group": (
        prepare_age_group, f"WITH {PREPARED_SQL} SELECT row_key, age_group FROM prepared"
    ),
    "impute_sensitive_mode": (
        impute_sensitive_mode, f"WITH {PREPARED_SQL} SELECT row_key, race, sex FROM prepared"
    ),
    "sensitive_diagnostics": (sensitive_diagnostics, DIAGNOSTICS_SQL),
    "intersectional_groups": (intersectional_groups, INTERSECTIONS_SQL),
    "group_metrics": (group_metrics, GROUP_METRICS_SQL),
    "small_groups": (small_groups, SMALL_SQL),
    "custom_metric": (custom_metric, CUSTOM_SQL),
    "dp_ratio": _figure("demographic_parity_ratio"),
    "dp_difference": _figure("demographic_parity_difference"),
    "equalized_odds": _figure("equalized_odds_difference"),
    "equal_opportunity": _figure("equal_opportunity_difference"),
    "attribute_metrics": (attribute_metrics, ATTRIBUTE_METRICS_SQL),
    "strict_metrics": (strict_metrics, STRICT_SQL),
    "bias_violations": (bias_violations, BIAS_VIOLATIONS_SQL),
    "bias_interpretation": (bias_interpretation, INTERPRETATION_SQL),
    "violation_groups": (violation_groups, VIOLATION_GROUPS_SQL),
    "bias_dataset_info": (bias_dataset_info, INFO_SQL),
    "audit_orders": (audit_orders, AUDIT_SQL),
    "audit_status": (audit_status, AUDIT_STATUS_SQL),
    "label_metrics": (label_metrics, LABEL_METRICS_SQL),
}
