"""Queries that write their inputs or stages first, and those on flat samples and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.operators import balance, evaluate, labels, learn, samples, tsfeatures
from onsetframe.plans.config import config_grid
from onsetframe.plans.extraction import extract_grid
from onsetframe.schemas import ECG_FEATURES
from onsetframe.session import checkpointed, join_path, shared_folder
from onsetframe.sources.stages import write_metrics
from onsetframe.sources.tables import ClinicalTables, read_code_list, read_sample
from workload import queries as base
from workload import sqltext as q
from workload.adapters import EVENT_IDS, LAB_FEATURES, LAB_IDS, Star
from workload.registry import query
from workload.shapes import cell, coded, shown


def scratch(star: Star, name: str) -> str:
    return join_path(shared_folder(star.spark), name, uuid.uuid4().hex)


def clinic(star: Star) -> ClinicalTables:
    """The adapters as the named tables of a clinic."""
    signals = star.signals()
    ecg = signals.select(
        "patient_id", F.col("signal_time").alias("ecg_time"), *[(F.col("value") + j).alias(f) for j, f in enumerate(ECG_FEATURES)]
    )
    tables = ClinicalTables(star.spark, join_path(shared_folder(star.spark), "no_clinic"))
    return (
        tables.replace("analyses", star.analyses()).replace("patients", star.patients()).replace("admissions", star.admissions())
        .replace("diagnoses", star.diagnoses()).replace("diagnoses_lookup", star.diagnoses_lookup())
        .replace("analyses_lookup", star.event_names()).replace("ecg_machine_measurements", ecg)
    )


# --- sources -------------------------------------------------------------------------


@query(
    q.with_(q.DIAGNOSES, q.LOOKUP)
    + """SELECT diagnosis_code, count(*) AS occurrence_count, any_value(long_title) AS long_title
FROM diagnoses JOIN diagnoses_lookup USING (diagnosis_code) GROUP BY diagnosis_code"""
)
def code_list(star: Star) -> DataFrame:
    """A code list written as a JSON array with counts as text, read back under the normalised names."""
    counted = star.diagnoses().groupBy("diagnosis_code").agg(F.count("*").cast("string").alias("occurrence_count"))
    record = F.struct(F.col("diagnosis_code").alias("icd_code"), "occurrence_count", "long_title")
    # one record per code of the lookup
    listed = counted.join(star.diagnoses_lookup(), "diagnosis_code").agg(F.to_json(F.collect_list(record)).alias("value"))
    path = scratch(star, "code_list")
    listed.coalesce(1).write.text(path)
    return read_code_list(star.spark, path)


@query("SELECT o_custkey AS patient_id, o_orderkey AS admission_id, CAST(o_orderkey % 100 AS DOUBLE) AS analysis_value FROM orders WHERE o_orderkey % 10 <> 0"
       " UNION ALL SELECT o_custkey, o_orderkey, NULL FROM orders WHERE o_orderkey % 10 = 0")
def parquet_sample(star: Star) -> DataFrame:
    """A Parquet sample under raw names; NaN becomes NULL."""
    key, path = F.col("o_orderkey"), scratch(star, "sample")
    value = F.when(key % 10 == 0, float("nan")).otherwise((key % 100).cast("double"))
    star.read("orders").select(F.col("o_custkey").alias("subject_id"), key.alias("hadm_id"), value.alias("valuenum")).write.parquet(path)
    return read_sample(star.spark, path)


@query(
    q.with_(q.PATIENTS, q.ADMISSIONS)
    + """SELECT gender, age // 10 AS decade, count(*) AS admissions, count(DISTINCT patient_id) AS people
FROM patients JOIN admissions USING (patient_id) GROUP BY 1, 2"""
)
def named_views(star: Star) -> DataFrame:
    """SQL over the registered views of the named tables."""
    clinic(star).register_views()
    return star.spark.sql("""SELECT gender, age div 10 AS decade, count(*) AS admissions, count(DISTINCT patient_id) AS people
        FROM patients JOIN admissions USING (patient_id) GROUP BY 1, 2""")


@query(
    "SELECT unnest(['accuracy', 'f1_score', 'precision', 'recall', 'mcc', 'kappa']) AS metric, "
    "unnest([accuracy, f1_score, precision, recall, mcc, kappa]) AS value FROM ("
    + q.with_(base.BINARY, *base._class_ctes("bin")) + base._summary_sql("binary") + ")"
)
def metrics_file(star: Star) -> DataFrame:
    """Scalar metrics written as JSON and read back."""
    metrics = evaluate.summary(base.binary_confusion(star))
    names = metrics.columns
    rows = metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n in names])))
    path = scratch(star, "metrics")
    write_metrics(rows, path)
    return star.spark.read.schema("metric string, value double").json(path)


# --- labels and samples ---------------------------------------------------------------


@query(
    q.with_(q.ADMISSIONS)
    + f"SELECT patient_id, admission_id, {q.time_text('discharge_time')} AS discharge_time FROM admissions WHERE admission_id % 11 <> 0"
)
def discharges(star: Star) -> DataFrame:
    """Discharge times as text; what is no time is coerced away."""
    text = F.when(F.col("admission_id") % 11 == 0, "not known").otherwise(F.date_format("discharge_time", "yyyy-MM-dd HH:mm:ss"))
    return shown(labels.discharges(star.admissions().withColumn("discharge_time", text)))


@query(
    q.with_(*base.LAB_LABELS) + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, label FROM labels_cte"
)
def labels_for_keys(star: Star) -> DataFrame:
    """The label of every sample key."""
    known = checkpointed(base.lab_labels(star))
    return shown(samples.labels_for(samples.sample_keys(known), known))


@query(
    q.with_(*base.EVT_LONG)
    + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, string_agg({q.cell('purchase')}, ',' ORDER BY step) AS series "
    + "FROM long GROUP BY patient_id, observation_date"
)
def feature_series(star: Star) -> DataFrame:
    """The series of one feature of each window."""
    series = samples.feature_series(base.event_windows(star), EVENT_IDS.index("purchase"))
    return shown(series.withColumn("series", F.array_join(F.transform("series", cell), ",")))


# --- flat samples ---------------------------------------------------------------------

ROUNDED = ", ".join(f"round(({n} - mu{i}) / sd{i} + {base.NUDGE}, 6) AS {n}" for i, n in zip(LAB_IDS, q.LAB))


@query(
    q.with_(*base.LAB_PERIODS, base._stats_sql("periods WHERE period_end < DATE '1999-01-01'", ""))
    + f"SELECT patient_id, {q.date_text('period_end')} AS period_end, {ROUNDED} FROM periods, stats WHERE period_end >= DATE '1999-01-01'"
)
def scale_flat(star: Star) -> DataFrame:
    """Flat columns standardised by the months before 1999."""
    periods = base.lab_periods(star).drop("period_index")
    early = F.col("period_end") < F.lit("1999-01-01").cast("date")
    scaler = balance.fit_vector_scaler(periods.where(early), LAB_FEATURES)
    return shown(balance.apply_vector_scaler(periods.where(~early), scaler, LAB_FEATURES), base.NUDGE)


def flat_samples(star: Star) -> DataFrame:
    """Labelled months with their lab means as columns."""
    months = base.lab_periods(star).drop("period_index").withColumnRenamed("period_end", "observation_date")
    return months.join(base.lab_labels(star), ["patient_id", "observation_date"])


FLAT = (
    *base.LAB_LABELS,
    "flat AS (SELECT l.patient_id, l.observation_date, label, " + ", ".join(f"p.{n}" for n in q.LAB)
    + " FROM labels_cte l JOIN periods p ON p.patient_id = l.patient_id AND p.period_end = l.observation_date)",
    "fills AS (SELECT " + ", ".join(f"coalesce(avg({n}), 0) AS m{i}" for i, n in zip(LAB_IDS, q.LAB)) + " FROM flat)",
    "filled AS (SELECT patient_id, observation_date, label, " + ", ".join(f"coalesce({n}, m{i}) AS {n}" for i, n in zip(LAB_IDS, q.LAB))
    + " FROM flat, fills)",
    *base._oversample_sql("filled", "most - rows_"),
    "resampled AS (SELECT f.*, copy FROM filled f JOIN copies USING (patient_id, observation_date, label))",
    base._stats_sql("resampled", ""),
)


@query(q.with_(*FLAT) + f"SELECT {base.COPY_COLUMNS}, {ROUNDED} FROM resampled, stats")
def prep_flat_train(star: Star) -> DataFrame:
    """Flat samples filled, balanced and standardised."""
    prepared, _, _ = balance.prepare_flat_train(checkpointed(flat_samples(star)), LAB_FEATURES, seed=base.SEED)
    return shown(prepared, base.NUDGE)


# --- features and models --------------------------------------------------------------

SELECTED = base.ORACLES["feature_select"]


@query(
    q.with_(*base.FEATURES, f"judged_features AS ({SELECTED})")
    + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, name, value FROM features "
    + "WHERE value IS NOT NULL AND name IN (SELECT name FROM judged_features WHERE relevant)"
)
def selected_features(star: Star) -> DataFrame:
    """The features that bear on the label, as the stored names select them at extraction."""
    table = checkpointed(base.rounded_features(star))
    names = tsfeatures.relevant_names(tsfeatures.select_relevant(tsfeatures.rank_sum_test(table)))
    wide = tsfeatures.wide_feature_table(table, names)
    cells = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names]
    if not cells:
        return shown(table.where("false").select("patient_id", "observation_date", "name", "value"))
    return shown(wide.select("patient_id", "observation_date", F.inline(F.array(*cells))).where(F.col("value").isNotNull()))


@query(
    q.with_(
        base.MULTI,
        "shares AS (SELECT truth, list_transform(scores, lambda s: s - list_min(scores) + 0.1) AS p FROM scored)",
    )
    + """SELECT round(-avg(ln(least(greatest(p[truth + 1] / list_sum(p), 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM shares"""
)
def eval_logloss_classes(star: Star) -> DataFrame:
    """Log loss of ten classes."""
    moved = F.transform("scores", lambda s: s - F.array_min("scores") + 0.1)
    whole = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
    predictions = base.vector_predictions(star).withColumn("_p", moved)
    return shown(evaluate.log_loss(predictions.withColumn("scores", F.transform("_p", lambda v: v / whole))))


@query(
    q.with_(*base.TRAIN_SIDE)
    + """SELECT label AS truth, count(DISTINCT (patient_id, observation_date)) AS n, true AS probabilities, true AS class_of_score
FROM sided WHERE split = 'test' GROUP BY label"""
)
def forest_facts(star: Star) -> DataFrame:
    """What must hold for the forest's predictions: one for each test sample, probabilities, and the class they mean."""
    train, test = base.raw_sides(star)
    prepared, scaler = balance.prepare_train(train, len(LAB_IDS), seed=base.SEED, copies=False)
    model = learn.fit_forest(checkpointed(learn.training_vectors(prepared)), trees=10, seed=base.SEED, max_depth=5)
    scored = learn.score_forest(model, balance.prepare_test(test, len(LAB_IDS), scaler=scaler))
    whole = F.abs(F.aggregate("scores", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9
    inside = F.forall("scores", lambda v: (v >= 0) & (v <= 1))
    return scored.groupBy("truth").agg(
        F.count("*").alias("n"), F.every(whole & inside).alias("probabilities"),
        F.every(F.col("scores")[F.col("predicted")] == F.array_max("scores")).alias("class_of_score"),
    )


# --- jobs -----------------------------------------------------------------------------

CATEGORIES = {"few": [1, 2], "some": [2, 3, 5, 7]}
CODES = {"a": ["Brand#13"], "b": ["Brand#4", "Brand#21"]}
HORIZONS = {"1y": 365, "2y": 730}


def grid(star: Star) -> dict[str, DataFrame]:
    cells = config_grid(CATEGORIES, CODES, HORIZONS, base.LAB_STEPS, base.GAP)
    return extract_grid(clinic(star), cells, scratch(star, "grid"), "some")


def _category_sql(name: str) -> tuple[str, ...]:
    ids = CATEGORIES[name]
    columns = [f'"{i}"' for i in ids]
    return (q.ANALYSES, q.grid("analyses", ids), q.periods("grid", columns, "month"))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS category, * FROM ("
        + q.with_(*_category_sql(name), q.own_windows("periods", [f'"{i}"' for i in CATEGORIES[name]], base.LAB_STEPS))
        + q.coded("long", [f'"{i}"' for i in CATEGORIES[name]]) + ")"
        for name in CATEGORIES
    )
)
def grid_windows(star: Star) -> DataFrame:
    """Windows of every category of an extraction grid, from one table of periods."""
    made = grid(star)
    parts = [coded(made[f"windows_{name}"]).select(F.lit(name).alias("category"), "patient_id", "observation_date", "matrix") for name in CATEGORIES]
    return parts[0].unionByName(parts[1])


@query(
    q.with_(
        *_category_sql("some"), "spine AS (SELECT patient_id, period_end AS observation_date FROM periods)", q.ADMISSIONS, q.DIAGNOSES, q.earliest(CODES),
    )
    + " UNION ALL ".join(
        f"""SELECT DISTINCT s.patient_id, {q.date_text('s.observation_date')} AS observation_date, '{d}' AS disease, {w} AS prediction_window_days,
{q.onset_case(f'earliest_{d}', base.GAP, str(w))} AS label FROM spine s JOIN earliest USING (patient_id) WHERE {q.onset_keep(f'earliest_{d}', base.GAP)}"""
        for d in CODES for w in HORIZONS.values()
    )
)
def grid_labels(star: Star) -> DataFrame:
    """Labels of all diseases and prediction windows of an extraction grid."""
    out = grid(star)["labels"]
    return shown(out.select("patient_id", "observation_date", "disease", "prediction_window_days", "label"))
