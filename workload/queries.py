"""Queries on the star-schema tables, each with its comparison SQL."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.functions.arrays import total
from onsetframe.functions.periods import UNITS, period_end
from onsetframe.operators import balance, demographics, discovery, evaluate, labels, latent, learn, relevance, samples, tsfeatures, windows
from onsetframe.operators.records import (
    cell_statistics,
    clean_events,
    grid_records,
    long_records,
    resample,
    select_features,
)
from onsetframe.plans.extraction import lab_periods as lab_periods_plan
from onsetframe.plans.extraction import labelled_windows as labelled_windows_plan
from onsetframe.plans.config import CohortConfig
from onsetframe.session import checkpointed, join_path, shared_folder
from onsetframe.schemas import TABLE_FILES
from onsetframe.sources.tables import ClinicalTables, quarantine, rename_columns
from onsetframe.sources.stages import read_records, write_records
from workload import sqltext as q
from workload.adapters import DISEASES, EVENT_IDS, LAB_FEATURES, LAB_IDS, POSITIVE, SIGNALS, Star
from workload.registry import ORACLES, QUERIES, query
from workload.shapes import cell, coded, shown, vector_text, with_matrix_text

GAP, WINDOW, SEED = 90, 365, 7
NUDGE = 1e-9
LAB_STEPS, EVENT_STEPS, HISTORY = 6, 14, 24
GRID_WINDOWS = [90, 365, 730, 1825]


# --- shared plans --------------------------------------------------------------------


def lab_periods(star: Star, unit: str = "month") -> DataFrame:
    return lab_periods_plan(star.analyses(), LAB_IDS, "h", unit)


def event_periods(star: Star, unit: str = "day") -> DataFrame:
    return lab_periods_plan(star.events(), EVENT_IDS, "h", unit)


def lab_windows(star: Star, steps: int = LAB_STEPS) -> DataFrame:
    return windows.own_date_windows(lab_periods(star), LAB_FEATURES, steps)


def event_windows(star: Star, steps: int = EVENT_STEPS) -> DataFrame:
    return windows.own_date_windows(event_periods(star), EVENT_IDS, steps)


def lab_spine(star: Star) -> DataFrame:
    return lab_periods(star).select("patient_id", F.col("period_end").alias("observation_date"))


def event_spine(star: Star) -> DataFrame:
    return event_periods(star).select("patient_id", F.col("period_end").alias("observation_date"))


def onset(star: Star, positive=None) -> DataFrame:
    return labels.earliest_positive(star.diagnoses(), star.admissions(), positive or POSITIVE)


def lab_labels(star: Star) -> DataFrame:
    return labels.label_onsets(lab_spine(star), onset(star), GAP, WINDOW)


def lab_samples(star: Star, steps: int = LAB_STEPS, split: tuple | None = None) -> DataFrame:
    """Labelled lab windows ``(keys, label, matrix)`` from the main job's plan."""
    config = CohortConfig(LAB_IDS, POSITIVE, "h", "month", steps, GAP, WINDOW)
    return labelled_windows_plan(star.analyses(), star.diagnoses(), star.admissions(), config, split)


def written_samples(star: Star) -> DataFrame:
    """The labelled windows with their side of the split as a written stage, for queries that
    use them several times."""
    return checkpointed(lab_samples(star, split=(0.2, SEED)))


LAB_GRID = (q.ANALYSES, q.grid("analyses", LAB_IDS))
LAB_PERIODS = (*LAB_GRID, q.periods("grid", q.LAB, "month"))
LAB_LONG = (*LAB_PERIODS, q.own_windows("periods", q.LAB, LAB_STEPS))
LAB_SPINE = "spine AS (SELECT patient_id, period_end AS observation_date FROM periods)"
ONSET = (q.ADMISSIONS, q.DIAGNOSES, q.earliest(POSITIVE))
LAB_LABELS = (*LAB_PERIODS, LAB_SPINE, *ONSET, q.labels("spine", GAP, WINDOW))
LAB_SAMPLES = (*LAB_LABELS, q.own_windows("periods", q.LAB, LAB_STEPS),
               "samples AS (SELECT * FROM long JOIN labels_cte USING (patient_id, observation_date))")
EVT_GRID = (q.EVENTS, q.grid("evts", EVENT_IDS))
EVT_PERIODS = (*EVT_GRID, q.periods("grid", q.EVT, "day"))
EVT_LONG = (*EVT_PERIODS, q.own_windows("periods", q.EVT, EVENT_STEPS))
EVT_SPINE = "spine AS (SELECT patient_id, period_end AS observation_date FROM periods)"


# --- main job ------------------------------------------------------------------------


@query(
    q.with_(*LAB_LABELS, q.own_windows("periods", q.LAB, HISTORY))
    + "SELECT patient_id, strftime(observation_date, '%Y-%m-%d') AS observation_date, label, "
    + f"md5({q.matrix_text(q.LAB)}) AS matrix FROM long JOIN labels_cte USING (patient_id, observation_date) "
    + "GROUP BY patient_id, observation_date, label"
)
def labelled_windows(star: Star) -> DataFrame:
    """24 months of history and the onset label within a year, for every labelled month."""
    return coded(lab_samples(star, HISTORY))


# --- sources -------------------------------------------------------------------------


@query("""SELECT l_orderkey AS admission_id, l_linenumber AS analysis_id, l_quantity AS analysis_value
FROM lineitem""")
def scan_project(star: Star) -> DataFrame:
    aliases = {"l_orderkey": "admission_id", "l_linenumber": "analysis_id", "l_quantity": "analysis_value"}
    return shown(rename_columns(star.read("lineitem"), aliases).select(*aliases.values()))


@query(
    q.with_(*EVT_GRID)
    + f"SELECT patient_id, {q.time_text('time_bin')} AS time_bin, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in q.EVT) + " FROM grid"
)
def records_roundtrip(star: Star) -> DataFrame:
    path = join_path(shared_folder(star.spark), "records", uuid.uuid4().hex)
    write_records(grid_records(clean_events(star.events(), EVENT_IDS), EVENT_IDS), path)
    return shown(read_records(star.spark, path))


LINES = """lines AS (SELECT o_custkey AS subject_id, o_orderkey AS itemid,
  CASE WHEN o_orderkey % 83 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00' END AS storetime,
  CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS valuenum,
  CASE WHEN o_orderkey % 89 = 0 THEN 'too,many' ELSE 'ok' END AS comments,
  o_orderkey % 83 = 0 OR o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 AS malformed FROM orders)"""


@query(
    q.with_(LINES)
    + """SELECT subject_id AS patient_id, CAST(itemid AS INTEGER) AS analysis_id, storetime AS analysis_time,
CAST(nullif(valuenum, '') AS DOUBLE) AS analysis_value, CAST(NULL AS VARCHAR) AS line FROM lines WHERE NOT malformed
UNION ALL SELECT -1, -1, NULL, NULL, subject_id || ',' || itemid || ',' || storetime || ',' || valuenum || ',' || comments
FROM lines WHERE malformed"""
)
def malformed_lines(star: Star) -> DataFrame:
    """Orders as delimited text with broken lines: the well-formed rows, and the lines that were set aside."""
    key = F.col("o_orderkey")
    fields = {
        "subject_id": F.col("o_custkey").cast("string"),
        "itemid": key.cast("string"),
        "storetime": F.when(key % 83 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 08:00:00")),
        "valuenum": F.when(key % 97 == 0, "n/a").when(key % 5 == 0, "").otherwise((key % 1000).cast("string")),
        "comments": F.when(key % 89 == 0, "too,many").otherwise("ok"),
    }
    lines = star.read("orders").select(F.concat_ws(",", *fields.values()).alias(",".join(fields)))
    root = join_path(shared_folder(star.spark), "lines", uuid.uuid4().hex)
    # one column under another separator, so that lines are written as they are
    lines.write.option("sep", "\u0001").csv(join_path(root, *TABLE_FILES["analyses"]), header=True)
    tables = ClinicalTables(star.spark, root)
    good = tables.set_aside("analyses", join_path(root, "quarantine"))
    rows = good.select("patient_id", "analysis_id", "analysis_time", "analysis_value", F.lit(None).cast("string").alias("line"))
    aside = quarantine(star.spark, join_path(root, "quarantine"))
    ids = [F.lit(-1).cast(rows.schema[c].dataType).alias(c) for c in ("patient_id", "analysis_id")]
    return shown(rows.unionByName(aside.select(*ids, "line"), allowMissingColumns=True))


# --- code discovery ------------------------------------------------------------------


@query(
    q.with_(q.DIAGNOSES, q.LOOKUP)
    + """SELECT l.diagnosis_code, l.long_title, count(d.diagnosis_code) AS occurrence_count
FROM diagnoses_lookup l JOIN diagnoses d USING (diagnosis_code)
WHERE (lower(long_title) LIKE '%b%' AND (lower(long_title) LIKE '%bolt%' OR lower(long_title) LIKE '%red%'
       OR lower(long_title) LIKE '%small%') AND NOT (lower(long_title) LIKE '%gear%'))
   OR lower(long_title) LIKE '%widget%'
GROUP BY 1, 2"""
)
def code_search_patterns(star: Star) -> DataFrame:
    return discovery.code_search(
        star.diagnoses_lookup(), star.diagnoses(),
        all_of=["%b%"], any_of=["%bolt%", "%red%", "%small%"], none_of=["%gear%"], or_any=["%WIDGET%"],
    )


@query(
    q.with_(q.DIAGNOSES, q.LOOKUP)
    + """SELECT l.diagnosis_code, l.long_title, count(d.diagnosis_code) AS occurrence_count
FROM diagnoses_lookup l JOIN diagnoses d USING (diagnosis_code)
WHERE lower(long_title) LIKE '%standard%' AND (lower(long_title) LIKE '%ring%' OR lower(long_title) LIKE '%bolt%')
GROUP BY 1, 2"""
)
def code_search_simple(star: Star) -> DataFrame:
    return discovery.code_search(
        star.diagnoses_lookup(), star.diagnoses(), all_of=["%standard%"], any_of=["%ring%", "%bolt%"]
    )


@query(
    q.with_(q.DIAGNOSES, q.LOOKUP, "codes AS (SELECT * FROM diagnoses_lookup WHERE lower(long_title) LIKE '%b%')")
    + """SELECT least(t1.long_title, t2.long_title) AS diagnosis_1, greatest(t1.long_title, t2.long_title) AS diagnosis_2,
       count(*) AS pair_occurrence_count
FROM diagnoses d1 JOIN codes t1 ON d1.diagnosis_code = t1.diagnosis_code
JOIN diagnoses d2 ON d1.admission_id = d2.admission_id
JOIN codes t2 ON d2.diagnosis_code = t2.diagnosis_code
WHERE d1.diagnosis_code <> d2.diagnosis_code GROUP BY 1, 2"""
)
def code_pair_cooccurrence(star: Star) -> DataFrame:
    condition = discovery.title_condition(F.col("long_title"), all_of=["%b%"])
    return discovery.pair_cooccurrence(star.diagnoses(), star.diagnoses_lookup(), condition)


@query(q.with_(q.DIAGNOSES) + "SELECT DISTINCT patient_id FROM diagnoses WHERE diagnosis_code IN ('Brand#13')")
def cohort_members(star: Star) -> DataFrame:
    return discovery.cohort(star.diagnoses(), POSITIVE)


@query(
    q.with_(q.DIAGNOSES, q.PATIENTS)
    + """SELECT * FROM patients WHERE patient_id NOT IN
(SELECT patient_id FROM diagnoses WHERE diagnosis_code IN ('Brand#4', 'Brand#21'))"""
)
def cohort_exclude(star: Star) -> DataFrame:
    return discovery.exclude_cohort(star.patients(), discovery.cohort(star.diagnoses(), DISEASES["b"]))


@query(
    q.with_(q.DIAGNOSES, q.PATIENTS)
    + """SELECT * FROM patients WHERE patient_id IN
(SELECT patient_id FROM diagnoses WHERE diagnosis_code IN ('Brand#4', 'Brand#21'))"""
)
def cohort_include(star: Star) -> DataFrame:
    return discovery.include_cohort(star.patients(), discovery.cohort(star.diagnoses(), DISEASES["b"]))


MOST_COMMON = """SELECT analysis_name, analysis_id, count(*) AS event_count,
  round((count(*) / (SELECT count(*) FROM evts)) * 100, 6) AS percentage
FROM evts JOIN event_names USING (analysis_id) GROUP BY analysis_id, analysis_name"""


@query(q.with_(q.EVENTS, q.EVENT_NAMES) + MOST_COMMON)
def most_common(star: Star) -> DataFrame:
    return shown(discovery.frequency(star.events(), star.event_names()))


@query(
    """SELECT l_partkey AS analysis_id, count(*) AS event_count FROM lineitem GROUP BY 1
ORDER BY event_count DESC, analysis_id LIMIT 26"""
)
def most_common_topk(star: Star) -> DataFrame:
    counts = star.read("lineitem").groupBy(F.col("l_partkey").alias("analysis_id")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return discovery.top_k(counts, "event_count", 26, "analysis_id")


TOP_N = """top AS (SELECT * FROM (
  SELECT itemid, category, event_count,
         CAST(row_number() OVER (PARTITION BY category ORDER BY itemid) AS INTEGER) AS place
  FROM categorized WHERE event_count > 30) WHERE place <= 20)"""


def _top(star: Star) -> DataFrame:
    return discovery.top_n_per_group(star.categorized(), "category", ["itemid"], 20, "event_count", 30)


@query(q.with_(q.CATEGORIZED, TOP_N) + "SELECT * FROM top")
def topn_per_category(star: Star) -> DataFrame:
    return _top(star)


@query(
    q.with_(q.CATEGORIZED)
    + """SELECT category, CAST(sum(event_count) AS BIGINT) AS event_count, max(event_count) AS max_count,
min(event_count) AS min_count, count(*) AS num_elements FROM categorized GROUP BY category"""
)
def category_profile(star: Star) -> DataFrame:
    return discovery.group_profile(star.categorized().drop("itemid"), "category", "event_count")


@query(
    q.with_(q.CATEGORIZED, TOP_N)
    + "SELECT category, string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY place) AS ids FROM top GROUP BY category"
)
def category_id_lists(star: Star) -> DataFrame:
    lists = discovery.group_id_lists(_top(star), "category", "itemid")
    return lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# --- records -------------------------------------------------------------------------


@query(
    q.with_(q.ANALYSES)
    + """SELECT patient_id, analysis_id, strftime(analysis_time, '%Y-%m-%d %H:%M:%S') AS analysis_time, analysis_value
FROM analyses WHERE analysis_id IN (1, 3, 5) AND analysis_time IS NOT NULL"""
)
def clean_events_(star: Star) -> DataFrame:
    return shown(clean_events(star.analyses(), [1, 3, 5]))


QUERIES["clean_events"] = QUERIES.pop("clean_events_")
ORACLES["clean_events"] = ORACLES.pop("clean_events_")


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(q.with_(*EVT_GRID) + f"SELECT patient_id, {q.time_text('time_bin')} AS time_bin, {_rounded(q.EVT)} FROM grid")
def hourly_pivot(star: Star) -> DataFrame:
    return shown(grid_records(clean_events(star.events(), EVENT_IDS), EVENT_IDS))


@query(
    q.with_(q.EVENTS, q.grid("evts", EVENT_IDS, unit="day"))
    + f"SELECT patient_id, {q.time_text('time_bin')} AS time_bin, {_rounded(q.EVT)} FROM grid"
)
def daily_pivot(star: Star) -> DataFrame:
    return shown(grid_records(clean_events(star.events(), EVENT_IDS), EVENT_IDS, "D"))


AGG_SQL = {
    "mean": "avg(analysis_value)",
    "min": "min(analysis_value)",
    "max": "max(analysis_value)",
    "sum": "sum(coalesce(analysis_value, 0))",
    "count": "CAST(count(analysis_value) AS DOUBLE)",
    "median": "quantile_cont(CAST(analysis_value AS DOUBLE), 0.5)",
    "std": "stddev_samp(analysis_value)",
    "first": "arg_min(analysis_value, analysis_time)",
    "last": "arg_max(analysis_value, analysis_time)",
    "size": "CAST(count(*) AS DOUBLE)",
    "nunique": "CAST(count(DISTINCT analysis_value) AS DOUBLE)",
    "var": "var_samp(analysis_value)",
    "sem": "stddev_samp(analysis_value) / sqrt(count(analysis_value))",
    # as a logarithm: products of many values have no fixed decimals
    "prod": "ln(1 + abs(product(coalesce(analysis_value, 1))))",
}


@query(
    q.with_(q.EVENTS)
    + "SELECT aggfunc, patient_id, strftime(time_bin, '%Y-%m-%d %H:%M:%S') AS time_bin, analysis_id, "
    + "round(analysis_value + 1e-9, 6) AS analysis_value FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS aggfunc, patient_id, date_trunc('day', analysis_time) AS time_bin, analysis_id,
  {e} AS analysis_value FROM evts GROUP BY ALL""" for n, e in AGG_SQL.items()
    )
    + ") WHERE analysis_value IS NOT NULL"
)
def pivot_aggfuncs(star: Star) -> DataFrame:
    """All aggregates of a cell from one scan."""
    cells = cell_statistics(clean_events(star.events(), EVENT_IDS), "D", list(AGG_SQL))
    cells = cells.withColumn("prod", F.log1p(F.abs("prod")))
    named = F.inline(F.array(*[F.struct(F.lit(n).alias("aggfunc"), F.col(n).alias("analysis_value")) for n in AGG_SQL]))
    rows = cells.select("patient_id", "time_bin", "analysis_id", named).where(F.col("analysis_value").isNotNull())
    return shown(rows.select("aggfunc", "patient_id", "time_bin", "analysis_id", "analysis_value"), NUDGE)


@query(
    q.with_(*EVT_GRID)
    + f"""SELECT patient_id, {q.time_text('time_bin')} AS time_bin, round("view", 6) AS "view",
CAST(NULL AS DOUBLE) AS "absent", round("click", 6) AS "click" FROM grid"""
)
def reindex_columns(star: Star) -> DataFrame:
    grid = grid_records(clean_events(star.events(), EVENT_IDS), EVENT_IDS)
    return shown(select_features(grid, ["view", "absent", "click"]))


@query(
    q.with_(q.EVENTS)
    + f"""SELECT patient_id, {q.time_text("date_trunc('hour', analysis_time)")} AS time_bin, analysis_id,
round(avg(analysis_value), 6) AS analysis_value FROM evts GROUP BY 1, 2, 3 HAVING avg(analysis_value) IS NOT NULL"""
)
def hourly_long(star: Star) -> DataFrame:
    return shown(long_records(clean_events(star.events())))


@query(
    "SELECT DISTINCT " + q.date_text("l_shipdate") + " AS day_, "
    + ", ".join(f"{q.date_text(q.period_end('l_shipdate', u))} AS {u}_end" for u in UNITS) + " FROM lineitem"
)
def period_ends(star: Star) -> DataFrame:
    days = star.read("lineitem").select("l_shipdate").distinct()
    return shown(
        days.select(F.to_date("l_shipdate").alias("day_"), *[period_end("l_shipdate", u).alias(f"{u}_end") for u in UNITS])
    )


QUERIES["period_end"] = QUERIES.pop("period_ends")
ORACLES["period_end"] = ORACLES.pop("period_ends")


@query(
    q.with_(*LAB_GRID, *[q.periods("grid", q.LAB, u, f"p_{u}") for u in UNITS])
    + " UNION ALL ".join(
        f"SELECT '{u}' AS unit, patient_id, {q.date_text('period_end')} AS period_end, {_rounded(q.LAB)} FROM p_{u}"
        for u in UNITS
    )
)
def period_resample(star: Star) -> DataFrame:
    grid = grid_records(clean_events(star.analyses(), LAB_IDS), LAB_IDS)
    out = None
    for unit in UNITS:
        part = resample(grid, LAB_FEATURES, unit).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return shown(out.select("unit", "patient_id", "period_end", *LAB_FEATURES))


# --- windows -------------------------------------------------------------------------

UNIT_STEPS = {"week": 12, "month": 24, "year": 3}


def _rolling(unit: str, steps: int) -> None:
    sql = q.with_(*LAB_GRID, q.periods("grid", q.LAB, unit), q.own_windows("periods", q.LAB, steps)) + q.coded(
        "long", q.LAB
    )
    query(sql, f"rolling_{unit}")(
        lambda star: coded(windows.own_date_windows(lab_periods(star, unit), LAB_FEATURES, steps))
    )


for _unit, _steps in UNIT_STEPS.items():
    _rolling(_unit, _steps)


@query(
    q.with_(*EVT_LONG)
    + "SELECT patient_id, strftime(observation_date, '%Y-%m-%d') AS observation_date, CAST(step AS INTEGER) AS step, "
    + f"strftime(observation_date + to_days(CAST(step - {EVENT_STEPS - 1} AS INTEGER)), '%Y-%m-%d') AS step_date, "
    + _rounded(q.EVT) + " FROM long"
)
def rolling_day(star: Star) -> DataFrame:
    return shown(windows.to_long(event_windows(star), EVENT_IDS, "day", EVENT_STEPS))


@query(
    q.with_(
        *LAB_PERIODS,
        "dates AS (SELECT DISTINCT o_custkey AS patient_id, o_orderdate AS observation_date FROM orders)",
        q.given_windows("periods", "dates", q.LAB, "month", LAB_STEPS, "long"),
    )
    + q.coded("long", q.LAB)
)
def rolling_given_dates(star: Star) -> DataFrame:
    dates = star.read("orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("observation_date")
    )
    cut = windows.given_date_windows(lab_periods(star), dates, LAB_FEATURES, "month", LAB_STEPS)
    return coded(cut.withColumn("observation_date", F.to_date("observation_date")))


SIGNAL_LONG = (
    *EVT_PERIODS, EVT_SPINE, q.SIGNAL_ROWS,
    q.periods("signals", q.SIG, "day", "signal_periods", "signal_time"),
    q.given_windows("signal_periods", "spine", q.SIG, "day", EVENT_STEPS, "signal_long"),
)


def signal_windows(star: Star) -> DataFrame:
    return windows.second_source_windows(
        star.signals(), event_spine(star), SIGNALS, "signal_time", "day", EVENT_STEPS
    )


@query(q.with_(*SIGNAL_LONG) + q.coded("signal_long", q.SIG))
def second_source_windows(star: Star) -> DataFrame:
    return coded(signal_windows(star))


# --- labels and demographics ---------------------------------------------------------


@query(
    q.with_(q.DIAGNOSES, q.ADMISSIONS)
    + f"""SELECT patient_id, admission_id, diagnosis_code, {q.time_text('discharge_time')} AS discharge_time
FROM diagnoses JOIN admissions USING (patient_id, admission_id)"""
)
def timed_diagnoses(star: Star) -> DataFrame:
    return shown(labels.timed_diagnoses(star.diagnoses(), star.admissions()))


@query(q.with_(*ONSET) + f"SELECT patient_id, {q.time_text('earliest')} AS earliest FROM earliest")
def earliest_positive(star: Star) -> DataFrame:
    return shown(onset(star))


LABEL_COLUMNS = f"patient_id, {q.date_text('observation_date')} AS observation_date, label"


@query(q.with_(*LAB_LABELS) + f"SELECT {LABEL_COLUMNS} FROM labels_cte")
def onset_labels(star: Star) -> DataFrame:
    return shown(lab_labels(star))


@query(
    q.with_(
        *ONSET,
        "dates AS (SELECT DISTINCT o_custkey AS patient_id, o_orderdate AS observation_date FROM orders)",
        q.labels("dates", 30, 180),
    )
    + f"SELECT {LABEL_COLUMNS} FROM labels_cte"
)
def onset_labels_dates_only(star: Star) -> DataFrame:
    dates = star.read("orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("observation_date")
    ).distinct()
    labelled = labels.label_onsets(dates, onset(star), 30, 180)
    return shown(labelled.withColumn("observation_date", F.to_date("observation_date")))


@query(
    q.with_(*LAB_PERIODS, LAB_SPINE, q.ADMISSIONS, q.DIAGNOSES, q.earliest(DISEASES))
    + " UNION ALL ".join(
        f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date, '{d}' AS disease,
CAST({w} AS INTEGER) AS prediction_window_days, {q.onset_case(f'earliest_{d}', GAP, str(w))} AS label
FROM spine JOIN earliest USING (patient_id) WHERE {q.onset_keep(f'earliest_{d}', GAP)}"""
        for d in DISEASES for w in GRID_WINDOWS
    )
)
def onset_labels_grid(star: Star) -> DataFrame:
    earliest = onset(star, DISEASES)
    return shown(labels.label_onset_grid(lab_spine(star), earliest, list(DISEASES), GRID_WINDOWS, GAP))


@query(
    q.with_(q.DIAGNOSES)
    + """SELECT count(*) FILTER (WHERE found) AS patients_found, count(*) FILTER (WHERE NOT found) AS patients_not_found
FROM (SELECT c_custkey IN (SELECT patient_id FROM diagnoses) AS found FROM customer)"""
)
def label_coverage(star: Star) -> DataFrame:
    return labels.label_coverage(star.patients(), star.diagnoses())


DEMOGRAPHICS = """demo AS (
  SELECT s.patient_id, observation_date, CAST(year(observation_date) - (anchor_year - age) AS INTEGER) AS age, gender
  FROM spine s LEFT JOIN patients USING (patient_id))"""


@query(
    q.with_(*LAB_PERIODS, LAB_SPINE, q.PATIENTS, DEMOGRAPHICS)
    + f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date, age, gender,
CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS gender_code FROM demo"""
)
def demographics_at_date(star: Star) -> DataFrame:
    at = demographics.demographics_at_dates(lab_spine(star), star.patients())
    return shown(at.withColumn("gender_code", demographics.gender_code(F.col("gender"))))


@query(
    q.with_(*LAB_PERIODS, LAB_SPINE, q.PATIENTS, DEMOGRAPHICS)
    + f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date,
CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS "gender_M", age FROM demo"""
)
def gender_onehot(star: Star) -> DataFrame:
    at = demographics.demographics_at_dates(lab_spine(star), star.patients())
    return shown(demographics.gender_onehot(at, ["F", "M"]))


# --- samples -------------------------------------------------------------------------


@query(
    q.with_(*LAB_LABELS)
    + f"SELECT DISTINCT patient_id, {q.date_text('observation_date')} AS observation_date FROM labels_cte"
)
def sample_keys(star: Star) -> DataFrame:
    return shown(samples.sample_keys(lab_labels(star)))


@query(
    q.with_(
        *LAB_PERIODS, LAB_SPINE, q.EVENTS,
        q.grid("evts", EVENT_IDS, "egrid"), q.periods("egrid", q.EVT, "day", "eperiods"),
        q.own_windows("eperiods", q.EVT, EVENT_STEPS, "elong"),
        "keys AS (SELECT * FROM spine UNION SELECT patient_id, period_end FROM eperiods)",
        "steps AS (SELECT unnest(range(14)) AS step)",
        "aligned AS (SELECT k.patient_id, k.observation_date, s.step, "
        + ", ".join(f"CASE WHEN h.patient_id IS NULL THEN 0 ELSE e.{n} END AS {n}" for n in q.EVT)
        + """ FROM keys k CROSS JOIN steps s
  LEFT JOIN (SELECT patient_id, period_end AS observation_date FROM eperiods) h USING (patient_id, observation_date)
  LEFT JOIN elong e ON e.patient_id = k.patient_id AND e.observation_date = k.observation_date AND e.step = s.step)""",
    )
    + q.coded("aligned", q.EVT)
)
def align_to_keys(star: Star) -> DataFrame:
    """Lab dates and event dates as keys; lab dates have no event window and get zeros."""
    keys = samples.sample_keys(lab_spine(star).unionByName(event_spine(star)))
    return coded(samples.align_to_keys(keys, event_windows(star), EVENT_STEPS, len(EVENT_IDS), 0.0))


@query(
    q.with_(*EVT_LONG)
    + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, "
    + f"{q.matrix_text(q.EVT)} AS matrix FROM long GROUP BY patient_id, observation_date"
)
def nest_matrix(star: Star) -> DataFrame:
    long = windows.to_long(event_windows(star), EVENT_IDS, "day", EVENT_STEPS)
    return shown(with_matrix_text(windows.to_matrix(long, EVENT_IDS)))


def _impute(strategy: str, fill) -> None:
    sql = q.with_(*LAB_LONG, q.imputed("long", q.LAB, fill, "filled")) + q.coded("filled", q.LAB)
    names = {"mean": "mean", "median": "median", "most_frequent": "mode"}
    query(sql, f"impute_window_{names[strategy]}")(
        lambda star: coded(samples.impute_windows(lab_windows(star), len(LAB_IDS), strategy))
    )


_impute("mean", lambda n: f"avg({n})")
_impute("median", lambda n: f"quantile_cont({n}, 0.5)")


def _mode_sql() -> str:
    parts = [
        f"""SELECT patient_id, observation_date, '{i}' AS f, {n} AS v, count(*) AS c FROM long
WHERE {n} IS NOT NULL GROUP BY patient_id, observation_date, {n}"""
        for i, n in zip(LAB_IDS, q.LAB)
    ]
    counted = "counted AS (" + " UNION ALL ".join(parts) + ")"
    best = """best AS (SELECT patient_id, observation_date, f, v FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, observation_date, f ORDER BY c DESC, v) AS r FROM counted)
  WHERE r = 1)"""
    wide = "modes AS (SELECT patient_id, observation_date, " + ", ".join(
        f"max(v) FILTER (WHERE f = '{i}') AS m{i}" for i in LAB_IDS
    ) + " FROM best GROUP BY 1, 2)"
    filled = "filled AS (SELECT patient_id, observation_date, step, " + ", ".join(
        f"coalesce(l.{n}, m{i}, 0) AS {n}" for i, n in zip(LAB_IDS, q.LAB)
    ) + " FROM long l LEFT JOIN modes USING (patient_id, observation_date))"
    return q.with_(*LAB_LONG, counted, best, wide, filled) + q.coded("filled", q.LAB)


query(_mode_sql(), "impute_window_mode")(
    lambda star: coded(samples.impute_windows(lab_windows(star), len(LAB_IDS), "most_frequent"))
)


@query(
    q.with_(
        *LAB_PERIODS,
        "fits AS (SELECT " + ", ".join(f"coalesce(avg({n}), 0) AS m{i}" for i, n in zip(LAB_IDS, q.LAB))
        + " FROM periods WHERE period_end < DATE '1999-01-01')",
    )
    + "SELECT patient_id, strftime(period_end, '%Y-%m-%d') AS period_end, "
    + ", ".join(f"round(coalesce({n}, m{i}), 6) AS {n}" for i, n in zip(LAB_IDS, q.LAB))
    + " FROM periods, fits WHERE period_end >= DATE '1999-01-01'"
)
def impute_fitted(star: Star) -> DataFrame:
    """Column means of the months before 1999 fill the later months."""
    periods = lab_periods(star).drop("period_index")
    early = F.col("period_end") < F.lit("1999-01-01").cast("date")
    fill = samples.fit_column_fill(periods.where(early), LAB_FEATURES)
    return shown(samples.apply_column_fill(periods.where(~early), fill, LAB_FEATURES))


def _split_sql(group: str) -> str:
    by = f"PARTITION BY {group} " if group else ""
    return f"""split AS (SELECT patient_id, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT patient_id, row_number() OVER ({by}ORDER BY md5('{SEED}|' || patient_id), patient_id) AS r,
         CAST(count(*) OVER ({by.strip()}) AS DOUBLE) AS n
  FROM (SELECT patient_id, max(label) AS c FROM labels_cte GROUP BY patient_id)))"""


@query(
    q.with_(*LAB_LABELS, _split_sql(""))
    + f"SELECT {LABEL_COLUMNS}, split FROM labels_cte JOIN split USING (patient_id)"
)
def split_by_patient(star: Star) -> DataFrame:
    return shown(samples.split_by_patient(lab_labels(star), 0.2, SEED))


@query(
    q.with_(*LAB_LABELS, _split_sql("c"))
    + f"SELECT {LABEL_COLUMNS}, split FROM labels_cte JOIN split USING (patient_id)"
)
def split_stratified(star: Star) -> DataFrame:
    return shown(samples.split_stratified(lab_labels(star), 0.2, SEED))


@query(
    q.with_(
        *EVT_PERIODS, EVT_SPINE, q.PATIENTS, DEMOGRAPHICS,
        "code AS (SELECT patient_id, observation_date, CAST(age AS DOUBLE) AS age, "
        "CASE gender WHEN 'F' THEN 0.0 WHEN 'M' THEN 1.0 END AS g, unnest(range(14)) AS step FROM demo)",
    )
    + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, "
    + f"{q.matrix_text(['age', 'g'])} AS matrix FROM code GROUP BY patient_id, observation_date"
)
def extend_timesteps(star: Star) -> DataFrame:
    static = demographics.demographics_matrix(
        demographics.demographics_at_dates(event_spine(star), star.patients())
    )
    return shown(with_matrix_text(samples.extend_timesteps(static, EVENT_STEPS)))


@query(
    q.with_(*EVT_LONG)
    + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, "
    + f"string_agg({q.row_text(q.EVT)}, ',' ORDER BY step) AS vector FROM long GROUP BY patient_id, observation_date"
)
def flatten_window(star: Star) -> DataFrame:
    return shown(samples.flatten_windows(event_windows(star)).withColumn("vector", vector_text()))


@query(
    q.with_(
        *SIGNAL_LONG, q.own_windows("periods", q.EVT, EVENT_STEPS),
        "joined AS (SELECT l.*, value, k FROM long l JOIN signal_long USING (patient_id, observation_date, step))",
    )
    + q.coded("joined", [*q.EVT, *q.SIG])
)
def combine_3d(star: Star) -> DataFrame:
    signals = resample(star.signals(), SIGNALS, "day", "signal_time")
    return coded(windows.merged_own_windows([(event_periods(star), EVENT_IDS), (signals, SIGNALS)], EVENT_STEPS))


@query(
    q.with_(*EVT_LONG, EVT_SPINE, q.PATIENTS, DEMOGRAPHICS)
    + f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date,
string_agg({q.row_text(q.EVT)}, ',' ORDER BY step) || ',' || {q.cell('max(age)')} || ',' ||
{q.cell("max(CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 END)")} AS vector
FROM long JOIN demo USING (patient_id, observation_date) GROUP BY patient_id, observation_date"""
)
def combine_mixed(star: Star) -> DataFrame:
    at = demographics.demographics_at_dates(event_spine(star), star.patients())
    static = samples.single_step(demographics.demographics_matrix(at))
    return shown(samples.combine_sources([event_windows(star), static]).withColumn("vector", vector_text()))


# --- scaling and balancing -----------------------------------------------------------

FILLED = q.imputed("long", q.LAB, lambda n: f"avg({n})", "filled")
FILLED_SAMPLES = (
    *LAB_LABELS, _split_sql(""), q.own_windows("periods", q.LAB, LAB_STEPS), FILLED,
    "sided AS (SELECT f.*, label, split FROM filled f JOIN labels_cte USING (patient_id, observation_date) "
    "JOIN split USING (patient_id))",
)


def sided_samples(star: Star) -> DataFrame:
    """Imputed, labelled lab windows with their side of the split."""
    return samples.impute_windows(written_samples(star), len(LAB_IDS))


def _stats_sql(source: str, key: str, name: str = "stats") -> str:
    cols = ", ".join(
        f"avg({n}) AS mu{i}, CASE WHEN stddev_pop({n}) = 0 THEN 1 ELSE stddev_pop({n}) END AS sd{i}"
        for i, n in zip(LAB_IDS, q.LAB)
    )
    return f"{name} AS (SELECT {key + ', ' if key else ''}{cols} FROM {source}{' GROUP BY ' + key if key else ''})"


SCALED = ", ".join(f"({n} - mu{i}) / sd{i} AS {n}" for i, n in zip(LAB_IDS, q.LAB))


def _scaled_output(samples_df: DataFrame, *extra: str) -> DataFrame:
    """Scaled windows summed per sample and rounded: sums of z values of one step order."""
    total = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(
        F.transform("matrix", lambda row, i: F.aggregate(row, F.lit(0.0), lambda a, v: a + v) * (i + 1)),
        F.lit(0.0), lambda a, v: a + v,
    )
    return samples_df.select(
        "patient_id", F.date_format("observation_date", "yyyy-MM-dd").alias("observation_date"), *extra,
        F.round(total, 4).alias("z_sum"), F.round(weighted, 4).alias("z_weighted"),
        F.round(F.element_at(F.element_at("matrix", -1), 1), 4).alias("z_last"),
    )


def _scaled_sql(source: str, extra: str) -> str:
    row = " + ".join(q.LAB)
    return f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date{extra},
round(sum({row}), 4) AS z_sum, round(sum(({row}) * (step + 1)), 4) AS z_weighted,
round(max({q.LAB[0]}) FILTER (WHERE step = {LAB_STEPS - 1}), 4) AS z_last
FROM {source} GROUP BY patient_id, observation_date{extra}"""


@query(
    q.with_(
        *FILLED_SAMPLES, "train AS (SELECT * FROM sided WHERE split = 'train')", _stats_sql("train", "step"),
        f"scaled AS (SELECT patient_id, observation_date, split, step, {SCALED} FROM sided JOIN stats USING (step))",
    )
    + _scaled_sql("scaled", ", split")
)
def scale_per_cell(star: Star) -> DataFrame:
    sided = sided_samples(star)
    scaler = balance.fit_cell_scaler(sided.where(F.col("split") == "train"), len(LAB_IDS))
    return _scaled_output(balance.apply_scaler(sided, scaler), "split")


@query(
    q.with_(
        *FILLED_SAMPLES, "train AS (SELECT * FROM sided WHERE split = 'train')", _stats_sql("train", ""),
        f"scaled AS (SELECT patient_id, observation_date, split, step, {SCALED} FROM sided, stats)",
    )
    + _scaled_sql("scaled", ", split")
)
def scale_per_feature(star: Star) -> DataFrame:
    sided = sided_samples(star)
    scaler = balance.fit_feature_scaler(sided.where(F.col("split") == "train"), len(LAB_IDS), LAB_STEPS)
    return _scaled_output(balance.apply_scaler(sided, scaler), "split")


def _oversample_sql(source: str, need: str) -> tuple[str, ...]:
    """CTEs ``copies(patient_id, observation_date, label, copy)`` for the samples of ``source``."""
    return (
        f"classes AS (SELECT label, count(*) AS rows_, max(count(*)) OVER () AS most FROM {source} GROUP BY label)",
        f"need AS (SELECT label, rows_, CAST({need} AS BIGINT) AS n FROM classes)",
        f"numbered AS (SELECT patient_id, observation_date, label, row_number() OVER (PARTITION BY label ORDER BY "
        f"md5('{SEED}|' || patient_id || '|' || strftime(observation_date, '%Y-%m-%d'))) - 1 AS number_ FROM {source})",
        "picks AS (SELECT label, rows_, unnest(range(n)) AS i FROM need WHERE n > 0)",
        f"times AS (SELECT label, {q.hash_number(f"'{SEED}|' || label || '|' || i")} % rows_ AS number_, "
        "count(*) AS times_ FROM picks GROUP BY 1, 2)",
        f"copies AS (SELECT patient_id, observation_date, label, 0 AS copy FROM {source} UNION ALL "
        "SELECT patient_id, observation_date, label, unnest(range(1, times_ + 1)) AS copy "
        "FROM numbered JOIN times USING (label, number_))",
    )


COPY_COLUMNS = f"patient_id, {q.date_text('observation_date')} AS observation_date, label, copy"


@query(
    q.with_(*LAB_LABELS, *_oversample_sql("labels_cte", "most - rows_")) + f"SELECT {COPY_COLUMNS} FROM copies"
)
def oversample_auto(star: Star) -> DataFrame:
    return shown(balance.oversample(checkpointed(lab_labels(star)), "auto", SEED))


@query(
    q.with_(
        *LAB_LABELS,
        *_oversample_sql("labels_cte", "CASE WHEN rows_ = most THEN 0 ELSE floor(0.5 * most) - rows_ END"),
    )
    + f"SELECT {COPY_COLUMNS} FROM copies"
)
def oversample_ratio(star: Star) -> DataFrame:
    return shown(balance.oversample(checkpointed(lab_labels(star)), 0.5, SEED))


TRAIN_SIDE = (
    *FILLED_SAMPLES, "train AS (SELECT * FROM sided WHERE split = 'train')",
    "train_keys AS (SELECT DISTINCT patient_id, observation_date, label FROM train)",
    *_oversample_sql("train_keys", "most - rows_"),
    "resampled AS (SELECT t.*, copy FROM train t JOIN copies USING (patient_id, observation_date, label))",
    _stats_sql("resampled", "step"),
)


def raw_sides(star: Star) -> tuple[DataFrame, DataFrame]:
    sided = written_samples(star)
    return sided.where(F.col("split") == "train"), sided.where(F.col("split") == "test")


@query(
    q.with_(
        *TRAIN_SIDE,
        f"scaled AS (SELECT patient_id, observation_date, label, copy, step, {SCALED} "
        "FROM resampled JOIN stats USING (step))",
    )
    + _scaled_sql("scaled", ", label, copy")
)
def prep_train(star: Star) -> DataFrame:
    train, _ = raw_sides(star)
    prepared, _scaler = balance.prepare_train(train, len(LAB_IDS), seed=SEED, copies=False)
    # copies of a sample are alike, so the sums are made before them
    made = _scaled_output(prepared, "label", balance.WEIGHT)
    order = [balance.COPY if c == balance.WEIGHT else c for c in made.columns]
    return balance.copy_samples(made).select(*order)


@query(
    q.with_(
        *TRAIN_SIDE,
        f"scaled AS (SELECT patient_id, observation_date, label, step, {SCALED} FROM sided JOIN stats USING (step) "
        "WHERE split = 'test')",
    )
    + _scaled_sql("scaled", ", label")
)
def prep_test(star: Star) -> DataFrame:
    train, test = raw_sides(star)
    _, scaler = balance.prepare_train(train, len(LAB_IDS), seed=SEED)
    return _scaled_output(balance.prepare_test(test, len(LAB_IDS), scaler=scaler), "label")


# --- window features -----------------------------------------------------------------


def feature_windows(star: Star) -> DataFrame:
    """Event windows of daily means at 6 digits."""
    rounded = {f: F.round(F.col(f) + NUDGE, 6) for f in EVENT_IDS}
    return windows.own_date_windows(event_periods(star).withColumns(rounded), EVENT_IDS, EVENT_STEPS)


# one row per sample, feature and present value, with neighbours
SERIES = (
    *EVT_LONG,
    "series AS (" + " UNION ALL ".join(
        f"SELECT patient_id, observation_date, '{i}' AS feature, step, round({n} + {NUDGE}, 6) AS v FROM long"
        for i, n in zip(EVENT_IDS, q.EVT)
    ) + ")",
    # summed in step order, so values that equal the mean do so in every engine
    """means AS (SELECT patient_id, observation_date, feature, count(v) AS n, count(*) AS steps,
  list_reduce(list(v ORDER BY step) FILTER (WHERE v IS NOT NULL), lambda a, b: a + b) / nullif(count(v), 0) AS m
  FROM series GROUP BY ALL)""",
    """present AS (SELECT s.*, m, n, steps,
  row_number() OVER w - 1 AS p, lag(v) OVER w AS v1, lag(v, 2) OVER w AS v2, lag(v, 3) OVER w AS v3
  FROM series s JOIN means USING (patient_id, observation_date, feature) WHERE v IS NOT NULL
  WINDOW w AS (PARTITION BY patient_id, observation_date, feature ORDER BY step))""",
)


def _stats_query(group: str, columns: dict[str, str], pre: tuple[str, ...] = (), source: str = "present") -> None:
    """Statistics as aggregates over present values; samples without a value are joined back."""
    shown_columns = ", ".join(
        f"CAST({e} AS INTEGER) AS {n}" if n in COUNTED else f"round({e} + {NUDGE}, 6) AS {n}" for n, e in columns.items()
    )
    sql = (
        q.with_(*SERIES, *pre)
        + f"SELECT patient_id, {q.date_text('observation_date')} AS observation_date, feature, {shown_columns} "
        + f"FROM means LEFT JOIN (SELECT * EXCLUDE (m, n, steps) FROM {source}) "
        + "USING (patient_id, observation_date, feature) "
        + "GROUP BY patient_id, observation_date, feature"
    )
    query(sql, f"ts_{group}")(
        lambda star: shown(tsfeatures.extract_features(feature_windows(star), EVENT_IDS, [group]), NUDGE)
    )


COUNTED = {
    "count", "zero_crossings", "mean_crossings", "count_above_mean", "count_below_mean",
    "longest_strike_above_mean", "longest_strike_below_mean",
}
M, N = "max(m)", "max(n)"
M2 = f"(sum((v - m) * (v - m)) / nullif({N}, 0))"

_stats_query("basic", {
    "count": "count(v)",
    "sum": "sum(v)",
    "mean": "avg(v)",
    "median": "quantile_cont(v, 0.5)",
    "min": "min(v)",
    "max": "max(v)",
    "range": "max(v) - min(v)",
    "stddev_pop": f"sqrt({M2})",
    "var_pop": M2,
    "rms": f"sqrt(sum(v * v) / nullif({N}, 0))",
    "abs_energy": "sum(v * v)",
    "skew": f"(sum((v - m) ** 3) / nullif({N}, 0)) / nullif({M2} * sqrt({M2}), 0)",
    "kurtosis": f"(sum((v - m) ** 4) / nullif({N}, 0)) / nullif({M2} * {M2}, 0) - 3",
    "q10": "quantile_cont(v, 0.1)",
    "q25": "quantile_cont(v, 0.25)",
    "q75": "quantile_cont(v, 0.75)",
    "q90": "quantile_cont(v, 0.9)",
    "missing_share": f"1.0 - {N} / max(steps)",
})

_stats_query("change", {
    "mean_abs_change": "avg(abs(v - v1))",
    "mean_change": "avg(v - v1)",
    "abs_sum_of_changes": "CASE WHEN count(v) > 0 THEN coalesce(sum(abs(v - v1)), 0) END",
    "cid": "CASE WHEN count(v) > 0 THEN sqrt(coalesce(sum((v - v1) * (v - v1)), 0)) END",
    "zero_crossings": "count(*) FILTER (WHERE v1 IS NOT NULL AND (v > 0) <> (v1 > 0))",
    "mean_crossings": "count(*) FILTER (WHERE v1 IS NOT NULL AND (v > m) <> (v1 > m))",
})

TOPS = "tops AS (SELECT p.*, max(v) OVER k AS hi, min(v) OVER k AS lo FROM present p " \
    "WINDOW k AS (PARTITION BY patient_id, observation_date, feature))"
_stats_query("location", {
    "first": "arg_min(v, p)",
    "last": "arg_max(v, p)",
    "first_location_max": f"min(p) FILTER (WHERE v = hi) / {N}",
    "last_location_max": f"(max(p) FILTER (WHERE v = hi) + 1) / {N}",
    "first_location_min": f"min(p) FILTER (WHERE v = lo) / {N}",
    "last_location_min": f"(max(p) FILTER (WHERE v = lo) + 1) / {N}",
    "count_above_mean": "count(*) FILTER (WHERE v > m)",
    "count_below_mean": "count(*) FILTER (WHERE v < m)",
}, (TOPS,), "tops")

MIDS = "mids AS (SELECT p.*, avg(step) OVER k AS ms FROM present p " \
    "WINDOW k AS (PARTITION BY patient_id, observation_date, feature))"
SXX, SXY, SYY = "sum((step - ms) * (step - ms))", "sum((step - ms) * (v - m))", "sum((v - m) * (v - m))"
_stats_query("trend", {
    "slope": f"{SXY} / nullif({SXX}, 0)",
    "intercept": f"{M} - {SXY} / nullif({SXX}, 0) * max(ms)",
    "r2": f"CASE WHEN {SXX} <> 0 THEN coalesce(({SXY} * {SXY}) / nullif({SXX} * {SYY}, 0), 1) END",
}, (MIDS,), "mids")

_stats_query("autocorr", {
    f"autocorr_{lag}": f"(sum((v - m) * (v{lag} - m)) / nullif(count(v{lag}), 0)) / nullif({M2}, 0)"
    for lag in (1, 2, 3)
})

RUNS = """runs AS (SELECT p.*, v > m AS above, v < m AS below,
  p - row_number() OVER (PARTITION BY patient_id, observation_date, feature, v > m ORDER BY p) AS ga,
  p - row_number() OVER (PARTITION BY patient_id, observation_date, feature, v < m ORDER BY p) AS gb FROM present p)"""
LENGTHS = """lengths AS (SELECT patient_id, observation_date, feature, ra, rb, m, n, steps FROM (
  SELECT *, CASE WHEN above THEN count(*) OVER (PARTITION BY patient_id, observation_date, feature, above, ga) END AS ra,
  CASE WHEN below THEN count(*) OVER (PARTITION BY patient_id, observation_date, feature, below, gb) END AS rb FROM runs))"""
_stats_query("strike", {
    "longest_strike_above_mean": "coalesce(max(ra), 0)",
    "longest_strike_below_mean": "coalesce(max(rb), 0)",
}, (RUNS, LENGTHS), "lengths")


def event_features(star: Star, stats: list[str]) -> DataFrame:
    """Named features of the event windows with the patient's gender code as label."""
    wide = tsfeatures.extract_features(feature_windows(star), EVENT_IDS, ["basic"])
    table = tsfeatures.long_feature_table(wide.select("patient_id", "observation_date", "feature", *stats), stats)
    at = star.patients().select("patient_id", demographics.gender_code(F.col("gender")).alias("label"))
    return table.join(at, "patient_id")


FEATURE_STATS = ["mean", "max", "stddev_pop"]
FEATURES = (
    *SERIES, q.PATIENTS,
    "stats AS (SELECT patient_id, observation_date, feature, avg(v) AS mean, max(v) AS max, "
    f"sqrt({M2}) AS stddev_pop FROM means LEFT JOIN (SELECT * EXCLUDE (m, n, steps) FROM present) "
    "USING (patient_id, observation_date, feature) GROUP BY ALL)",
    "features AS (" + " UNION ALL ".join(
        f"SELECT patient_id, observation_date, feature || '__{s}' AS name, round({s} + {NUDGE}, 6) AS value, "
        "CASE gender WHEN 'F' THEN 0 ELSE 1 END AS label FROM stats JOIN patients USING (patient_id)"
        for s in FEATURE_STATS
    ) + ")",
)


def rounded_features(star: Star) -> DataFrame:
    """Feature values at 6 digits, so equal values tie in every engine."""
    return event_features(star, FEATURE_STATS).withColumn("value", F.round(F.col("value") + NUDGE, 6))


@query(
    q.with_(*FEATURES, "medians AS (SELECT name, quantile_cont(value, 0.5) AS md FROM features GROUP BY name)")
    + f"""SELECT patient_id, {q.date_text('observation_date')} AS observation_date, name,
round(coalesce(value, md, 0) + {NUDGE}, 6) AS value FROM features JOIN medians USING (name)"""
)
def impute_feature_table(star: Star) -> DataFrame:
    return shown(tsfeatures.impute_feature_table(rounded_features(star).drop("label")), NUDGE)


@query(
    q.with_(
        *FEATURES,
        "ranked AS (SELECT name, label, value, rank() OVER (PARTITION BY name ORDER BY value) "
        "+ (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS r FROM features WHERE value IS NOT NULL)",
        "ties AS (SELECT name, sum(c * c * c - c) AS t FROM (SELECT name, CAST(count(*) AS DOUBLE) AS c FROM ranked "
        "GROUP BY name, value) GROUP BY name)",
        "sums AS (SELECT name, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS a, "
        "CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS b, sum(r) FILTER (WHERE label = 1) AS s "
        "FROM ranked GROUP BY name)",
        "us AS (SELECT name, a, b, s - a * (a + 1) / 2 AS u, "
        "a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1))) AS var FROM sums JOIN ties USING (name))",
    )
    + """SELECT name, CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n0, u,
round(sign(u - a * b / 2) * greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(var), 6) AS z FROM us"""
)
def feature_ranksum(star: Star) -> DataFrame:
    return shown(tsfeatures.rank_sum_test(rounded_features(star)))


# --- relevance -----------------------------------------------------------------------


def _normal_p(z: str) -> str:
    """Two-sided p-value of a normal statistic by the series of erf."""
    x = f"greatest(abs({z}) / sqrt(2), 1e-300)"
    term = f"exp(n * ln(4) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2) - {x} * {x})"
    return f"coalesce(CASE WHEN abs({z}) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda n: {term})) END, 1)"


def _relevant_sql(source: str, within: str = "") -> str:
    """Yekutieli's bound at 5%, for each class on its own."""
    by = f"PARTITION BY {within}" if within else ""
    return f"""placed AS (SELECT *, row_number() OVER ({by} ORDER BY p, name) AS k, count(*) OVER ({by}) AS m FROM {source}),
weighed AS (SELECT *, sum(1 / k) OVER ({by}) AS harmonic FROM placed),
judged AS (SELECT *, coalesce(k <= max(CASE WHEN p <= k / (m * harmonic) * 0.05 THEN k END) OVER ({by}), false) AS relevant FROM weighed)"""


RANKSUM = (
    *FEATURES,
    "ranked AS (SELECT name, label, value, rank() OVER (PARTITION BY name ORDER BY value) "
    "+ (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS r FROM features WHERE value IS NOT NULL)",
    "ties AS (SELECT name, sum(c * c * c - c) AS t FROM (SELECT name, CAST(count(*) AS DOUBLE) AS c FROM ranked "
    "GROUP BY name, value) GROUP BY name)",
)


@query(
    q.with_(
        *RANKSUM,
        "sums AS (SELECT name, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS a, "
        "CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS b, sum(r) FILTER (WHERE label = 1) AS s "
        "FROM ranked GROUP BY name)",
        "us AS (SELECT name, a, b, s - a * (a + 1) / 2 AS u, "
        "a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1))) AS var FROM sums JOIN ties USING (name))",
        "zs AS (SELECT name, a, b, u, sign(u - a * b / 2) * greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(var) AS z FROM us)",
        f"tests AS (SELECT *, {_normal_p('z')} AS p FROM zs)",
        _relevant_sql("tests"),
    )
    + "SELECT name, CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n0, u, round(z, 6) AS z, round(p, 6) AS p_value, relevant FROM judged"
)
def feature_select(star: Star) -> DataFrame:
    return shown(tsfeatures.select_relevant(tsfeatures.rank_sum_test(rounded_features(star))))


def aged_features(star: Star) -> DataFrame:
    """Feature values with the patient's age as a numeric label."""
    ages = star.patients().select("patient_id", F.col("age").cast("double").alias("label"))
    return rounded_features(star).drop("label").join(ages, "patient_id")


def age_classes(table: DataFrame) -> DataFrame:
    """The age in three classes."""
    return table.withColumn("label", F.floor(F.col("label") / 20).cast("int"))


def flags(table: DataFrame) -> DataFrame:
    """Binary features: the value is above 50."""
    return table.withColumn("value", F.when(F.col("value") > 50, 1.0).when(F.col("value").isNotNull(), 0.0))


def shown_tests(tests: DataFrame, *columns: str) -> DataFrame:
    return shown(tests.select("name", *columns, "kind", "statistic", "p_value", "relevant"))


AGED = (*FEATURES, "aged AS (SELECT name, value, CAST(age AS DOUBLE) AS y FROM features JOIN patients USING (patient_id) WHERE value IS NOT NULL)")


@query(
    q.with_(
        *AGED,
        # pairs by counts of equal samples, so the self join stays small
        "cells AS (SELECT name, value AS x, y, CAST(count(*) AS DOUBLE) AS c FROM aged GROUP BY ALL)",
        "scores AS (SELECT a.name, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM cells a JOIN cells b ON a.name = b.name GROUP BY a.name)",
        *[f"""{v}t AS (SELECT name, sum(t * (t - 1) / 2) AS {v}2, sum(t * (t - 1) * (t - 2)) AS {v}0, sum(t * (t - 1) * (2 * t + 5)) AS {v}1,
  sum(t) AS n FROM (SELECT name, {v}, sum(c) AS t FROM cells GROUP BY name, {v}) GROUP BY name)""" for v in "xy"],
        """facts AS (SELECT name, s, xt.n * (xt.n - 1) / 2 AS pairs, x2, y2,
  (xt.n * (xt.n - 1) * (2 * xt.n + 5) - x1 - y1) / 18 + 2 * x2 * y2 / (xt.n * (xt.n - 1)) + x0 * y0 / (9 * xt.n * (xt.n - 1) * (xt.n - 2)) AS var
  FROM scores JOIN xt USING (name) JOIN yt USING (name))""",
        f"tests AS (SELECT name, s / sqrt((pairs - x2) * (pairs - y2)) AS statistic, {_normal_p('s / sqrt(var)')} AS p FROM facts)",
        _relevant_sql("tests"),
    )
    + f"SELECT name, 'real' AS kind, round(statistic + {NUDGE}, 6) AS statistic, round(p, 6) AS p_value, relevant FROM judged"
)
def relevance_numeric(star: Star) -> DataFrame:
    """Kendall's rank correlation of every feature with the age."""
    found = relevance.relevance(aged_features(star), numeric=True)
    return shown_tests(found.withColumn("statistic", F.col("statistic") + NUDGE))


def _log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


@query(
    q.with_(
        *AGED,
        "flagged AS (SELECT name, CASE WHEN value > 50 THEN 1 ELSE 0 END AS x, y FROM aged)",
        "tops AS (SELECT name, CAST(sum(x) AS DOUBLE) AS n1, CAST(sum(1 - x) AS DOUBLE) AS n0 FROM flagged GROUP BY name HAVING sum(x) > 0 AND sum(1 - x) > 0)",
        "steps AS (SELECT DISTINCT name, y, sum(x) OVER w AS f1, sum(1 - x) OVER w AS f0 FROM flagged WINDOW w AS (PARTITION BY name ORDER BY y))",
        "gaps AS (SELECT name, max(abs(f1 / n1 - f0 / n0)) AS d, any_value(sqrt(n1 * n0 / (n1 + n0))) AS e FROM steps JOIN tops USING (name) GROUP BY name)",
        """age_tests AS (SELECT name, d AS statistic, CASE WHEN e * d < 0.2 THEN 1 ELSE greatest(least(
  list_sum(list_transform(range(1, 81), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * e * d * e * d))), 1), 0) END AS p FROM gaps)""",
        """coded AS (SELECT name, CASE WHEN value > 50 THEN 1 ELSE 0 END AS x, label AS y FROM features WHERE value IS NOT NULL),
cells AS (SELECT name, sum(x * y) AS a, sum((1 - x) * y) AS b, sum(x * (1 - y)) AS c, sum((1 - x) * (1 - y)) AS d FROM coded GROUP BY name
  HAVING sum(x) > 0 AND sum(1 - x) > 0)""",
        f"""tables AS (SELECT *, unnest(range(greatest(0, a + c - c - d)::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS k FROM cells),
chances AS (SELECT *, exp({_log_choose('a + b', 'k')} + {_log_choose('c + d', 'a + c - k')} - {_log_choose('a + b + c + d', 'a + c')}) AS chance,
  exp({_log_choose('a + b', 'a')} + {_log_choose('c + d', 'c')} - {_log_choose('a + b + c + d', 'a + c')}) AS seen FROM tables),
sex_tests AS (SELECT name, any_value(CASE WHEN b * c > 0 THEN a * d / (b * c) END) AS statistic, least(sum(CASE WHEN chance <= seen * (1 + 1e-7) THEN chance ELSE 0 END), 1) AS p
  FROM chances GROUP BY name)""",
        "tests AS (SELECT 'age' AS label, * FROM age_tests UNION ALL SELECT 'sex', * FROM sex_tests)",
        _relevant_sql("tests", "label"),
    )
    + f"SELECT name, label, 'binary' AS kind, round(statistic + {NUDGE}, 6) AS statistic, round(p, 6) AS p_value, relevant FROM judged"
)
def relevance_binary_feature(star: Star) -> DataFrame:
    """Binary features against the age (Kolmogorov-Smirnov) and the sex (Fisher)."""
    age = relevance.relevance(flags(aged_features(star)), numeric=True).withColumn("label", F.lit("age"))
    sex = relevance.relevance(flags(rounded_features(star))).withColumn("label", F.lit("sex"))
    found = age.drop("class").unionByName(sex.drop("class"))
    return shown_tests(found.withColumn("statistic", F.col("statistic") + NUDGE), "label")


@query(
    q.with_(
        *RANKSUM,
        """classed AS (SELECT name, CAST(floor(age / 20) AS INTEGER) AS "class", value, rank() OVER (PARTITION BY name ORDER BY value)
  + (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS r FROM features JOIN patients USING (patient_id) WHERE value IS NOT NULL)""",
        """sums AS (SELECT name, "class", CAST(count(*) AS DOUBLE) AS a, sum(r) AS s FROM classed GROUP BY ALL)""",
        "sizes AS (SELECT name, CAST(count(*) AS DOUBLE) AS n FROM classed GROUP BY name)",
        """us AS (SELECT name, "class", a, n - a AS b, s - a * (a + 1) / 2 AS u, a * (n - a) / 12 * (n + 1 - t / (n * (n - 1))) AS var
  FROM sums JOIN sizes USING (name) JOIN ties USING (name)
  WHERE (SELECT count(DISTINCT "class") FROM classed) > 2
    OR (SELECT count(DISTINCT "class") FROM classed) = 2 AND "class" = (SELECT max("class") FROM classed))""",
        """zs AS (SELECT name, "class", sign(u - a * b / 2) * greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(var) AS z FROM us)""",
        f"tests AS (SELECT *, {_normal_p('z')} AS p FROM zs)",
        _relevant_sql("tests", '"class"'),
    )
    + f"""SELECT name, "class", 'real' AS kind, round(z + {NUDGE}, 6) AS statistic, round(p, 6) AS p_value, relevant FROM judged"""
)
def relevance_classes(star: Star) -> DataFrame:
    """Every feature against three classes of age, each against the rest."""
    found = relevance.relevance(age_classes(aged_features(star)))
    return shown_tests(found.withColumn("statistic", F.col("statistic") + NUDGE), "class")


# --- models --------------------------------------------------------------------------


@query()
def latent_pca(star: Star) -> DataFrame:
    filled = checkpointed(sided_samples(star).drop("split"))
    coded_windows = latent.fit_latent(filled, 4).transform(filled)
    return shown(coded_windows.withColumn("vector", vector_text()))


@query(
    q.with_(*LAB_LABELS)
    + """SELECT CAST(unnest(range(4)) AS INTEGER) AS component, count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS share_kept
FROM labels_cte"""
)
def latent_facts(star: Star) -> DataFrame:
    """What must hold for the latent numbers of all samples: mean 0, no correlation, falling variance that is the stated share."""
    filled = checkpointed(sided_samples(star).drop("split"))
    model = latent.fit_latent(filled, 4)
    cells = model.transform(filled).select([F.col("vector")[i].alias(f"v{i}") for i in range(4)])
    whole = filled.select(F.posexplode(F.flatten("matrix")).alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).agg(F.sum("v").alias("whole"))
    facts = cells.agg(
        F.count("*").alias("n"), F.array(*[F.avg(f"v{i}") for i in range(4)]).alias("mean"), F.array(*[F.var_pop(f"v{i}") for i in range(4)]).alias("var"),
        F.array(*[F.greatest(F.lit(0.0), *[F.abs(F.corr(f"v{i}", f"v{j}")) for j in range(4) if j != i]) for i in range(4)]).alias("corr"),
    ).withColumn("whole", whole.scalar())
    shares = F.array(*[F.lit(float(s)) for s in model.shares])
    i = F.col("component")
    return facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("component")).select(
        "component", "n", (F.abs(F.col("mean")[i]) < 1e-6).alias("centred"), (F.col("corr")[i] < 1e-3).alias("uncorrelated"),
        ((i == 0) | (F.get("var", i - 1) >= F.col("var")[i])).alias("ordered"),
        (F.abs(F.col("var")[i] / F.col("whole") - shares[i]) < 1e-6).alias("share_kept"),
    )


@query()
def rf_train_score(star: Star) -> DataFrame:
    train, test = raw_sides(star)
    prepared, scaler = balance.prepare_train(train, len(LAB_IDS), seed=SEED, copies=False)
    # the fit gets every copy; a sample is kept once
    copies = balance.copy_samples(checkpointed(learn.training_vectors(prepared)))
    model = learn.fit_forest(copies, trees=10, seed=SEED, max_depth=5)
    scored = learn.score_forest(model, balance.prepare_test(test, len(LAB_IDS), scaler=scaler))
    return shown(learn.binary_score(scored).drop("split"))


# --- metrics -------------------------------------------------------------------------


def binary_predictions(star: Star) -> DataFrame:
    return star.read("labels").select(
        "doc_id", F.col("quality").alias("truth"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("score")
    )


def vector_predictions(star: Star) -> DataFrame:
    """Ten classes; the score of class c is the sum of all vector entries i with i mod 10 = c."""
    entries = F.col("embedding").cast("array<double>")

    def score(c: int):
        return total(F.filter(entries, lambda _, i: i % CLASSES == c))

    scores = F.array(*[score(c) for c in range(CLASSES)])
    return star.read("embeddings").select("vec_id", F.col("label").alias("truth"), scores.alias("scores"))


CLASSES = 10
BINARY = """bin AS (SELECT doc_id, quality AS truth, (doc_id * 37 % 100) / 100.0 AS score,
  CASE WHEN (doc_id * 37 % 100) / 100.0 > 0.5 THEN 1 ELSE 0 END AS predicted FROM labels)"""
MULTI = f"""scored AS (SELECT vec_id, label AS truth,
  [{', '.join(f"list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: (i - 1) % {CLASSES} = {c}))" for c in range(CLASSES))}]
  AS scores FROM embeddings),
multi AS (SELECT vec_id, truth, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS predicted FROM scored)"""


def _class_ctes(source: str) -> tuple[str, ...]:
    return (
        f"counts AS (SELECT truth, predicted, count(*) AS n FROM {source} GROUP BY 1, 2)",
        "cls AS (SELECT DISTINCT c FROM (SELECT truth AS c FROM counts UNION SELECT predicted FROM counts))",
        """per AS (SELECT c,
  coalesce((SELECT sum(n) FROM counts WHERE truth = c AND predicted = c), 0) AS tp,
  coalesce((SELECT sum(n) FROM counts WHERE truth = c), 0) AS support,
  coalesce((SELECT sum(n) FROM counts WHERE predicted = c), 0) AS chosen FROM cls)""",
        """pr AS (SELECT *, CASE WHEN chosen = 0 THEN 0 ELSE tp / chosen END AS precision_,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall_ FROM per)""",
        """f AS (SELECT *, CASE WHEN precision_ + recall_ = 0 THEN 0
  ELSE 2 * precision_ * recall_ / (precision_ + recall_) END AS f1 FROM pr)""",
    )


@query(q.with_(BINARY) + "SELECT doc_id, truth, round(score, 6) AS score, predicted FROM bin")
def eval_threshold(star: Star) -> DataFrame:
    return shown(evaluate.with_class(binary_predictions(star)))


@query(q.with_(MULTI) + "SELECT vec_id, truth, predicted FROM multi")
def eval_argmax(star: Star) -> DataFrame:
    return evaluate.with_class(vector_predictions(star)).drop("scores")


def binary_confusion(star: Star) -> DataFrame:
    return evaluate.confusion_counts(evaluate.with_class(binary_predictions(star)))


def vector_confusion(star: Star) -> DataFrame:
    return evaluate.confusion_counts(evaluate.with_class(vector_predictions(star)))


def _summary_sql(name: str) -> str:
    return f"""SELECT '{name}' AS task, round(sum(tp) / sum(support), 6) AS accuracy,
round(sum(support * f1) / sum(support), 6) AS f1_score,
round(sum(support * precision_) / sum(support), 6) AS precision,
round(sum(support * recall_) / sum(support), 6) AS recall,
round((sum(tp) * sum(support) - sum(support * chosen)) /
  (sqrt(CAST(sum(support) ** 2 - sum(chosen * chosen) AS DOUBLE)) * sqrt(CAST(sum(support) ** 2 - sum(support * support) AS DOUBLE))), 6) AS mcc,
round((sum(tp) / sum(support) - sum(support * chosen) / sum(support) ** 2) /
  (1 - sum(support * chosen) / sum(support) ** 2), 6) AS kappa FROM f"""


@query(
    "SELECT * FROM (" + q.with_(BINARY, *_class_ctes("bin")) + _summary_sql("binary") + ") UNION ALL SELECT * FROM ("
    + q.with_(MULTI, *_class_ctes("multi")) + _summary_sql("multi") + ")"
)
def eval_summary(star: Star) -> DataFrame:
    two = evaluate.summary(binary_confusion(star)).withColumn("task", F.lit("binary"))
    many = evaluate.summary(vector_confusion(star)).withColumn("task", F.lit("multi"))
    return shown(two.unionByName(many))


@query(
    q.with_(BINARY)
    + """SELECT round(-avg(ln(least(greatest(CASE WHEN truth = 1 THEN score ELSE 1 - score END,
2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM bin"""
)
def eval_logloss(star: Star) -> DataFrame:
    return shown(evaluate.log_loss(binary_predictions(star)))


@query(
    q.with_(MULTI, *_class_ctes("multi"))
    + """SELECT CAST(c AS VARCHAR) AS class, round(precision_, 6) AS precision, round(recall_, 6) AS recall,
round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision_), 6), round(avg(recall_), 6), round(avg(f1), 6),
CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(support * precision_) / sum(support), 6),
round(sum(support * recall_) / sum(support), 6), round(sum(support * f1) / sum(support), 6),
CAST(sum(support) AS BIGINT) FROM f"""
)
def eval_report(star: Star) -> DataFrame:
    return shown(evaluate.report(vector_confusion(star)))


@query(
    q.with_(MULTI, *_class_ctes("multi"))
    + """SELECT a.c AS truth, b.c AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n,
round(CASE WHEN a.support = 0 THEN 0 ELSE coalesce(n, 0) / a.support END, 6) AS share
FROM per a CROSS JOIN per b LEFT JOIN counts ON counts.truth = a.c AND counts.predicted = b.c"""
)
def eval_confusion(star: Star) -> DataFrame:
    return shown(evaluate.confusion_matrix(vector_confusion(star)))


@query(
    q.with_(BINARY)
    + """SELECT round((count(*) FILTER (WHERE truth = 1 AND predicted = 1) / count(*) FILTER (WHERE truth = 1)
+ count(*) FILTER (WHERE truth = 0 AND predicted = 0) / count(*) FILTER (WHERE truth = 0)) / 2, 6) AS roc_auc FROM bin"""
)
def eval_auc_classes(star: Star) -> DataFrame:
    return shown(evaluate.auc_of_classes(binary_confusion(star)))


@query(
    q.with_(
        BINARY,
        "ranked AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM bin)",
        "s AS (SELECT CAST(count(*) FILTER (WHERE truth = 1) AS DOUBLE) AS a, "
        "CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE) AS b, sum(r) FILTER (WHERE truth = 1) AS r FROM ranked)",
    )
    + "SELECT round((r - a * (a + 1) / 2) / (a * b), 6) AS roc_auc FROM s"
)
def eval_auc_scores(star: Star) -> DataFrame:
    return shown(evaluate.auc_of_scores(binary_predictions(star)))


from workload import job_queries  # noqa: E402, F401  registers the queries on written inputs and jobs
