"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from workload.adapters import EVENT_IDS, LAB_IDS, SIGNALS

LAB = [f'"{i}"' for i in LAB_IDS]
EVT = [f'"{i}"' for i in EVENT_IDS]
SIG = [f'"{i}"' for i in SIGNALS]

ANALYSES = """analyses AS (
  SELECT o_custkey AS patient_id, l_linenumber AS analysis_id, l_shipdate AS analysis_time,
         CASE WHEN l_quantity % 7 <> 0 THEN l_quantity END AS analysis_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EVENTS = """evts AS (
  SELECT user_id AS patient_id, event_type AS analysis_id, ts AS analysis_time,
         CASE WHEN event_id % 7 <> 0 THEN value END AS analysis_value
  FROM events)"""

SIGNAL_ROWS = """signals AS (
  SELECT user_id AS patient_id, ts AS signal_time, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

ADMISSIONS = """admissions AS (
  SELECT o_orderkey AS admission_id, o_custkey AS patient_id, o_orderdate AS discharge_time FROM orders)"""

DIAGNOSES = """diagnoses AS (
  SELECT o_custkey AS patient_id, l_orderkey AS admission_id, p_brand AS diagnosis_code
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

LOOKUP = """diagnoses_lookup AS (
  SELECT p_brand AS diagnosis_code, min(p_name) || ' ' || max(p_name) || ' ' || max(p_type) AS long_title
  FROM part GROUP BY p_brand)"""

PATIENTS = """patients AS (
  SELECT c_custkey AS patient_id, CAST(20 + c_custkey % 60 AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 1995 AS anchor_year
  FROM customer)"""

EVENT_NAMES = """event_names AS (
  SELECT DISTINCT event_type AS analysis_id, upper(event_type) AS analysis_name
  FROM events WHERE event_type <> 'signup')"""

CATEGORIZED = """categorized AS (
  SELECT p_partkey AS itemid, p_type AS category, event_count
  FROM (SELECT l_partkey, count(*) AS event_count FROM lineitem GROUP BY l_partkey)
  JOIN part ON l_partkey = p_partkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def date_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def time_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def period_end(c: str, unit: str) -> str:
    return {
        "day": f"CAST({c} AS DATE)",
        "week": f"CAST(date_trunc('week', {c}) + INTERVAL 6 DAY AS DATE)",
        "month": f"CAST(last_day({c}) AS DATE)",
        "year": f"make_date(CAST(year({c}) AS INTEGER), 12, 31)",
    }[unit]


def period_index(c: str, unit: str) -> str:
    """Index of a period end."""
    return {
        "day": f"date_diff('day', DATE '1970-01-01', {c})",
        "week": f"CAST((date_diff('day', DATE '1970-01-01', {c}) + 3) / 7 AS BIGINT)",
        "month": f"(year({c}) * 12 + month({c}))",
        "year": f"year({c})",
    }[unit]


def any_value(columns: list[str]) -> str:
    return f"coalesce({', '.join(columns)}) IS NOT NULL"


def grid(source: str, ids: list, name: str = "grid", unit: str = "hour", agg: str = "avg") -> str:
    def cell(i) -> str:
        lit = f"'{i}'" if isinstance(i, str) else str(i)
        return f'{agg}(analysis_value) FILTER (WHERE analysis_id = {lit}) AS "{i}"'

    cells = ", ".join(cell(i) for i in ids)
    names = [f'"{i}"' for i in ids]
    return f"""{name} AS (
  SELECT * FROM (
    SELECT patient_id, date_trunc('{unit}', analysis_time) AS time_bin, {cells}
    FROM {source} GROUP BY 1, 2) WHERE {any_value(names)})"""


def periods(source: str, names: list[str], unit: str, name: str = "periods", time: str = "time_bin") -> str:
    means = ", ".join(f"avg({n}) AS {n}" for n in names)
    return f"""{name} AS (
  SELECT *, {period_index('period_end', unit)} AS i FROM (
    SELECT patient_id, {period_end(time, unit)} AS period_end, {means}
    FROM {source} GROUP BY 1, 2) WHERE {any_value(names)})"""


def own_windows(source: str, names: list[str], steps: int, name: str = "long") -> str:
    cols = ", ".join(f"b.{n}" for n in names)
    return f"""{name} AS (
  SELECT a.patient_id, a.period_end AS observation_date, s.step, {cols}
  FROM {source} a CROSS JOIN (SELECT unnest(range({steps})) AS step) s
  LEFT JOIN {source} b ON b.patient_id = a.patient_id AND b.i = a.i - {steps - 1} + s.step)"""


def given_windows(source: str, spine: str, names: list[str], unit: str, steps: int, name: str) -> str:
    cols = ", ".join(f"b.{n}" for n in names)
    end = period_end("observation_date", unit)
    return f"""{name} AS (
  SELECT a.patient_id, a.observation_date, s.step, {cols}
  FROM (SELECT DISTINCT patient_id, observation_date, {period_index(end, unit)} AS i FROM {spine}
        WHERE patient_id IN (SELECT patient_id FROM {source})) a
  CROSS JOIN (SELECT unnest(range({steps})) AS step) s
  LEFT JOIN {source} b ON b.patient_id = a.patient_id AND b.i = a.i - {steps - 1} + s.step)"""


def cell(c: str) -> str:
    return f"coalesce(CAST(CAST(round(({c}) * 1000000) AS BIGINT) AS VARCHAR), '_')"


def row_text(names: list[str]) -> str:
    return " || ',' || ".join(cell(n) for n in names)


def matrix_text(names: list[str]) -> str:
    return f"string_agg({row_text(names)}, ';' ORDER BY step)"


def coded(source: str, names: list[str], extra: str = "", keys: str = "patient_id, observation_date") -> str:
    """Select samples with the md5 digest of the matrix text; ``extra`` columns start with a comma."""
    shown = keys.replace("observation_date", f"{date_text('observation_date')} AS observation_date")
    return (
        f"SELECT {shown}{extra}, md5({matrix_text(names)}) AS matrix FROM {source} "
        f"GROUP BY {keys}{extra}"
    )


def earliest(positive: dict[str, list[str]] | list[str], name: str = "earliest") -> str:
    lists = positive if isinstance(positive, dict) else {"": positive}

    def column(n: str, codes: list[str]) -> str:
        inside = ", ".join(f"'{c}'" for c in codes)
        label = f"earliest_{n}" if n else "earliest"
        return f"min(CASE WHEN diagnosis_code IN ({inside}) THEN discharge_time END) AS {label}"

    cols = ", ".join(column(n, c) for n, c in lists.items())
    return f"""{name} AS (
  SELECT patient_id, {cols}
  FROM diagnoses LEFT JOIN admissions USING (patient_id, admission_id) GROUP BY patient_id)"""


def onset_case(e: str, gap: int, window: str) -> str:
    return (
        f"CASE WHEN {e} IS NOT NULL AND {e} <= observation_date + to_days({gap}) + to_days({window}) "
        "THEN 1 ELSE 0 END"
    )


def onset_keep(e: str, gap: int) -> str:
    return f"({e} IS NULL OR observation_date + to_days({gap}) <= {e})"


def labels(spine: str, gap: int, window: int, name: str = "labels_cte") -> str:
    return f"""{name} AS (
  SELECT DISTINCT s.patient_id, s.observation_date, {onset_case('earliest', gap, str(window))} AS label
  FROM {spine} s JOIN earliest USING (patient_id) WHERE {onset_keep('earliest', gap)})"""


def imputed(source: str, names: list[str], fill, name: str) -> str:
    """``fill(n)`` is an expression over all rows of one window."""
    cols = ", ".join(f"coalesce({n}, {fill(n)} OVER w, 0) AS {n}" for n in names)
    return f"""{name} AS (
  SELECT patient_id, observation_date, step, {cols} FROM {source}
  WINDOW w AS (PARTITION BY patient_id, observation_date))"""


def hash_number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
