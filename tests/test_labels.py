import pytest

from onsetframe.operators import labels as lb

CASES = {
    "full": (
        [(1, "2020-01-01"), (1, "2021-01-01"), (1, "2021-01-04"), (1, "2021-03-01"), (2, "2021-01-01"), (2, "2022-01-01")],
        [(1, 100, "D1"), (1, 101, "D3"), (2, 200, "D3")],
        [(1, 100, "2021-01-05"), (1, 101, "2021-02-05"), (2, 200, "2021-01-15")],
        2, 10, {(1, "2020-01-01"): 0, (1, "2021-01-01"): 1, (2, "2021-01-01"): 0, (2, "2022-01-01"): 0},
    ),
    "no positive": (
        [(1, "2021-01-01"), (1, "2021-02-01"), (2, "2021-01-01")],
        [(1, 300, "D3"), (2, 400, "D4")],
        [(1, 300, "2021-01-05"), (2, 400, "2021-02-05")],
        1, 10, {(1, "2021-01-01"): 0, (1, "2021-02-01"): 0, (2, "2021-01-01"): 0},
    ),
    "missing patient": (
        [(1, "2021-01-01"), (1, "2021-02-01"), (2, "2021-01-01")],
        [(1, 100, "D1")], [(1, 100, "2021-01-05")], 1, 10, {(1, "2021-01-01"): 1},
    ),
    "both ends count": (
        [(1, "2021-01-03"), (1, "2021-01-04"), (1, "2020-12-24"), (1, "2020-12-23")],
        [(1, 100, "D1")], [(1, 100, "2021-01-05")], 2, 10,
        {(1, "2021-01-03"): 1, (1, "2020-12-24"): 1, (1, "2020-12-23"): 0},
    ),
    "bad discharge time": (
        [(1, "2021-01-01"), (2, "2021-01-01")],
        [(1, 100, "D1"), (2, 200, "D1")], [(1, 100, "never"), (3, 200, "2021-01-05")], 1, 10,
        {(1, "2021-01-01"): 0, (2, "2021-01-01"): 0},
    ),
}


def tables(spark, t, case):
    spine, diagnoses, admissions, gap, window, want = CASES[case]
    return (
        spark.createDataFrame([(p, t(d)) for p, d in spine], "patient_id long, observation_date timestamp_ntz"),
        spark.createDataFrame(diagnoses, "patient_id long, admission_id long, diagnosis_code string"),
        spark.createDataFrame(admissions, "patient_id long, admission_id long, discharge_time string"),
        gap, window, want,
    )


@pytest.mark.parametrize("case", CASES)
def test_labels(spark, t, case):
    spine, diagnoses, admissions, gap, window, want = tables(spark, t, case)
    earliest = lb.earliest_positive(diagnoses, admissions, ["D1", "D2"])
    got = lb.label_onsets(spine, earliest, gap, window).collect()
    assert {(r.patient_id, str(r.observation_date.date())): r.label for r in got} == want
    marked = lb.mark_onsets(spine, earliest, gap, window).collect()
    assert len(marked) == spine.count()
    assert {(r.patient_id, str(r.observation_date.date())): r.label for r in marked if r.label is not None} == want


def test_grid_equals_single_runs(spark, t, rows):
    spine, diagnoses, admissions, gap, _, _ = tables(spark, t, "full")
    diseases = {"a": ["D1"], "b": ["D3"]}
    earliest = lb.earliest_positive(diagnoses, admissions, diseases)
    grid = lb.label_onset_grid(spine, earliest, ["a", "b"], [5, 50], gap)
    for disease, codes in diseases.items():
        for window in (5, 50):
            single = lb.label_onsets(spine, lb.earliest_positive(diagnoses, admissions, codes), gap, window)
            part = grid.where((grid.disease == disease) & (grid.prediction_window_days == window))
            assert rows(part, "patient_id", "observation_date", "label") == rows(single)


def test_coverage_and_timed(spark, t):
    spine, diagnoses, admissions, *_ = tables(spark, t, "missing patient")
    assert tuple(lb.label_coverage(spine, diagnoses).first()) == (1, 1)
    timed = lb.timed_diagnoses(diagnoses, admissions).collect()
    assert [(r.diagnosis_code, str(r.discharge_time.date())) for r in timed] == [("D1", "2021-01-05")]
