from itertools import permutations

import pytest
from pyspark.sql import functions as F

from onsetframe.operators import discovery as dc


@pytest.fixture
def tables(spark):
    diagnoses = [(1, 10, "a"), (1, 10, "b"), (1, 10, "b"), (1, 10, "c"), (2, 20, "a"), (2, 20, "b"), (3, 30, "z"),
                 (3, 30, "a"), (4, 40, "a"), (4, 40, "d")]
    lookup = [("a", "Kidney disease, stage 4"), ("b", "KIDNEY DISEASE, unspecified"), ("c", "End stage renal disease"),
              ("d", "Kidney disease, stage 4"), ("e", "Kidney disease, stage 5"), ("z", "Other")]
    return (
        spark.createDataFrame(diagnoses, "patient_id long, admission_id long, diagnosis_code string"),
        spark.createDataFrame(lookup, "diagnosis_code string, long_title string"),
        diagnoses, dict(lookup),
    )


def test_code_search(tables):
    diagnoses, lookup, *_ = tables
    out = dc.code_search(
        lookup, diagnoses, all_of=["%kidney disease%"], any_of=["%stage 4%", "%stage 5%", "%unspec%"],
        none_of=["%unspecified%"], or_any=["%end stage renal disease%"],
    ).collect()
    assert [(r.diagnosis_code, r.occurrence_count) for r in out] == [("a", 4), ("c", 1), ("d", 1)]


def test_pairs(tables):
    diagnoses, lookup, raw, titles = tables
    condition = F.lower("long_title").like("%disease%")
    want = {}
    for (_, h1, c1), (_, h2, c2) in permutations(raw, 2):
        if h1 == h2 and c1 != c2 and all("disease" in titles[c].lower() for c in (c1, c2)):
            key = tuple(sorted((titles[c1], titles[c2])))
            want[key] = want.get(key, 0) + 1
    got = {(r.diagnosis_1, r.diagnosis_2): r.pair_occurrence_count for r in dc.pair_cooccurrence(diagnoses, lookup, condition).collect()}
    assert got == want
    half = {(r.diagnosis_1, r.diagnosis_2): r.pair_occurrence_count
            for r in dc.pair_cooccurrence(diagnoses, lookup, condition, distinct_pairs=True).collect()}
    assert {k: 2 * v for k, v in half.items()} == want


def test_cohorts(tables):
    diagnoses, *_ = tables
    members = dc.cohort(diagnoses, ["b", "c"])
    assert sorted(r[0] for r in members.collect()) == [1, 2]
    people = diagnoses.select("patient_id").distinct()
    assert sorted(r[0] for r in dc.exclude_cohort(people, members).collect()) == [3, 4]
    assert sorted(r[0] for r in dc.include_cohort(people, members).collect()) == [1, 2]


def test_frequency_counts_unnamed_rows(spark):
    events = spark.createDataFrame([(1,), (1,), (2,), (3,)], "analysis_id int")
    lookup = spark.createDataFrame([(1, "x"), (2, "y")], "analysis_id int, analysis_name string")
    out = [tuple(r) for r in dc.frequency(events, lookup).collect()]
    assert out == [("x", 1, 2, 50.0), ("y", 2, 1, 25.0)]


def test_categories(spark):
    raw = [(i, "c" if i % 2 else "d", 10 * i) for i in range(1, 11)]
    df = spark.createDataFrame(raw, "itemid int, category string, event_count int")
    top = dc.top_n_per_group(df, "category", ["itemid"], 2, "event_count", 20)
    assert {r.category: r.ids for r in dc.group_id_lists(top, "category", "itemid").collect()} == {"c": [3, 5], "d": [4, 6]}
    profile = [tuple(r) for r in dc.group_profile(df, "category", "event_count").collect()]
    assert profile == [("d", 300, 100, 20, 5), ("c", 250, 90, 10, 5)]
    assert [r.itemid for r in dc.top_k(df, "event_count", 3, "itemid").collect()] == [10, 9, 8]


def test_one_admission_with_thousands_of_codes(spark):
    """No row holds a whole basket, and every pair of codes is met once."""
    size, small = 5000, 3
    diagnoses = spark.range(size).select(F.lit(1).alias("admission_id"), F.format_string("c%05d", "id").alias("diagnosis_code"))
    diagnoses = diagnoses.unionByName(diagnoses.where("diagnosis_code < 'c00003'").withColumn("admission_id", F.lit(2)))
    counted = diagnoses.groupBy("admission_id", "diagnosis_code").agg(F.count("*").alias("n"))
    tiles = dc.code_tiles(counted).cache()
    held = tiles.select((F.size("one") + F.coalesce(F.size("other"), F.lit(0))).alias("n"), "other", F.size("one").alias("a"), F.size("other").alias("b"))
    assert held.agg(F.max("n")).first()[0] < 4 * dc.BLOCK_CODES < size
    met = held.select(F.coalesce(F.col("a") * F.col("b"), F.col("a") * (F.col("a") - 1) / 2).alias("p")).agg(F.sum("p")).first()[0]
    assert met == size * (size - 1) / 2 + small * (small - 1) / 2
    lookup = spark.range(size).select(F.format_string("c%05d", "id").alias("diagnosis_code"), F.format_string("title %d", F.col("id") % 4).alias("long_title"))
    out = {(r.diagnosis_1, r.diagnosis_2): r.pair_occurrence_count for r in dc.pair_cooccurrence(diagnoses, lookup, F.lit(True)).collect()}
    each = size // 4
    assert out["title 0", "title 1"] == 2 * (each * each + 1) and out["title 3", "title 3"] == each * (each - 1)


def test_blocks_of_one_code_and_titles_twice(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CODES", 1)
    raw = [(h, c) for h in (1, 2) for c in "abcdefg"] + [(1, "a"), (1, "a"), (3, "b"), (None, "a"), (None, "b"), (4, None)]
    titles = [(c, f"t{i % 3}") for i, c in enumerate("abcdef")] + [("a", "other")]
    diagnoses = spark.createDataFrame(raw, "admission_id int, diagnosis_code string")
    lookup = spark.createDataFrame(titles, "diagnosis_code string, long_title string")
    want = {}
    for (h1, c1), (h2, c2) in permutations(raw, 2):
        if h1 is not None and h1 == h2 and c1 != c2:
            for x in [t for c, t in titles if c == c1]:
                for y in [t for c, t in titles if c == c2]:
                    want[tuple(sorted((x, y)))] = want.get(tuple(sorted((x, y))), 0) + 1
    got = {(r.diagnosis_1, r.diagnosis_2): r.pair_occurrence_count for r in dc.pair_cooccurrence(diagnoses, lookup, F.lit(True)).collect()}
    assert got == want


def test_counts_and_baskets_are_stages_of_their_own(spark):
    """Also where the diagnoses already lie by admission, as after a join."""
    rows = [(a, f"c{c}") for a in range(6) for c in range(1 + a % 3)]
    admissions = spark.createDataFrame([(a, a + 10) for a in range(6)], "admission_id long, patient_id long").hint("merge")
    diagnoses = spark.createDataFrame(rows, "admission_id long, diagnosis_code string").join(admissions, "admission_id")
    lookup = spark.createDataFrame([(f"c{c}", f"t{c}") for c in range(3)], "diagnosis_code string, long_title string")
    found = dc.pair_cooccurrence(diagnoses, lookup, F.lit(True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert [tuple(r) for r in found.collect()] == [("t0", "t1", 8), ("t0", "t2", 4), ("t1", "t2", 4)]
