import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetframe.operators import learn as ln
from onsetframe.operators.labels import earliest_positive, label_onsets
from onsetframe.operators.latent import LatentModel, fit_latent
from onsetframe.operators.records import clean_events, grid_records
from onsetframe.plans import cli
from onsetframe.plans.codelists import ANALYSIS_CATEGORIES, COMMON_ANALYSES
from onsetframe.plans.config import (
    CohortConfig,
    StagePaths,
    config_grid,
    extraction_name,
    find_configs,
    write_grid,
)
from onsetframe.plans.extraction import (
    demographics_for_labels,
    ecg_for_labels,
    extract,
    extract_grid,
    lab_periods,
    labelled_windows,
)
from onsetframe.plans.learning import Source, learn, learn_job
from onsetframe.sources.stages import (
    BucketStage,
    StageStore,
    bucket_count,
    read_records,
    write_metrics,
    write_output,
    write_records,
)
from onsetframe.sources.tables import ClinicalTables, quarantine, read_code_list, read_sample


@pytest.fixture(scope="module")
def hospital(tmp_path_factory):
    """A small hospital in delimited files: 40 patients, 2 analyses, ECG, every third gets sick."""
    root = tmp_path_factory.mktemp("hospital")
    (root / "hosp").mkdir()
    (root / "ecg").mkdir()
    lab, adm, dia, pat, ecg = [], [], [], [], []
    for p in range(1, 41):
        pat.append(f"{p},{'F' if p % 2 else 'M'},{30 + p},2150")
        for m in range(1, 13):
            base = 1.0 + (m / 6 if p % 3 == 0 else 0)
            lab.append(f"{p},50912,2150-{m:02d}-{p % 27 + 1:02d} 08:15:00,{base},\"x, y\"")
            lab.append(f"{p},51221,2150-{m:02d}-{p % 27 + 1:02d} 08:45:00,{40 - m},")
            lab.append(f"{p},99999,2150-{m:02d}-01 08:45:00,1,")
            ecg.append(f"{p},2150-{m:02d}-03 10:00:00," + ",".join(str(p + j) for j in range(9)))
        adm.append(f"{p},{100 + p},2151-01-10 10:00:00")
        dia.append(f"{p},{100 + p},{'5856' if p % 3 == 0 else '25000'},9")
    lab.append("1,50912,,9,")

    def packed(name, header, lines):
        with gzip.open(root / "hosp" / name, "wt") as f:
            f.write("\n".join([header, *lines]) + "\n")

    packed("labevents.csv.gz", "subject_id,itemid,storetime,valuenum,comments", lab)
    packed("admissions.csv.gz", "subject_id,hadm_id,dischtime", adm)
    packed("diagnoses_icd.csv.gz", "subject_id,hadm_id,icd_code,icd_version", dia)
    packed("patients.csv.gz", "subject_id,gender,anchor_age,anchor_year", pat)
    packed("d_labitems.csv.gz", "itemid,label", ["50912,Creatinine", "51221,Hematocrit"])
    packed("d_icd_diagnoses.csv.gz", "icd_code,icd_version,long_title", ["5856,9,End stage renal disease"])
    names = "rr_interval,p_onset,p_end,qrs_onset,qrs_end,t_end,p_axis,qrs_axis,t_axis"
    (root / "ecg" / "machine_measurements.csv").write_text("\n".join([f"subject_id,ecg_time,{names}", *ecg]) + "\n")
    return root


@pytest.fixture
def tables(spark, hospital):
    return ClinicalTables(spark, str(hospital))


CONFIG = CohortConfig([50912, 51221], ["5856"], "h", "month", 3, 30, 365)


def test_delimited_tables(tables):
    diagnoses = tables.diagnoses()
    assert dict(diagnoses.dtypes)["diagnosis_code"] == "string" and "icd_version" in diagnoses.columns
    analyses = tables.analyses()
    assert {"patient_id", "analysis_id", "analysis_time", "analysis_value", "comments"} == set(analyses.columns)
    assert analyses.where(F.col("comments") == "x, y").count() == 480
    assert tables.ecg_machine_measurements().count() == 480
    tables.register_views()
    assert tables.spark.sql("select count(*) from patients where age = 31").first()[0] == 1


def test_selected_ids_reach_the_scan(tables, tmp_path):
    stored = tables.to_parquet("analyses", str(tmp_path / "lab"), 4)
    plan = clean_events(stored, [50912])._jdf.queryExecution().executedPlan().toString()
    assert "analysis_id" in plan.split("PushedFilters")[1] and "comments" not in plan.split("ReadSchema")[1]
    assert read_sample(tables.spark, str(tmp_path / "lab")).count() == stored.count()


def test_code_list(spark, tmp_path):
    path = tmp_path / "codes.json"
    path.write_text(json.dumps([{"icd_code": "5856", "occurrence_count": "8885", "long_title": "End stage"}], indent=1))
    assert tuple(read_code_list(spark, str(path)).first()) == ("5856", 8885, "End stage")


def test_records_roundtrip_and_guard(tables, tmp_path, rows, spark):
    grid = grid_records(clean_events(tables.analyses(), [50912]), [50912])
    path = str(tmp_path / "records")
    write_records(grid, path, buckets=8)
    assert rows(read_records(tables.spark, path)) == rows(grid)
    some = read_records(tables.spark, path, [3, 7])
    assert rows(some) == rows(grid.where("patient_id in (3, 7)"))
    assert "PartitionFilters: []" not in some._jdf.queryExecution().executedPlan().toString()
    other = str(tmp_path / "default")
    write_records(grid, other)  # the reader takes the number of buckets from the set
    assert rows(read_records(tables.spark, other, [3, 7])) == rows(some)
    write_records(grid, other + "/more", buckets=5)
    with pytest.raises(ValueError, match="mixes"):
        bucket_count(spark, other)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_records(grid, path, buckets=8)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_output(grid, path)


def test_stage_store_builds_once(spark, tmp_path):
    store, calls = StageStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.materialize("s", "k", build).count() == 3
    assert len(calls) == 1 and store.has("s", "k") and not store.has("s", "other")
    store.materialize("s", "other", build)
    assert len(calls) == 2


def test_replaced_input_rebuilds(spark, tmp_path):
    store, calls, source = StageStore(spark, str(tmp_path / "stages")), [], str(tmp_path / "in")

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    spark.range(3).coalesce(1).write.parquet(source)
    for _ in range(2):
        assert store.materialize("s", "k", build, inputs=[source]).count() == 3
    assert len(calls) == 1
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(source)  # another file under the same path
    assert store.materialize("s", "k", build, inputs=[source]).count() == 5 and len(calls) == 2


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    """A bucket whose files are as they were keeps its files, a crash in between is mended by the next refresh."""
    records, root, built = str(tmp_path / "records"), str(tmp_path / "stages"), []
    rows = spark.range(200).select((F.col("id") % 40).alias("patient_id"), F.col("id").cast("double").alias("v"))
    write_records(rows, records, buckets=4)
    stage = BucketStage(spark, root, "sums", "k")

    def build(part):
        built.append(sorted(r[0] for r in part.select("patient_id").distinct().collect()))
        return part.groupBy("patient_id").agg(F.sum("v").alias("total"))

    def files():
        return {f.parent.name: {x.name: x.stat().st_mtime_ns for x in f.parent.glob("*.parquet")} for f in (tmp_path / "stages" / "sums" / "k").rglob("*.parquet")}

    def sums(df):
        return {r.patient_id: r.total for r in df.collect()}

    want = {p: float(sum(i for i in range(200) if i % 40 == p)) for p in range(40)}
    assert sums(stage.refresh(records, build)) == want and len(built) == 1
    before = files()
    assert sums(stage.refresh(records, build)) == want and len(built) == 1 and files() == before
    folder = next((tmp_path / "records" / "patient_buckets=4").glob("patient_bucket=2"))
    touched = {r[0] for r in spark.read.parquet(str(folder)).select("patient_id").distinct().collect()}
    spark.read.parquet(str(folder)).selectExpr("patient_id", "v + 1000 AS v").write.parquet(str(tmp_path / "new"))
    for old in folder.iterdir():
        old.unlink()
    for new in (tmp_path / "new").glob("*.parquet"):
        (folder / new.name).write_bytes(new.read_bytes())
    want = {p: v + 5000 if p in touched else v for p, v in want.items()}
    with pytest.raises(RuntimeError):
        stage.refresh(records, lambda part: (_ for _ in ()).throw(RuntimeError("lost")))
    assert set(sums(stage.read())) == set(range(40)) - touched  # the stale bucket is not taken for a finished one
    assert sums(stage.refresh(records, build)) == want
    assert built[1:] == [sorted(touched)]
    after = files()
    assert {b for b in after if after[b] != before[b]} == {"patient_bucket=2"}
    for old in (tmp_path / "records" / "patient_buckets=4" / "patient_bucket=1").iterdir():
        old.unlink()
    left = {p for p in want if p in sums(stage.refresh(records, build))}
    assert left < set(want) and len(built) == 2


def test_malformed_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    good = ["1,50912,2150-01-01 08:15:00,1.5,\"a, b\"", "2,50912,,,", "3,50912,2150-01-01 08:15:00,2.5,x"]
    bad = ["4,50912,2150-01-01 08:15:00", "5,x,2150-01-01 08:15:00,1,", "6,50912,tomorrow,1,", "7,50912,2150-01-01 08:15:00,1,a,b"]
    with gzip.open(tmp_path / "hosp" / "labevents.csv.gz", "wt") as f:
        f.write("\n".join(["subject_id,itemid,storetime,valuenum,comments", *good[:1], *bad, *good[1:]]) + "\n")
    tables = ClinicalTables(spark, str(tmp_path))
    aside = str(tmp_path / "aside")
    rows = tables.set_aside("analyses", aside)
    assert sorted(r.patient_id for r in rows.collect()) == [1, 2, 3] and "_malformed_line" not in rows.columns
    assert sorted(r.line for r in quarantine(spark, aside).collect()) == bad
    assert tables.analyses().where("comments = 'a, b'").count() == 1
    with gzip.open(tmp_path / "hosp" / "labevents.csv.gz", "wt") as f:
        f.write("subject_id,itemid,storetime,valuenum,comments\n")
    again = ClinicalTables(spark, str(tmp_path))
    assert again.set_aside("analyses", aside).count() == 0 == quarantine(spark, aside).count()


def test_identity_follows_the_files(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    tables = ClinicalTables(spark, str(tmp_path))
    assert tables.identity()["files"] is None
    path = tmp_path / "hosp" / "patients.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("subject_id,gender\n1,F\n")
    first = tables.identity()
    assert first == tables.identity() and first["files"]
    with gzip.open(path, "wt") as f:
        f.write("subject_id,gender\n1,F\n2,M\n3,F\n")
    assert tables.identity() != first


def test_main_plan_equals_steps(tables, rows):
    lazy = labelled_windows(tables.analyses(), tables.diagnoses(), tables.admissions(), CONFIG)
    steps = extract(tables, CONFIG)
    joined = steps["windows"].join(steps["labels"], ["patient_id", "observation_date"])
    columns = ["patient_id", "observation_date", "label", "matrix"]
    assert rows(lazy.select(columns)) == rows(joined.select(columns))
    assert lazy.groupBy("label").count().count() == 2
    sided = labelled_windows(tables.analyses(), tables.diagnoses(), tables.admissions(), CONFIG, split=(0.25, 1))
    assert rows(sided.select(columns)) == rows(lazy.select(columns))
    assert sided.where("split = 'test'").select("patient_id").distinct().count() == 10


def test_stages_are_reused(tables, tmp_path, rows, spark):
    paths = StagePaths.derived(str(tmp_path), "ckd", "renal", "B3m_G30d_P1y")
    first = rows(extract(tables, CONFIG, paths)["labels"])
    broken = ClinicalTables(spark, "/nowhere")
    again = extract(broken, CONFIG, paths)
    assert rows(again["labels"]) == first
    with pytest.raises(Exception):
        extract(broken, CohortConfig([50912], ["5856"], "h", "month", 4, 30, 365), paths)


def test_grid_matches_single_runs(tables, tmp_path, rows):
    cells = config_grid({"a": [50912], "b": [50912, 51221]}, {"x": ["5856"], "y": ["25000"]}, {"3m": 90, "1y": 365}, 3, 30)
    assert len(cells) == 8 and cells[0].name == "x_B3m_G1m_P3m"
    out = extract_grid(tables, cells, str(tmp_path), "b")
    for cell in cells:
        if cell.category != "b":
            continue
        single = extract(tables, cell.config)
        part = out["labels"].where(
            (F.col("disease") == cell.disease) & (F.col("prediction_window_days") == cell.config.prediction_window_days)
        )
        columns = ["patient_id", "observation_date", "label"]
        assert rows(part.select(columns)) == rows(single["labels"].select(columns))
        assert rows(out["windows_b"]) == rows(single["windows"])
    dates = out["labels"].select("patient_id", "observation_date").distinct()
    assert out["demographics"].count() == dates.count() == out["ecg"].count()
    assert len(out["ecg"].first().matrix) == 3 and len(out["ecg"].first().matrix[0]) == 9


def test_grid_keys_name_all_they_depend_on(tables, tmp_path, rows):
    def labels(diseases, windows):
        cells = config_grid({"a": [50912]}, diseases, windows, 3, 30)
        return rows(extract_grid(tables, cells, str(tmp_path), "a")["labels"])

    first = labels({"x": ["5856"], "y": ["25000"]}, {"p": 90, "q": 365})
    swapped = labels({"x": ["25000"], "y": ["5856"]}, {"p": 90, "q": 365})
    one = labels({"x": ["5856"], "y": ["25000"]}, {"p": 455})
    assert first != swapped and len(one) != len(first)
    with pytest.raises(ValueError):
        extract_grid(tables, [], str(tmp_path), "a")


def test_config_files(tmp_path):
    cells = config_grid({**ANALYSIS_CATEGORIES, "top": COMMON_ANALYSES})
    assert len(cells) == 136
    assert extraction_name("t2d", "24m", "3m", "5y") == "t2d_B24m_G3m_P5y" == next(
        c.name for c in cells if c.disease == "t2d" and c.prediction == "5y")
    write_grid([c for c in cells if c.prediction == "3m" and c.disease == "ckd"], str(tmp_path), "data")
    pairs = find_configs(str(tmp_path), "hematology")
    assert len(pairs) == 17 and "/hematology/" in pairs[0][0] and "/body_fluids/" in pairs[1][0]
    config = CohortConfig.from_json(pairs[0][0])
    assert config.selected_analyses_ids == ANALYSIS_CATEGORIES["hematology"] and config.gap_days == 90
    assert "labels/ckd/" in StagePaths.from_json(pairs[0][1]).labeled_lab_records
    bad = tmp_path / "bad.json"
    bad.write_text('{"unknown": 1}')
    with pytest.raises(ValueError):
        CohortConfig.from_json(str(bad))
    for wrong in ({"backward_window_time_unit": "hour"}, {"lab_records_frequency": "fortnight"}, {"gap_days": -1}):
        with pytest.raises(ValueError):
            CohortConfig(**wrong)


def test_command_line(tables, hospital, tmp_path, spark):
    dataset = str(tmp_path / "dataset.json")
    ClinicalTables.write_config(dataset, str(hospital))
    cells = config_grid({"a": [50912], "b": [51221]}, {"x": ["5856"]}, {"1y": 365}, 3, 30)
    write_grid(cells, str(tmp_path / "configs"), str(tmp_path / "data"))
    common = ["--dataset", dataset, "--configs", str(tmp_path / "configs"), "--first", "b"]
    for stage in ("labelled", "ecg", "demographics", "demographics"):
        cli.main([stage, *common])
    paths = StagePaths.from_json(find_configs(str(tmp_path / "configs"))[0][1])
    assert spark.read.parquet(paths.rolling_ecg_records).count() == spark.read.parquet(paths.demographics_records).count()
    cli.main(["records", "--dataset", dataset, "--output", str(tmp_path / "records")])
    records = read_records(spark, str(tmp_path / "records"))
    assert {50912, 51221, 99999} <= {int(r[0]) for r in records.select("analysis_id").distinct().collect()}
    learned = str(tmp_path / "learned")
    cli.main(["learn", *common, "--output", learned, "--trees", "3", "--max-depth", "3"])
    assert len(list((tmp_path / "learned").glob("*/metrics"))) == 2
    # other label dates are other samples
    cli.main(["learn", "--dataset", dataset, "--configs", str(tmp_path / "configs"), "--first", "b", "--output", learned, "--trees", "2", "--max-depth", "2"])
    made = len(list((tmp_path / "learned" / "stages" / "samples").iterdir()))
    cli.main(["labelled", "--dataset", dataset, "--configs", str(tmp_path / "configs"), "--first", "a"])
    cli.main(["learn", "--dataset", dataset, "--configs", str(tmp_path / "configs"), "--first", "a", "--output", learned, "--trees", "2", "--max-depth", "2"])
    assert made == 2 and len(list((tmp_path / "learned" / "stages" / "samples").iterdir())) == 4


def test_learn_job(tables, tmp_path, spark):
    periods = lab_periods(tables.analyses(), [50912, 51221], "h", "month")
    spine = periods.select("patient_id", F.col("period_end").alias("observation_date"))
    earliest = earliest_positive(tables.diagnoses(), tables.admissions(), ["5856"])
    labels = label_onsets(spine, earliest, 30, 365)
    windows = extract(tables, CONFIG)["windows"]
    ecg = ecg_for_labels(tables.ecg_machine_measurements(), labels, CONFIG)
    demographics = demographics_for_labels(tables.patients(), labels)
    store = StageStore(spark, str(tmp_path / "stages"))
    out = str(tmp_path / "out")
    learned = learn_job(
        store, "k", labels, [Source("lab", windows, 2), Source("ecg", ecg, 9)], 3, demographics, out,
        test_size=0.3, seed=1, trees=5, max_depth=4,
    )
    metrics = {r.metric: r.value for r in spark.read.json(out + "/metrics").collect()}
    assert 0 <= metrics["accuracy"] <= 1 and metrics["roc_auc_scores"] > 0.5
    samples = spark.read.parquet(str(next((tmp_path / "stages" / "samples").iterdir())))
    assert samples.where("split = 'test'").select("patient_id").distinct().count() == 12
    assert {len(r.matrix[0]) for r in samples.limit(20).collect()} == {13}
    assert learned.predictions.count() == samples.where("split = 'test'").count()
    assert spark.read.json(out + "/confusion").count() == 4


def test_one_class_for_all_metrics(spark):
    """Several classes by the largest score, two by the threshold, in every metric alike."""
    rng = random.Random(1)
    many = [(i, float(i % 3), "test" if i % 4 == 0 else "train", [[i % 3 + rng.random() / 2, rng.random()]]) for i in range(240)]
    schema = "patient_id int, label double, split string, matrix array<array<double>>"
    df = spark.createDataFrame(many, schema).withColumn("observation_date", F.lit("2020-01-01").cast("date"))
    learned = learn(df, 2, trees=5, max_depth=3)
    metrics = {r.metric: r.value for r in learned.metrics.collect()}
    hits = sum(r.n for r in learned.confusion.collect() if r.truth == r.predicted)
    assert metrics["accuracy"] > 0.95 and metrics["accuracy"] == hits / 60
    two = df.withColumn("label", (F.col("label") > 0).cast("double"))
    for threshold in (0.3, 0.9):
        learned = learn(two, 2, trees=5, max_depth=2, threshold=threshold)
        value = {r.metric: r.value for r in learned.metrics.collect()}["accuracy"]
        assert value == next(r.precision for r in learned.report.collect() if r["class"] == "accuracy")
        assert value == sum(r.n for r in learned.confusion.collect() if r.truth == r.predicted) / 60


def test_forest_probabilities_and_latent(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )
    test, train = df.where("vec_id % 5 = 0"), df.where("vec_id % 5 <> 0")
    scored = ln.score_forest(ln.fit_forest(train, trees=10, seed=42), test).collect()
    assert len(scored) == test.count()
    assert all(abs(sum(r.scores) - 1) < 1e-9 and len(r.scores) == 10 for r in scored)
    latent = fit_latent(train, 3).transform(test)
    assert latent.count() == len(scored) and {len(r.vector) for r in latent.collect()} == {3}


def test_latent_directions(spark, tmp_path):
    """The same directions as a full decomposition, on windows wider than there are samples in a partition."""
    rng = np.random.default_rng(2)
    hidden = rng.normal(size=(300, 5)) * [9, 6, 4, 2, 1]
    x = hidden @ rng.normal(size=(5, 120)) + 0.01 * rng.normal(size=(300, 120)) + 50
    rows = [(i, v.reshape(12, 10).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "patient_id int, matrix array<array<double>>").repartition(7)
    model = fit_latent(df, 4)
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    v = v[:4] * np.sign(v[np.arange(4), np.abs(v[:4]).argmax(1)])[:, None]
    np.testing.assert_allclose(model.directions, v, atol=1e-7)
    np.testing.assert_allclose(model.shares, s[:4] ** 2 / (s**2).sum(), rtol=1e-9)
    model.write().overwrite().save(str(tmp_path / "latent"))
    got = {r.patient_id: r.vector for r in LatentModel.load(str(tmp_path / "latent")).transform(df).collect()}
    np.testing.assert_allclose([got[i] for i in range(300)], centred @ v.T, atol=1e-6)
    assert fit_latent(df.limit(1), 2).shares.tolist() == [0, 0]
    with pytest.raises(ValueError):
        fit_latent(df.where("false"), 2)


def test_metric_files(spark, tmp_path):
    write_metrics(spark.createDataFrame([("accuracy", 0.5)], "metric string, value double"), str(tmp_path / "m"))
    assert tuple(spark.read.json(str(tmp_path / "m")).first()) == ("accuracy", 0.5)
