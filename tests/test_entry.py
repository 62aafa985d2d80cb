import __spark_entry__ as contract
from workload.queries import ORACLES, QUERIES


def test_registry():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) - set(ORACLES) == {"latent_pca", "rf_train_score"}
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["patient_id", "observation_date", "label", "matrix"]
    assert out.count() > 0


def test_sample_of_queries_agrees(spark):
    from workload.check import compare, database

    folder = "/root/testdata/sf0.001"
    con = database(folder)
    names = (
        "most_common", "rolling_month", "onset_labels_grid", "oversample_auto", "ts_trend", "eval_report", "code_pair_cooccurrence", "combine_3d",
        "pivot_aggfuncs", "feature_select", "relevance_numeric", "relevance_binary_feature", "relevance_classes", "malformed_lines", "named_views",
        "prep_flat_train", "grid_labels", "latent_facts", "eval_auc_scores",
    )
    for name in names:
        assert compare(spark, con, folder, name).startswith("ok"), name
