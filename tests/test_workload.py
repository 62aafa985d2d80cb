from workload.adapters import Star
from workload.shapes import matrix_text, with_matrix_text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_parts_or_orders(spark, tmp_path):
    made = {
        "part": spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "p_partkey long, p_brand string"),
        "orders": spark.createDataFrame([(7, 70), (8, 80), (8, 81), (None, 90)], "o_orderkey long, o_custkey long"),
        "lineitem": spark.sql(
            "SELECT * FROM VALUES (7L, 1L, 1, DATE '2020-01-01', 3.0D), (8L, 2L, 1, DATE '2020-01-02', 7.0D), "
            "(9L, 1L, 1, NULL, 1.0D), (NULL, NULL, 2, NULL, 1.0D) t(l_orderkey, l_partkey, l_linenumber, l_shipdate, l_quantity)"
        ),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    star = Star(spark, str(tmp_path))
    assert sorted(map(tuple, star.diagnoses().collect())) == [
        (70, 7, "a"), (80, 8, "b"), (80, 8, "c"), (81, 8, "b"), (81, 8, "c"),
    ]
    assert sorted((r.patient_id, r.analysis_value) for r in star.analyses().collect()) == [(70, 3.0), (80, None), (81, None)]
    for df in (star.diagnoses(), star.analyses()):
        assert "BroadcastExchange" not in plan(df)


def test_text_of_whole_batches(spark):
    d = spark.createDataFrame(
        [
            (1, [[0.5e-6, -0.5e-6, None], [None, None, None]]), (2, [[None], [], None, [1.5, 2.25e-5]]), (3, None), (4, []),
            (5, [[-0.0, 1e9, -1234567.8912345]]), (6, [[None, None]]), (7, [[0.49999999999999994e-6, 1.0000005, 2.5e-7]]),
        ],
        "id int, matrix array<array<double>>",
    )
    want = {r.id: r.matrix for r in d.withColumn("matrix", matrix_text()).collect()}
    assert {r.id: r.matrix for r in with_matrix_text(d).collect()} == want
    assert want[1] == "1,-1,_;_,_,_" and want[3] is None
