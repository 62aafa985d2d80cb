import re

import __spark_entry__ as contract
import corpus_pipeline
from onsetframe.llm import registry

COLUMNS = {
    "op13": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12": "lang rank phrase a l r n score",
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5": "doc_id score kept",
    "op6": "query_id rank vec_id score", "op7": "doc_id score", "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "page_id url text n_chars", "op10": "doc_id n_shingles component_id",
}
FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = set(registry.QUERIES)
    assert names <= set(contract.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names - {"pipeline"}) == list(range(1, 14))
    assert set(registry.ORACLES) <= names


def test_columns(spark):
    for name in ("op2_secret_scan", "op3_quality_rules", "op4_packing", "op8_histogram_sort", "op9_site_style_tree"):
        out = contract.queries()[name](spark, FOLDER)
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
        assert out.count() > 0


def test_pipeline(spark):
    from onsetframe.llm import jaccard, mixing, secrets
    from test_jaccard import brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], FOLDER).cache())
    rows = [[tuple(r) for r in k.select(*columns).collect()] for k in kept[:-1]]
    assert all(k.columns == columns for k in kept[:-1])
    good = {r[0] for r in rows[1]}
    assert all(labels.get(d, 1) == 1 for d in good) and set(rows[1]) <= set(rows[0])
    single = brute([(r[0], r[1]) for r in rows[1]], 5, 80)
    assert sorted(r[0] for r in rows[2]) == sorted(set(single.values()))
    text = columns.index("text")
    assert sorted((r[0], secrets.redacted(r[1])) for r in rows[2]) == sorted((r[0], r[text]) for r in rows[3])
    copies = {r.doc_id: r.copies for r in mixing.mix_decisions(kept[3]).collect()}
    drawn = [r[0] for r in rows[4]]
    assert all(drawn.count(d) == n for d, n in copies.items())
    pieces = kept[5].collect()
    assert sum(r.length for r in pieces if r.start == 0) and {r.doc_id for r in pieces} == set(drawn)
    assert jaccard.RARE == 3
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_pipeline_edges(spark, tmp_path):
    """Null, empty and repeated rows, ids that are missing or shared, an empty table."""
    words = [f"w{i}" for i in range(400)]

    def text(i):
        return " ".join(words[(i * 37 + j * (i % 7 + 3)) % 400] for j in range(40 + i % 5)) + "."

    rows = [(i, text(i), "en", f"src{i % 2}", 1) for i in range(40)]
    rows += [(100, None, "en", "src0", None), (101, "", None, None, 0), (None, text(60), "de", "src1", 5), (5, text(5), "en", "src1", 1), (5, text(61), "en", "src1", 1)]
    rows += [(50, text(7) + " w1", "en", "src0", 2), (51, text(62) + ' password = "abcdefghijklmnop"', "en", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(99, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert {100, 101, 50} & ids == set() and ids <= {*range(40), 51, None}
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(p)[:i]) == at for p in by_sequence.values() for i, (at, _) in enumerate(sorted(p)))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in out) == sorted((r.doc_id or -1, r.start, r.ids_crc32) for r in again)
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
