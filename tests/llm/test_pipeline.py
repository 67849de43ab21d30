import numpy as np

import corpus_pipeline
from folia.llm import decontaminate
from folia.llm._hash import shingles
from folia.llm._util import stored

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SF), "test-stage")
        if name != "packing":
            assert after.columns == columns
            kept[name] = after.toPandas()
            before = after
        else:
            pieces = after.toPandas()
    assert len(kept["quality"]) < docs.count()
    texts = [shingles(t) for t in kept["near_dedup"].text]
    for i in range(len(texts)):
        for j in range(i):
            n = len(np.intersect1d(texts[i], texts[j]))
            assert 100 * n < 80 * (len(texts[i]) + len(texts[j]) - n) or not n
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate.matchers(items, 10)
    clean = {d for d, t in zip(kept["near_dedup"].doc_id, kept["near_dedup"].text) if not decontaminate.spans(decontaminate.words(t), found)[0]}
    assert set(kept["decontamination"].doc_id) == clean
    assert set(kept["secrets"].doc_id) == clean and not kept["secrets"].text.str.contains("AKIA[0-9A-Z]{16}").any()
    assert set(pieces.doc_id) == clean
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_run_has_the_last_stage_s_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0


def test_stages_on_odd_rows(spark, make, dirty, tmp_path):
    """Null, empty, very long, repeated rows and clashing columns through all stages in a row."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of the kind"), (2, None), (None, "x")], "item_id long, text string")
    none.write.parquet(f"{tmp_path}/labels.parquet"), bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (dirty, []):
        make(dirty).where("true" if rows else "false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        before, columns = docs, docs.columns
        for name, stage in corpus_pipeline.STAGES:
            after = stored(stage(spark, before, f"file://{tmp_path}"), "odd-stage")
            if name == "quality":
                assert after.count() == len(rows)  # no labels: all are kept
            if name == "near_dedup" and rows:
                ids = [r.doc_id for r in after.collect()]
                assert 1 in ids and not {2, 3, 16} & set(ids) and {4, 5, 6, 7} <= set(ids) and ids.count(11) == 1
            if name != "packing":
                assert after.columns == columns
                before = after
        assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == after.count()
