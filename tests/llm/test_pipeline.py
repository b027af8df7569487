"""The corpus pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from checks.compare import connect
from scenelake.llm import decontaminate

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.count()
        assert 0 < after <= before
        before = after
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontaminate.find_items(docs, bench).filter("n_hit > 0").count() == 0
    assert docs.filter(docs.text.rlike("[a-z0-9]@mail[0-9]")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == before


def test_run_has_the_rows_of_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and {"doc_id", "piece", "sequence_id"} <= set(rows[0].asDict())
    assert connect(SF_DIR).execute("select count(*) from documents").fetchone()[0] >= len({r.doc_id for r in rows})
