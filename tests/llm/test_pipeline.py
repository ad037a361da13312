import re

import corpus_pipeline
from quillmer.llm import gray, queries

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
        if name == "near_dedup":
            assert docs.count() == gray.simhash_groups(spark, docs).select("component_id").distinct().count()
        if name == "pii":
            assert not any(re.search(r"\S@mail\d", r["text"] or "") for r in docs.collect())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] >= sizes[4] > 0 and docs.count() >= sizes[4]


def test_names():
    assert [re.match(r"op\d+", q)[0] for q in queries.queries() if q != "pipeline"] == [f"op{n}" for n in range(1, 11)]
