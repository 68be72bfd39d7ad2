"""The pipeline's stages, each against what brute force says of its own input."""

import corpus_pipeline
from tests.llm.test_operators import ODD, brute_components, brute_hits, table
from textloom.llm import mixing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        out[name] = [r["doc_id"] for r in docs.collect()]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids, texts = [r["doc_id"] for r in before], [r["text"] for r in before]
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            kept = set(out[name])
            assert not {i for i, t in labels.items() if t == 0} - kept and sum(i in kept for i, t in labels.items() if t == 1) <= 1
        if name == "near_dedup":
            assert sorted(out[name]) == sorted({c for _, _, c in brute_components(texts, ids, 5, 80)})
        if name == "decontamination":
            assert sorted(out[name]) == sorted(i for i, x in zip(ids, brute_hits(texts, items)) if not x[4])
        if name == "mixing":
            assert sorted(out[name]) == sorted(r["doc_id"] for r in mixing.mix(spark.createDataFrame(before)).collect() if r["sampled"])
        if name == "sharding":
            assert sorted(out[name]) == sorted(ids)
    assert docs.columns == [*columns, "shard", "slot"]


def test_stages_take_odd_rows(spark, sf_dir):
    """Null, empty, very long, tied and repeated rows, and columns whose names clash."""
    docs = table(spark, [*ODD, *ODD[:4]], [*range(len(ODD) - 1), None, 0, 1, None, 3])
    for rows in (docs, docs.limit(0)):
        before = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
            if name != "sharding":
                assert rows.columns == docs.columns
            rows = spark.createDataFrame(rows.collect(), rows.schema)
            assert before // 3 <= rows.count() <= before
        assert rows.columns == [{"shard": "input_shard", "slot": "input_slot"}.get(c, c) for c in docs.columns] + ["shard", "slot"]


def test_run_writes_and_reads_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and {"shard", "slot", "text"} <= set(rows.columns)
