from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tessera.llm import mixing
from tests.llm.cases import empty, hard


def test_stages_over_a_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= set(kept) and all(r.n_chars == len(r.text) for r in rows)
        counts.append((name, len(rows)))
        if name == "near_duplicates":
            texts = Counter(r.text for r in rows)
            assert max(texts.values()) == 1
        kept = {r.doc_id: r.text for r in rows}
    sizes = dict(counts)
    assert sizes["language_id"] >= 195 and sizes["suffix_dedup"] == sizes["near_duplicates"] < 195
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_hard_rows(spark, sf):
    for table in (hard(spark), empty(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        docs.count()


def test_no_stage_hides_import_errors():
    source = open(corpus_pipeline.__file__).read()
    assert "except" not in source and mixing.__name__ in ("tessera.llm.mixing",)


def test_run_leaves_only_its_result(spark, sf):
    import os

    from tessera.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 100 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows.columns)
    assert [n.rpartition("-")[0] for n in set(os.listdir(folder)) - before if n.startswith("stage")] == ["stage-packing"]
    assert len(set(os.listdir(folder)) - before) <= 2


def test_batches_of_text_stay_small(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    docs = spark.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat(uuid(), 150) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, sf: docs.mapInArrow(sizes, "n long, size long"))])
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.n for r in rows) == 6000 and max(r.size for r in rows) < 5 << 20 < sum(r.size for r in rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
