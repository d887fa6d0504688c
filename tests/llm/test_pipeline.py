"""The pipeline on the smallest fixture: each stage's decisions take effect."""

from __future__ import annotations

from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert {"doc_id", "taken", "target"} <= set(docs.columns)


def test_near_copies_at_80_percent(spark):
    words = [f"w{i}" for i in range(100)]
    edits = {0: (), 1: (30, 60), 2: (20, 45, 70)}  # of 96 shingles: 86 of 106 stay (0.81), 81 of 111 (0.73)
    rows = [(i, " ".join("x%d" % i if k in places else w for k, w in enumerate(words))) for i, places in edits.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SMALL).collect()) == [0, 2]
