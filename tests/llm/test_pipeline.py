"""The pipeline's stages, each on what the stage before it wrote, and the queries with SQL."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from priorline.llm import jaccard_join, mixing, packing, pii, quality
from priorline.llm.queries import QUERIES, SQL
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given data is not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    assert compare(spark, duck, name, QUERIES[name], SQL[name], FOLDER)[0].startswith("ok")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, found = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, path = docs, str(tmp_path / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.toPandas())
        if name == "quality classifier":
            good = {r.doc_id for r in quality.quality(before, labels).collect() if r.predicted}
            assert set(found[k].doc_id) == good and len(found[k]) == len(good)
        if name == "n-gram Jaccard join":
            classes = jaccard_join.near_duplicates(before).collect()
            assert set(found[k].doc_id) == {r.component_id for r in classes} and len(found[k]) == docs.count()
        if name == "personal data":
            assert len(found[k]) == before.count()
            spans = {r.doc_id for r in pii.personal_data(before).collect() if r.spans}
            texts = dict(zip(found[k - 1].doc_id, found[k - 1].text))
            assert {i for i, t in zip(found[k].doc_id, found[k].text) if t != texts[i]} == spans
        if name == "mixing sources":
            taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mixed_documents(before).collect()}
            times = found[k].doc_id.value_counts().to_dict()
            assert all(abs(times.get(i, 0) - t / max(n, 1)) <= 1 for i, (t, n) in taken.items())
        if name == "packing":
            assert found[k].length.sum() == packing.pack(before).toPandas().length.sum()
        elif name:
            assert docs.columns == columns
    assert len(found) == 5 and sorted(found[-1].length) == sorted(corpus_pipeline.run(spark, FOLDER).toPandas().length)
