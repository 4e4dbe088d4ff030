from collections import defaultdict

import corpus_pipeline
from gleanery.llm import langid, tiling, weak_pii
from pyspark.sql import functions as F

from .fixtures import awkward

GIVEN = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = first = spark.read.parquet(f"{GIVEN}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, GIVEN).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        kept[name] = (before, docs)
    before, after = kept["language_id"]
    scores = {r["doc_id"]: r for r in langid.identify(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, r in scores.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    before, after = kept["decontamination"]
    dirty = {r["doc_id"] for r in tiling.contaminated(before, spark.read.parquet(f"{GIVEN}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    before, after = kept["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in weak_pii.find_personal_data(before).join(before.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        assert (texts[r["doc_id"]] == r["t"]) == (r["spans"] == "")
    before, after = kept["packing"]
    pieces = defaultdict(list)
    for r in after.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == {r["doc_id"] for r in before.collect()}
    for mine in pieces.values():
        assert sum(n for _, n, _ in mine) == mine[0][2]


def test_run_is_the_stages_in_turn_and_takes_awkward_rows(spark, tmp_path):
    awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{GIVEN}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # texts without a letter and repeated texts go; the row without an id has a text of its own and stays
    assert {r["doc_id"] for r in rows} == {2, 3, 4, 5, 6, 9, 10, None}
    assert sum(r["start"] == 0 for r in rows) == len({r["doc_id"] for r in rows})


def test_run_over_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{GIVEN}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_rows_with_nulls_in_every_other_column(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    bare = docs.limit(40).select(*[(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType)).alias(c) for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, bare, GIVEN)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in bare.collect()}
