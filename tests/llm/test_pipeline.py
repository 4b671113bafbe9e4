"""The pipeline's stages one by one, and its run."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_clean_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("kept", F.lit(1))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        if name in ("toxicity", "near-dedup"):
            assert 0.5 * n < out.count() < n
        elif name == "line dedup":
            assert out.count() == docs.count()
        docs = out.checkpoint()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_take_odd_and_empty_tables(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, "a b\nc d", "en", None, 7), (3, "a b\nc d", "en", None, 7), (None, "x y", None, "web", 3)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).collect()
        stage(spark, docs.limit(0), small).collect()


def test_planted_rows_through_the_stages(spark, small):
    """Near copies leave one document, repeated lines go, what is left is mixed and packed whole."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = " ".join(words)
    near = " ".join(words[:100] + ["other"] + words[101:])
    shared = "a passage of some length that stands in two documents which have nothing else in common with one another"
    own = [" ".join(f"{mark}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for mark in ("left", "right")]
    rows = [(900_001, text, "en", "planted", 0), (900_002, near, "en", "planted", 0), (900_003, f"{shared}\n{own[0]}", "en", "planted", 0), (900_004, f"{own[1]}\n{shared}", "en", "planted", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, small).checkpoint()
    assert kept.where("doc_id > 900000").count() == 4
    near_kept = {r["doc_id"] for r in stages["near-dedup"](spark, kept, small).where("doc_id > 900000").collect()}
    assert near_kept == {900_001, 900_003, 900_004}
    lines = stages["line dedup"](spark, kept, small).checkpoint()
    texts = {r["doc_id"]: r["text"] for r in lines.where("doc_id > 900000").collect()}
    assert texts == {900_001: text, 900_002: "", 900_003: f"{shared}\n{own[0]}", 900_004: own[1]}
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.where("text is not null").collect())
    mixed = stages["mixing"](spark, lines, small).checkpoint()
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    pieces = stages["packing"](spark, mixed, small).collect()
    begun, length, told = {}, {}, {}
    for r in pieces:
        begun[r["doc_id"]] = begun.get(r["doc_id"], 0) + (r["start"] == 0)
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
        told[r["doc_id"]] = r["doc_tokens"]
    assert begun == copies and all(length[i] == n * told[i] for i, n in copies.items())
