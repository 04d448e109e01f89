"""Every stage on nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns; and the whole run."""

import pytest
from pyspark.sql import functions as F

from causeway.llm import packing, pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def docs(spark):
    texts = [(1, "A first line of text\nA second line of text"), (2, "A first line of text\nsomething else here"), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, f"so it says {ITEM} and more"), (1, "A first line of text\nA second line of text"), (None, "a text without an id at all"), (9, "a text without an id at all")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS)
    clash = ("h", "h1", "pos", "word", "words", "fp", "k", "bucket", "item_id", "component_id", "_score", "_cw_id", "_cw_text", "piece", "length")
    return d.withColumns({c: F.lit("clash") for c in clash})


def test_each_stage(spark, docs, tables):
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        rows = out.collect()
        kept[name] = rows
        if name != "packing":
            assert out.columns == pipeline.COLUMNS
    ids = lambda name: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept[name])
    assert ids("toxicity") == [-1, 1, 1, 2, 3, 4, 5, 6, 7, 9]
    lines = {(r["doc_id"], r["text"], r["n_chars"]) for r in kept["line_dedup"]}
    assert (2, "something else here", 19) in lines and (3, "", 0) in lines and (9, "", 0) in lines and (None, "a text without an id at all", 27) in lines
    assert len(kept["line_dedup"]) == 10
    assert ids("near_dedup") == [1, 2, 3, 6, 7, 9]
    assert ids("decontamination") == [-1, 1, 1, 2, 3, 4, 5, 6, 9]
    assert sum(r["doc_id"] == 1 for r in kept["packing"]) == 2
    assert all(0 < r["length"] <= packing.SEQUENCE_LENGTH for r in kept["packing"])
    long = sum(r["length"] for r in kept["packing"] if r["doc_id"] == 6)
    assert long > 20_000


def test_each_stage_on_an_empty_table(spark, docs, tables):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), tables)
        assert out.count() == 0 and (name == "packing" or out.columns == pipeline.COLUMNS)


def test_each_stage_without_labels_and_items(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.toxicity_stage(spark, docs, str(tmp_path)).count() == 10
    assert pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == 10


def test_the_whole_run_places_what_it_keeps(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= packing.SEQUENCE_LENGTH
