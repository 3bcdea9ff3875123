"""The pipeline: stages in order, their columns, and what they take out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gleaner.llm.common import shared_dir
from gleaner.llm.quality_rules import keep_good

PROSE = [
    "Early in the morning the harbour wakes, and gulls circle over nets that dry along the western quay.",
    "A carpenter measures twice before cutting, because oak is dear and patience costs him nothing at all.",
    "When rain reached the valley at last, farmers opened every gate so that cattle might find drier ground.",
    "Nobody expected the library to reopen, yet its lamps were lit again and students filled the benches.",
    "The recipe asks for butter, flour, two ripe pears, some cinnamon, and an oven that isn't too hot.",
]


@pytest.fixture
def folder(spark, tmp_path):
    item = "Which of the following rivers flows through four capital cities before it reaches the inland sea in the east?"
    long = [" ".join(PROSE[i:] + PROSE[:i]) for i in range(5)]
    rows = [
        (0, long[0], "en", "a", 1),
        (1, "too short", "en", "a", 9),
        (2, "spam " * 200, "en", "a", 1000),
        (3, long[0].replace("gulls", "crows"), "en", "b", 1),
        (4, f"{PROSE[1]} {PROSE[3]}\n{item} {PROSE[2]} Answer: the second one, as every schoolchild here can tell.", "en", "b", 1),
        (5, f"{PROSE[4]} {PROSE[2]} Besides, autumn storms had taken the old bridge.\nunique closing words for document five only", "en", "c", 1),
        (6, f"unique closing words for document five only\n{PROSE[3]} {PROSE[0]} So the council met again on Thursday and voted.", None, None, None),
        (7, None, "en", "c", None),
        (8, "", "en", "c", 0),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_out_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        ids[name] = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert ids["quality_rules"] == {0, 3, 4, 5, 6}
    # Document 3 has one line, nearly that of document 0.
    assert ids["line_dedup"] == {0, 4, 5, 6}
    assert ids["decontamination"] == {0, 5, 6} == ids["sentencepiece"]
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(final) == {0, 5, 6}
    assert "unique closing words" in final[5]["text"] and "unique closing words" not in final[6]["text"]
    assert final[6]["n_chars"] == len(final[6]["text"])
    assert all(len(r["pieces"]) > 10 for r in final.values())


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_ties_very_long_texts_and_clashing_columns(spark, folder, tmp_path):
    """Stages keep columns of any name; equal rows, a long text and nulls pass through."""
    known = keep_good(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    long = known.orderBy(F.length("text").desc()).first()["text"]
    assert len(long) > 10_000
    rows = [(1, long, 5, "r", "p", 3, True), (1, long, 5, "r", "p", 3, True), (2, None, 0, "r", "p", 3, False), (None, f"{PROSE[0]} {PROSE[2]} {PROSE[4]} No id stands beside this text at all.", 5, "r", "p", 3, None), (3, "", 0, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string, pieces string, n_lines int, clean boolean")
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns[:7] == frame.columns
        assert {(r["row"], r["pieces"], r["n_lines"]) for r in docs.collect()} == {("r", "p", 3)}
    assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [1, None]


def test_entry_has_all_eleven(spark):
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert shared_dir(spark)
