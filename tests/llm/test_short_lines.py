"""Exact repeats of short lines go, short lines an edit apart stay."""

from pyspark.sql import functions as F

import corpus_pipeline
from tesselwork.llm import line_edit_dedup, queries

ROWS = [
    (1, "Les.\n\nand so on\nThe first line of the text, long enough."),
    (2, "les.  \n\nand so an\nthe first line of the text, long enoughs"),
    (3, " \nLES.\nles.\nabc"),
    (4, "abc"),
    (5, None),
]
KEPT = {1: (0, 0, ROWS[0][1]), 2: (1, 1, "\nand so an"), 3: (2, 0, " \nabc"), 4: (1, 0, ""), 5: (0, 0, "")}


def test_short_lines(spark):
    got = line_edit_dedup.line_dedup(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_exact, r.n_near, r.kept_text) for r in got} == KEPT


def test_query_and_stage_drop_short_lines(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_exact, r.n_near) for r in queries.op9_line_edit_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: k[:2] for i, k in KEPT.items()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, str(tmp_path)).collect()}
    assert kept == {i: k[2] for i, k in KEPT.items() if i != 4}
