"""The reports of licenses and edits on odd rows, and columns that bear the names of their results."""

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import edit_counts, licenses

BYTE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, digest string, notices int, n_tokens string, edited_chars int, edits string"


def test_license_report_of_odd_rows(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    rows = [(1, mit, "d", 1, "n", 2, "e"), (1, mit, "d", 1, "n", 2, "e"), (2, None, "d", 1, "n", 2, "e"), (3, "", "d", 1, "n", 2, "e"), (None, "words", "d", 1, "n", 2, "e")]
    got = licenses.license_report(spark.createDataFrame(rows, DOC))
    assert got.columns == ["doc_id", "digest", "license_id", "notices"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert [(r[0], r[2], r[1] is None, r[3]) for r in found] == [(1, "MIT", False, found[0][3])] * 2 + [(2, None, True, ""), (3, None, True, ""), (None, None, False, "")]
    assert licenses.license_report(spark.createDataFrame([], DOC)).collect() == []


def test_edit_report_of_odd_rows(spark):
    rows = [(1, "some words here", "d", 1, "n", 2, "e"), (1, "some words here", "d", 1, "n", 2, "e"), (2, None, "d", 1, "n", 2, "e"), (3, "", "d", 1, "n", 2, "e"), (None, "x " * 9000, "d", 1, "n", 2, "e")]
    got = edit_counts.edit_report(spark.createDataFrame(rows, DOC), BYTE)
    assert got.columns == ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "encoded_chars"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], []).append(tuple(r))
    assert len(by_id[1]) == 2 and len(set(by_id[1])) == 1 and by_id[2][0][1:] == by_id[3][0][1:] and by_id[2][0][1] == 0 and by_id[None][0][1] > 9000
    assert edit_counts.edit_report(spark.createDataFrame([], DOC), BYTE).collect() == []


def test_columns_named_like_results_are_replaced(spark):
    """n_tokens and encoded_chars of the input go, whatever their types; other columns stay."""
    rows = [(1, "a b c", "old", 7, "kept"), (2, None, "old", 7, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, encoded_chars int, source string")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit("zz").alias("insert"))).cast(edit_counts.EDIT)
    got = {r["doc_id"]: r for r in edit_counts.count_edits(docs.withColumn("edits", edits), BYTE).collect()}
    assert all(r["source"] == "kept" and isinstance(r["n_tokens"], int) and isinstance(r["encoded_chars"], int) for r in got.values())
    assert got[1]["edited_chars"] == 6 and got[2]["n_tokens"] == 0 and got[2]["edited_chars"] == 2
