"""Spans reproduce their text, stay under the cap and break where they should."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_windows(spark):
    rows = C.windows(frame(spark, "one two three four five"), size=3, overlap=1).orderBy("local_index").collect()
    assert [r["token_count"] for r in rows] == [3, 3]
    assert rows[1]["chunk"].startswith("three")
    assert all(r["text"][r["char_start"] : r["char_end"]] == r["chunk"] for r in rows)


def test_window_offset(spark):
    row = C.windows(frame(spark, "a b c"), offset=F.lit(10)).first()
    assert (row["char_start"], row["char_end"]) == (10, 15)


def test_blank_and_null(spark):
    assert C.windows(frame(spark, "", "  \n ", None)).count() == 0
    assert C.capped(frame(spark, "", None)).count() == 0
    assert C.structural_spans(frame(spark, "", None)).count() == 0
    assert C.sentence_spans(frame(spark, "", None)).count() == 0


def test_cap(spark):
    rows = C.capped(frame(spark, " ".join(["w"] * 900)), cap=512, size=400, overlap=80).orderBy("local_index").collect()
    assert len(rows) == 3 and rows[0]["token_count"] == 400 and max(r["token_count"] for r in rows) <= 400
    assert C.capped(frame(spark, " ".join(["w"] * 500))).count() == 1  # over the window, under the cap


def test_window_must_fit(spark):
    with pytest.raises(ValueError):
        C.windows(frame(spark, "a"), size=3, overlap=3)
    with pytest.raises(ValueError):
        C.capped(frame(spark, "a"), cap=2, size=3, overlap=1)


def test_headers(spark):
    text = "before it all there is prose\nLiquidity and Capital\nlong prose that follows the header, and more\na | b | c\nRISK FACTORS\nanother long line of prose, longer than its header"
    rows = C.structural_spans(frame(spark, text)).orderBy("char_start").collect()
    assert [text[r["char_start"] : r["char_end"]].split("\n")[0] for r in rows] == ["before it all there is prose", "Liquidity and Capital", "RISK FACTORS"]


def test_no_header(spark):
    text = "these are twenty words of prose " * 4
    assert C.structural_spans(frame(spark, text)).count() == 1
    assert C.structural(frame(spark, text), cap=8, size=6, overlap=1).agg(F.max("token_count")).first()[0] <= 8


def test_sentences(spark):
    text = "One here. Two there! \"Three\"? (Four) ends.\nFive e.g. stays."
    rows = C.sentence_spans(frame(spark, text)).orderBy("sentence_index").collect()
    assert [text[r["char_start"] : r["char_end"]] for r in rows] == ["One here.", "Two there!", "\"Three\"?", "(Four) ends.", "Five e.g. stays."]


def test_change_point(spark):
    rows = [(0, i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(5)] + [(1, i, [1.0, 1.0]) for i in range(12)]
    out = C.change_points(spark.createDataFrame(rows, "k int, i int, v array<double>"), ["k"], ["i"], "v")
    groups = {(r["k"], r["i"]): r["group"] for r in out.collect()}
    assert [groups[0, i] for i in range(5)] == [0, 0, 0, 1, 1]
    assert {groups[1, i] for i in range(12)} == {0}  # equal distances do not break


def test_semantic(spark):
    embed = lambda s: s.withColumn("vector", F.when(F.col("sentence").contains("cat"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    text = "A cat sat. A cat ran. A cat ate. Stocks fell. Bonds rose."
    rows = C.semantic(frame(spark, text), "id", embed).orderBy("char_start").collect()
    assert [r["chunk"] for r in rows] == ["A cat sat. A cat ran. A cat ate.", "Stocks fell. Bonds rose."]


def test_numbering(spark):
    df = spark.createDataFrame([("f", 0, 0), ("f", 0, 1), ("f", 1, 0)], "filing string, section_pos int, local_index int")
    assert [r["chunk_index"] for r in C.number(df, ["filing"], ["section_pos", "local_index"]).orderBy("chunk_index").collect()] == [0, 1, 2]
