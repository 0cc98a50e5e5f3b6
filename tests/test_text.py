"""Scalar functions, by the hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, column, **values):
    fields = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*fields).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("most, out", [(2, "alpha beta"), (0, ""), (9, "alpha beta gamma delta")])
def test_truncate(spark, most, out):
    assert one(spark, T.truncate_tokens(F.col("t"), most), t="alpha beta gamma delta") == out


@pytest.mark.parametrize("text, out", [("  a \n b ", "a b"), ("x" * 96, "x" * 96), ("x" * 97, "x" * 93 + "...")])
def test_snippet(spark, text, out):
    assert one(spark, T.snippet(F.col("t")), t=text) == out


@pytest.mark.parametrize("text, phrase, out", [
    ("Not in the corpus.", None, True), ("NOT  in the\ncorpus", None, True), ("Sorry: not in the corpus!", None, True), ("\"Not in the corpus.\"", None, True),
    ("It is in the corpus", None, False), ("", None, False), ("anything", "...", False),
])
def test_refusal(spark, text, phrase, out):
    assert one(spark, T.is_refusal(F.col("t"), *([phrase] if phrase else [])), t=text) is out


def test_refusal_of_null(spark):
    assert spark.range(1).select(T.is_refusal(F.lit(None).cast("string")).alias("o")).first()["o"] is False


@pytest.mark.parametrize("line, out", [
    ("Liquidity and Capital Resources", True), ("RISK FACTORS", True), ("Revenue | 2023 | 2022", False), ("a plain line of prose.", False), ("", False), ("X", True), ("x" * 121, False), ("2023 Results", True),
])
def test_header(spark, line, out):
    assert one(spark, T.looks_like_header(F.col("t")), t=line) is out


def test_cost(spark):
    assert one(spark, T.cost_usd(F.lit(1_000_000), F.lit(500_000))) == pytest.approx(0.80)


@pytest.mark.parametrize("size, out", [(10, "10 B"), (1280, "1.2 KiB"), (3 << 20, "3.0 MiB")])
def test_bytes(spark, size, out):
    assert one(spark, T.format_bytes(F.col("n")), n=size) == out


def test_keys(spark):
    assert one(spark, T.pad_cik(F.col("c")), c="320193") == "0000320193"
    assert one(spark, T.unpad_cik(F.col("c")), c="0000320193") == "320193"
    assert one(spark, T.accession_key(F.col("a")), a=" 0000-24-1 ") == "0000241"
    assert one(spark, T.citation_tag(F.lit("MSFT"), F.lit(2024), F.lit("1A"))) == "[MSFT FY2024 Item 1A]"


def test_clean_html(spark):
    html = "<p>A<script>x</script></p><ix:hidden>secret</ix:hidden><ix:x1>kept</ix:x1><table><tr><td>Cyber</td><td>High</td></tr></table><div id='EX-21'>gone</div>tail"
    out = one(spark, T.clean_html(F.col("h")), h=html)
    assert "Cyber | High" in out and "kept" in out and "secret" not in out and "gone" not in out and "tail" not in out


def test_cosine(spark):
    a = F.array(*map(F.lit, (1.0, 0.0)))
    assert one(spark, V.cosine(a, a)) == 1.0
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
