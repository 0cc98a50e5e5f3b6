"""From raw documents to token shards: toxicity, near-dedup, decontamination, mixing, tokens.

Each stage takes the documents that its predecessor kept; ``run`` writes them between stages and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontam import without_contaminated
from tessera.llm.mixing import taken
from tessera.llm.neardup import without_near_duplicates
from tessera.llm.queries import LANGUAGES, labelled_languages, tokenizer_file
from tessera.llm.support import Tables, delete, materialize, shared_folder
from tessera.llm.tokens import read_shards, write_shards
from tessera.llm.toxicity import without_toxic
from tessera.shipping import ship


#: Word-shingle similarity of near copies in the near_dedup stage, in hundredths; the op5 query keeps its own 85.
NEAR_PERCENT = 80


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The tables that the last stage worked on.
_LAST = Tables()


def stage(work: Stage) -> Stage:
    """A stage that first deletes the tables that the one before it worked on: its result was written since, as ``docs`` shows."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LAST.paths else []
        for session, path in [p for p in _LAST.paths if not any(p[1].split("://")[-1].lstrip("/") in f for f in read)]:
            delete(session, path)
            _LAST.paths.remove((session, path))
        Tables.open.append(_LAST)
        try:
            return work(spark, docs, sf_dir)
        finally:
            Tables.open.remove(_LAST)

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Each row is judged by its own text: null and repeated ids too.  Null and empty texts have the score of no words.  Columns of
    any names stay; no rows give no rows.
    """
    return without_toxic(docs, _read(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more), the one of the smallest doc_id.

    Rows with null or repeated ids are members like others, nulls last; one row of identical ones stays.  Texts without
    words are linked with nothing and all stay.  Columns of any names stay; no rows give no rows.
    """
    ship(spark)
    return without_near_duplicates(docs, percent=NEAR_PERCENT)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Each row is judged by its own text: null and repeated ids too.  Null and empty texts stay, as do all rows of an empty
    benchmark.  Columns of any names stay; no rows give no rows.
    """
    return without_contaminated(docs, _read(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as brings the languages' tokens to their target shares.

    Rates are fitted with a floor of 1: no document is lost, and those of scarce languages come more than once.  Texts without
    words have the rate of their cell; rows are drawn by id and text.  Columns of any names stay; no rows give no rows.
    """
    labels = _read(spark, sf_dir, "labels")
    return taken(docs, labelled_languages(docs, labels), LANGUAGES, floor=1.0)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: where each document's ids begin, how many there are, and their crc32.

    A row for each row, in ascending order of doc_id, nulls first; null and empty texts are their end id alone.
    """
    folder = f"{shared_folder(ship(spark))}/tokens"
    write_shards(docs, folder, tokenizer_file())
    return read_shards(spark, folder)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can't express the trained score, nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written to the shared folder and read again."""
    docs, held = _read(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        last = name == STAGES[-1][0]
        docs = work(spark, docs, sf_dir) if last else materialize(work(spark, docs, sf_dir), name)
        if held:  # its rows are in the table that was just written, or in the shards
            delete(spark, held)
        held = None if last else docs.tessera_path
    return docs
