"""Parsed filings, chunks, sparse indexes and result logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = """ticker string, cik string, company_name string, accession string, form string, filing_date string, period_of_report string,
fiscal_year int, primary_doc string, edgar_url string, sections array<struct<item_code: string, item_title: string, text: string, char_start: int, char_end: int>>"""

CHUNK = """ticker string, cik string, accession string, fiscal_year int, edgar_url string, item_code string, item_title string,
strategy string, chunk_index int, char_start int, char_end int, token_count int, text string"""

SECTION = "accession string, item_code string, item_title string, text string, char_start int, char_end int"

CHUNK_COLUMNS = [c.split()[0] for c in CHUNK.split(",")]

#: A retrieval log: names as in its JSON lines.
RETRIEVAL_LOG = """strategy string, mode string, rerank boolean, question_id string, type string, query string, answerable boolean,
gold_sections array<struct<accession: string, item_code: string>>, retrieved_sections array<struct<accession: string, item_code: string>>,
recall_at_1 double, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double,
encode_ms double, dense_ms double, sparse_ms double, fuse_ms double, rerank_ms double, total_ms double"""

RAG_LOG = """strategy string, mode string, rerank boolean, question_id string, type string, query string, answerable boolean, response string,
refused boolean, retrieved_sections array<struct<accession: string, item_code: string>>, faithfulness double, context_precision double,
context_recall double, relevancy double, judge_ms double, judge_usd double, encode_ms double, dense_ms double, sparse_ms double,
fuse_ms double, rerank_ms double, total_ms double, generate_ms double, serving_ms double, prompt_tokens long, completion_tokens long, usd double"""


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed filings, in order of their accession.  A folder that isn't there is an error that names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no parsed filings at {folder}")
    return spark.read.schema(PARSED).option("multiLine", True).option("recursiveFileLookup", True).json(folder).orderBy("accession")


def load_parsed(spark: SparkSession, folder: str, accession: str) -> DataFrame:
    """One filing; an accession that isn't there is an error.  Only its own folder is read if filings were written by accession."""
    own = f"{folder}/accession_key={accession.strip().replace('-', '')}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = read_parsed(spark, own if there else folder).where(F.col("accession") == accession)
    if rows.isEmpty():
        raise KeyError(f"no parsed filing {accession}")
    return rows


def sections(parsed: DataFrame) -> DataFrame:
    """A row for each section, with its position in the filing."""
    keep = [c for c in parsed.columns if c != "sections"]
    return parsed.select(*keep, F.posexplode("sections").alias("section_pos", "s")).select(*keep, "section_pos", "s.*")


def write_parsed(parsed: DataFrame, folder: str) -> None:
    """Replace the filings that ``parsed`` holds, each in a folder of its accession, and no other."""
    rows = parsed.withColumn("accession_key", F.replace(F.trim("accession"), F.lit("-"), F.lit("")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("accession_key").json(folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Replace the chunks of every (strategy, accession) that ``chunks`` holds, and no other."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "accession").parquet(folder)


def ensure_schema(spark: SparkSession, database: str) -> list[str]:
    """Create the tables that aren't there yet, chunks by strategy and accession; their names.  What is there stays."""
    kinds = {"filings": PARSED.split(", sections")[0], "sections": SECTION, "chunks": CHUNK + ", embedding array<float>"}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in kinds.items():
        layout = " PARTITIONED BY (strategy)" if name == "chunks" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{layout}")
    return [f"{database}.{name}" for name in kinds]


def read_chunks(spark: SparkSession, folder: str, strategy: str | None = None, accession: str | None = None) -> DataFrame:
    """Chunks, pruned to the partitions asked for; strategy and accession stay strings."""
    rows = spark.read.schema(CHUNK).parquet(folder)
    if strategy is not None:
        rows = rows.where(F.col("strategy") == strategy)
    return rows if accession is None else rows.where(F.col("accession") == accession)


def pending(expected: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to be done."""
    return expected.join(done.select(*key).distinct(), key, "left_anti")


def read_log(spark: SparkSession, path: str, schema: str = RETRIEVAL_LOG) -> DataFrame:
    """A result log: missing texts are empty, missing timings and counts 0, metrics of another type null; blank lines are
    passed over."""
    return lenient(spark.read.schema(schema).option("mode", "PERMISSIVE").json(path))


def lenient(rows: DataFrame) -> DataFrame:
    """A log's rows with defaults: see ``read_log``."""
    out = {}
    for name, kind in rows.dtypes:
        if kind == "string":
            out[name] = F.coalesce(name, F.lit(""))
        elif name.endswith("_ms") and name != "judge_ms" or name == "usd":
            out[name] = F.coalesce(name, F.lit(0.0))
        elif kind == "bigint":
            out[name] = F.coalesce(name, F.lit(0))
    return rows.withColumns(out)


def present_cells(grid: DataFrame, log: DataFrame) -> DataFrame:
    """The cells of a grid that a log has rows of."""
    return grid.join(log.select("strategy", "mode", "rerank").distinct(), ["strategy", "mode", "rerank"], "left_semi")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path, ignoreNullFields=False)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes below a folder by partition of strategy, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "strategy=([^/]+)", 1).alias("strategy")).agg(F.sum("length").alias("bytes"))
