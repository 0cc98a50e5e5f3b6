"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One in so many ids is held out of training.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is divisible by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, *, each: int, columns: list[str] | None = None) -> DataFrame:
    """Up to ``each`` labelled documents that are not held out, for either value of ``label``, in hash order of the id.

    Rows with a null id or label are passed over; of repeated ids the larger label counts and any one text.
    At most 2 * each ids are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("_order", F.xxhash64("doc_id"))
    some = [known.where(F.col("label") == y).orderBy("_order", "doc_id").limit(each) for y in (0, 1)]
    picked = some[0].unionByName(some[1]).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(columns or [])).where("text IS NOT NULL")
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text", *(columns or []))
