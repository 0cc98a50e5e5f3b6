"""Spark helpers of the training-data operators: shared tables, sized broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where shared tables go if the session names no folder (single-machine tests).
OWN_FOLDER = "file:///tmp/checkpoints"
#: Rows of up to some dozen bytes that may be broadcast: 16 MB or so.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor sees, below spark.checkpoint.dir; it goes when the application ends.

    A cluster must name that folder: a machine's own would hold each executor's part on its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = OWN_FOLDER
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(held)
    files.deleteOnExit(held)
    return path


class Tables:
    """The tables that are materialized inside a ``with``: at its end all but the kept ones are deleted."""

    open: list[Tables] = []

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Tables:
        Tables.open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Tables.open.remove(self)
        for spark, path in self.paths:
            if path not in self.kept:
                delete(spark, path)
        # those that stay are the next outer one's
        if Tables.open:
            Tables.open[-1].paths += [p for p in self.paths if p[1] in self.kept]

    def keep(self, *tables: DataFrame) -> None:
        """Tables as ``materialize`` returned them."""
        self.kept |= {t.tessera_path for t in tables}


def delete(spark: SparkSession, path: str) -> None:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again.

    Unlike a cache, the table outlives the executors, and its size is known when joins are planned.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.tessera_path = folder
    if Tables.open:
        Tables.open[-1].paths.append((df.sparkSession, folder))
    return out


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialized table only if it has at most ``rows`` rows; else Spark shuffles it."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), any sortable type: rows (v, root), the same
    root, one of its vertices, for every vertex of a component.

    Each round points every vertex at the smallest of itself and its neighbours and contracts the edges
    along these pointers, until none is left.  For names in random order (digests) the rounds are expected to
    grow with the logarithm of the vertices, not with the diameter.  Only counts reach the driver.
    Null ends are ignored; without edges the result is empty.
    """
    levels: list[DataFrame] = []
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    edges = materialize(edges, "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "up")
        # a pointer may lead to a vertex that itself points lower: follow it once more
        high = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(high, "up").select("v", F.col("top").alias("up")), "up2")
        levels.append(up)
        at_a = up.select(F.col("v").alias("a"), F.col("up").alias("x"))
        at_b = up.select(F.col("v").alias("b"), F.col("up").alias("y"))
        edges = materialize(edges.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = levels[0]
    for nxt in levels[1:]:
        step = nxt.select(F.col("v").alias("up"), F.col("up").alias("top"))
        out = out.join(sized(step), "up", "left").select("v", F.coalesce("top", "up").alias("up"))
    return out.select("v", F.col("up").alias("root"))


def crc32_mod(column: Column, by: int) -> Column:
    """crc32 of a value's text, modulo ``by``; null for null."""
    return F.crc32(column.cast("string")) % by
