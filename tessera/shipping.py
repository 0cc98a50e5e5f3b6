"""Let the executors' Python import this package, and folders that they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Where shared folders go if a local session names none.
OWN_FOLDER = "file:///tmp/checkpoints"

#: Rows that go to Python at once, unless the session says otherwise: texts are long, and a worker holds some batches.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's source to the executors through Spark's own file server, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor sees, below spark.checkpoint.dir; it goes when the application ends.

    A cluster must name that folder: a machine's own would hold each executor's part on its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = OWN_FOLDER
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}")
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(held)
    files.deleteOnExit(held)
    return f"{held.toString()}/{name}"
