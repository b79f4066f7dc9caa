"""What Python workers need of a session."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows an Arrow batch may hold; with texts of 100 KB a batch stays near 50 MB.
BATCH_ROWS = 512
#: Bytes an Arrow batch may hold where Spark offers that limit.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_profilis_shipped", False):
        return
    package = Path(__file__).resolve().parent
    files = sorted(package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="profilis-")), f"profilis-{digest}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(path)
    context._profilis_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for Python workers when texts are long; ship the package.

    Both limits are settings of the session, as Spark offers no other place for them; every
    operator with Python workers asks for the same, so none depends on which ran before.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
