"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS, BATCH_BYTES = "2000", "8388608"
_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context, and bound the Arrow batches of texts that a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if not getattr(sc, "_ragloom_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="ragloom-")) / "ragloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(_ROOT.rglob("*.py")):
                z.write(f, f.relative_to(_ROOT.parent))
        sc.addPyFile(str(path))
        sc._ragloom_shipped = True
    return spark
