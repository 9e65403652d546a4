"""Makes this package importable in Python workers, wherever the session's executors are."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip archive to the application, once for each."""
    context = spark.sparkContext
    if context.applicationId not in _DONE:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tesserae-")) / "tesserae-package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(top.rglob("*.py")):
                out.write(f, f.relative_to(top.parent))
        context.addPyFile(str(path))
        _DONE.add(context.applicationId)
    return spark
