"""Make the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once.

    The driver serves the archive for as long as it lives, so it is deleted at exit.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="quern-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder) / "tree" / "quern"
    shutil.copytree(root / "quern", copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/quern_files", "zip", copy.parent))
    _shipped.add(sc.applicationId)
