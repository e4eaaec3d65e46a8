"""What a session needs so that its Python workers can run this library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, unless their path already names its folder."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_halyard_shipped", False):
        return
    own = tempfile.mkdtemp(prefix="halyard-package-")
    atexit.register(shutil.rmtree, own, True)
    sc.addPyFile(shutil.make_archive(f"{own}/halyard", "zip", _ROOT, "halyard"))
    sc._halyard_shipped = True
