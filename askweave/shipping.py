"""The package on the workers, where they could not import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session, send the package to the workers, unless their PYTHONPATH, which is the driver's, has it."""
    root = os.path.realpath(os.path.dirname(_PACKAGE))
    if any(p and os.path.realpath(p) == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        folder = tempfile.mkdtemp(prefix="askweave-")
        shutil.copytree(_PACKAGE, f"{folder}/src/askweave", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/askweave", "zip", f"{folder}/src"))
        shutil.rmtree(f"{folder}/src")
