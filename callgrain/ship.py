"""Making the package importable in Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the Spark context, once per context."""
    context = spark.sparkContext
    if getattr(context, "_callgrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="callgrain-package-")) / "callgrain_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    # the driver-side runner of stateful streaming reads the path from the environment, not from added files
    known = context.environment.get("PYTHONPATH", "")
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(target), known]))
    context._callgrain_shipped = True
