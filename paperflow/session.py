"""What a session's Python workers need."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def reachable(spark: SparkSession) -> None:
    """Python workers can import this package: from where the driver has it in one machine, from an archive that Spark ships on a cluster."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *paths])
    if context.master.startswith("local[") or context.master == "local" or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="paperflow-package-")) / "paperflow.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "paperflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
