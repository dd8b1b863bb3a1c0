"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *folders: str) -> None:
    """Send package folders (this one by default) to all executors, once for each application.

    Not needed where the package is installed there or passed with ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    folders = tuple(f for f in folders or (os.path.dirname(os.path.abspath(__file__)),) if (app, f) not in _shipped)
    if not folders:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="driftloom-"), "_".join(os.path.basename(f) for f in folders) + ".zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder in folders:
            root = os.path.dirname(folder)
            for base, _, names in os.walk(folder):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(base, name)
                        archive.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.update((app, folder) for folder in folders)
