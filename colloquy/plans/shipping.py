"""Sends the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, top: str) -> None:
    """Adds the package under `top` as a zip to the application, once; nothing to do where its path is shared already."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    folder = tempfile.mkdtemp(prefix="colloquy-")  # the driver serves it to executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "colloquy.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for within, _, names in os.walk(os.path.join(top, "colloquy")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(within, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
