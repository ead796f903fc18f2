"""Brings this package to the executors' Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package, zipped, to the session's Python files; once per session.

    Planners of streams are Python processes beside the driver that look for those files in another folder: they find the package by its path here.
    """
    context = spark.sparkContext
    if getattr(context, "_litscout_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="litscout-zip-")
    try:
        kept = os.path.join(folder, "tree", os.path.basename(here))
        shutil.copytree(here, kept, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "litscout"), "zip", os.path.dirname(kept)))
    finally:
        shutil.rmtree(os.path.join(folder, "tree"), True)
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file as long as it lives
    paths = [os.path.dirname(here), *filter(None, context.environment.get("PYTHONPATH", "").split(os.pathsep))]
    context.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    context._litscout_shipped = True
