"""Spark session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .sources.shared import small_batches

_ROOT = Path(__file__).resolve().parent


def session(app: str = "pagesieve", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; master and shuffle partitions only where given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package through Spark's file server, once per application, and small batches."""
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_pagesieve_shipped", False):
        return
    # the file server offers this very file, so it lies in the context's own folder, which goes with it
    archive = os.path.join(tempfile.mkdtemp(dir=context._temp_dir), "pagesieve.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(archive)
    context._pagesieve_shipped = True
