"""Session settings and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def get_session(app: str = "assayframe", **settings: str) -> SparkSession:
    """A session with the settings the library is written for; pass others as keywords with _ for the dots."""
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    conf |= {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of every executor, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_assayframe_shipped", False):
        return
    where = os.path.join(tempfile.mkdtemp(prefix="assayframe-"), "assayframe.zip")
    with zipfile.ZipFile(where, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(ROOT)))
    context.addPyFile(where)
    context._assayframe_shipped = True
