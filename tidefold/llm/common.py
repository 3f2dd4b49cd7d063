"""What the operators share: tables, written intermediates, and the package on its way to the workers."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.storage import delete, read_table, shared_dir, sweep, written

__all__ = ["delete", "read_table", "shared_dir", "ship", "small_table", "sweep", "written"]



_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless the path that they inherit has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    application = spark.sparkContext.applicationId
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or application in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tidefold.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "tidefold")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few driver-side rows as plain SQL: a JSON literal that is inlined."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
