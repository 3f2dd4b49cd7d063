"""Written intermediates in the folder that driver and executors share.

A table of written() is deleted once nothing can read it any more: as Spark's own cleaner does for shuffles, a weak
reference follows the table's relation, which every DataFrame derived from the table keeps alive. So results that
have not been read yet keep what they need, whoever else runs jobs in the same application."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where that is unset and driver and executors are one process (tests)."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: path -> (application, weak reference to the relation) of the tables that written() has made and nobody has deleted.
_made: dict[str, tuple] = {}
_lock = threading.Lock()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it outlives executors and cuts the lineage."""
    spark = df.sparkSession
    sweep(spark)
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    relation = out._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    with _lock:
        _made[path] = (spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.ref.WeakReference(relation))
    out.scratch_path = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of written() that nothing reads any more."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        with _lock:
            _made.pop(path, None)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def sweep(spark: SparkSession, collect: bool = False) -> None:
    """Deletes the tables of written() that no DataFrame can read any more; collect: looks for garbage first."""
    if collect:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    app = spark.sparkContext.applicationId
    with _lock:
        for path in [p for p, (a, _) in _made.items() if a != app]:
            del _made[path]
        mine = list(_made.items())
    delete(spark, [path for path, (_, ref) in mine if ref.get() is None])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
