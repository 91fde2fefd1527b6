"""Intermediate tables in the shared folder that the session names.

``cut`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads it back, so that a
lost executor never forces work before the cut to run again and the plan after it starts from files.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where all of Spark is one process and the session names no folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints/lodestrata"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = DEFAULT_DIR
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark)}/lodestrata-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        if len(_ROOTS) == 1:
            atexit.register(_drop_roots)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_ROOTS: dict[str, SparkSession] = {}


def _drop_roots() -> None:
    for root, spark in _ROOTS.items():
        try:
            remove(spark, root)
        except Exception:  # the session is already gone; the folder is the cluster's to clean
            pass


def apart(columns: list[str]) -> str:
    """A prefix for columns of an operator's own that makes none of these names."""
    return "_" * max(map(len, columns), default=0) + "_"


#: Bytes of an Arrow batch; the engine's 64 MB stand in the JVM, in a pipe and in a worker at once, for each task.
BATCH_BYTES = 8 * 1024 * 1024
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a smaller bound."""
    now = spark.conf.get(_BATCH, None)
    if now is None or int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """The scratch tables of one operator call; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.paths: dict[str, str] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)
