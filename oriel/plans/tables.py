"""Written tables that end a lineage, for iterative plans, and the shared folder that holds them."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine (a ``local`` master) whose session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"

#: Folders that ``written`` made and that still stand, in order.
_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; on a cluster it must be set."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        value = LOCAL_SHARED
    return value.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed by ``drop_folders``, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/oriel-{name}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


#: Whether Spark removes the shuffle files of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage and its shuffle files end there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder; also after its session was stopped, while the JVM runs."""
    context = spark.sparkContext._jsc
    conf = context.hadoopConfiguration() if context is not None else spark._jvm.org.apache.hadoop.conf.Configuration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/oriel-" in path:
            delete_path(spark, path)


def folder_mark() -> int:
    """How many folders stand, for ``drop_folders`` to go back to."""
    return len(_FOLDERS)


def drop_folders(mark: int = 0, keep: int = 0) -> None:
    """Delete all folders made since ``mark`` but for the last ``keep``; results that still read them end with this."""
    for spark, path in _FOLDERS[mark : len(_FOLDERS) - keep]:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  # the JVM has ended: nothing can be deleted through it
            break
    del _FOLDERS[mark : len(_FOLDERS) - keep]


atexit.register(drop_folders)
