"""Session defaults and the shared folder that survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the engine's defaults, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("netweave")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the driver is the only machine, as in tests, it is one of our own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "netweave-checkpoints"))
    return context.getCheckpointDir()


@lru_cache(maxsize=8)
def _own_folder(folder: str, application: str) -> str:
    """A folder for one application's tables, which goes when it ends."""
    path = f"{folder}/netweave-{application}"
    atexit.register(_delete, path)
    return path


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_own_folder(shared_folder(spark), spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def brief_plans(spark: SparkSession, length: int = 8192) -> Iterator[None]:
    """The driver keeps the text of every plan that has run; those of wide frames
    are long, and long loops run many. In here only so many characters of each are
    kept, and the shuffle files of a write go when it ends: else they lie there
    until the next one has run and the driver has collected its garbage."""
    names = {"spark.sql.maxPlanStringLength": str(length), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame, label: str = "stored", collect: bool = True) -> DataFrame:
    """df as a compressed table in the shared folder, which cuts its lineage: a
    lost executor costs what came after it. With collect the driver then collects its
    garbage, since Spark keeps the shuffle files of what is written until that
    happens."""
    path = shared_path(df.sparkSession, label)
    with brief_plans(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if collect:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Like stored, for frames that are small. A table also leaves behind what the
    optimiser has inferred, which in loops grows with every round and which a
    checkpoint would carry on."""
    return stored(df, "cut", collect=False)


def release(df: DataFrame) -> None:
    """Delete the table that stored or cut has written, which nothing may read any more."""
    for path in {os.path.dirname(file) for file in df.inputFiles()}:
        _delete(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
