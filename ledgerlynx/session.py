"""Session defaults and the shared folder for stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Recording the Python call site of every column costs more than building it,
#: which shows with plans of several hundred expressions.
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def local_session(app: str = "ledgerlynx", cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(CALL_SITES, "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the cluster.

    Only a local session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    directory = spark.conf.get("spark.checkpoint.dir", None) or _fallback.get(sc.applicationId)
    if not directory:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        directory = _fallback[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return directory


_fallback: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (not created)."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every intermediate table stored inside it.

    Results that are still wanted must be written before the block ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a parquet table below the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    ``df`` again, and several readers share one run of it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
