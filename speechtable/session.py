"""Sessions, and the library's code on executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

_SHIPPED: dict[str, str] = {}
_LOCAL: list[str] = []
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one of this machine, for a
    local master alone: on a cluster each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="speechtable-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of this application, in the shared folder. clean() deletes all of them."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once the results that rest on them are written."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of the session's executors, once per application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _SHIPPED:
            root = Path(__file__).resolve().parent
            path = os.path.join(tempfile.mkdtemp(prefix="speechtable-"), "speechtable.zip")
            with zipfile.ZipFile(path, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, str(p.relative_to(root.parent)))
            spark.sparkContext.addPyFile(path)
            _SHIPPED[app] = path
    return spark


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a Python data source known to the session, and the session the active one of this thread: formats in Python are
    looked up in the active session alone, which only the thread that built the session has."""
    spark.dataSource.register(source)
    spark.createDataFrame([], "nothing int")  # makes it active


def local_session(cores: str = "*", memory: str = "4g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("speechtable")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
