"""Session helpers: a local session, the shared scratch folder, code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[int, str] = {}


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of a batch that goes to Python, where the session has Spark's own 10,000: rows hold whole texts.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    sc = spark.sparkContext
    name, usual, ours = BATCH_ROWS
    if spark.conf.get(name) == usual:
        spark.conf.set(name, ours)
    if _SHIPPED.get(id(sc)) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rankloom-")) / "rankloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED[id(sc)] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, as in tests, one of our own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = os.environ.get("RANKLOOM_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        os.environ["RANKLOOM_SHARED_DIR"] = path
        sc.setCheckpointDir(path)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


_WRITTEN: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str, keep: bool = True) -> str:
    """A new path under the shared folder; what is written there goes with the process unless it is to be kept."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _WRITTEN[path] = spark
    return path


def clear_scratch() -> None:
    """Delete the scratch tables of this process; frames that read them are then of no use."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, S110  the session is gone, and its scratch folder is the cluster's to clear
            pass


atexit.register(clear_scratch)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name, keep=False)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
