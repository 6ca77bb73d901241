"""Session defaults and the shared working folder."""

from __future__ import annotations

import importlib
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession

#: Settings the results or the skew handling depend on; all can be set at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def ship_package() -> None:
    """Send this package's functions along with each task, so workers need no copy of it."""
    register_pickle_by_value(importlib.import_module(__package__))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package()
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, bytes_per_partition: int = 128 << 20) -> int:
    """Set the number of shuffle partitions for an input of this size.

    Adaptive execution only merges partitions, so this is the upper end: 200, the
    default, would leave half a terabyte in each for an input of 100 TB.
    """
    cores = spark.sparkContext.defaultParallelism
    partitions = max(cores, -(-input_bytes // bytes_per_partition))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


def build_session(app: str = "chatstream", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package()
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach, under ``spark.checkpoint.dir``; it goes when the application ends.

    Only a local session without that setting falls back to the machine's own
    temporary folder; a cluster session without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{_run_folder(spark, root)}/{purpose}-{uuid.uuid4().hex}"


#: The folder of each application under each root.
_RUN_FOLDERS: dict[tuple[str, str | None], str] = {}


def _run_folder(spark: SparkSession, root: str | None) -> str:
    """One folder for all that an application stores; it goes when the driver's JVM ends."""
    run = (spark.sparkContext.applicationId, root)
    if run not in _RUN_FOLDERS:
        root = root or tempfile.mkdtemp(prefix="chatstream-")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/chatstream-{run[0]}")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _RUN_FOLDERS[run] = folder.toString()
    return _RUN_FOLDERS[run]


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder and read it back.

    The steps then start from files instead of computing it again, and a lost
    executor costs nothing that is already written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
