"""Session helpers: a local session for tests/bench and lineage cutting.

On a cluster the session comes from the platform; the library never changes
its settings.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` (or the folder
the caller gave to ``setCheckpointDir``) and makes a scratch folder only for a
``local`` master without either; elsewhere it raises.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(
    master: str | None = None,
    app_name: str = "kwhlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings this engine is tested with."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders made for local sessions, by application id.
_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A folder that is set (by ``spark.checkpoint.dir`` when the session began, or by
    the caller's ``SparkContext.setCheckpointDir``) is kept, else the setting is
    read and set.  A ``local``
    session without both (tests) gets a scratch folder of its own; any other
    session without both raises ``ValueError``, because executors do not see
    the driver's local disk.
    """
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir():
        return folder
    if named := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="kwhlens-ckpt-")
    sc.setCheckpointDir(_LOCAL_FOLDERS[app])
    return sc.getCheckpointDir()


class Scratch:
    """Intermediate Parquet tables of one computation in the shared folder.

    ``table`` writes and rereads a frame (a lineage cut that survives lost
    executors); ``drop`` removes one table; leaving the ``with`` block removes
    all of them.  Use the block only around work that is finished inside it.
    """

    def __init__(self, spark: SparkSession, label: str = "kwhlens"):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    """Cut lineage of a reused intermediate.

    ``checkpoint`` writes to the shared checkpoint folder (survives executor
    loss); ``table`` writes a Parquet table into that folder (same guarantee,
    columnar); ``cache`` keeps blocks in executor memory (recomputed from lineage
    if an executor is lost); ``none`` returns ``df`` unchanged.
    """
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "table":
        return Scratch(df.sparkSession).table(df, "t")
    if how == "cache":
        return df.cache()
    if how == "none":
        return df
    raise ValueError(f"unknown materialize mode: {how}")
