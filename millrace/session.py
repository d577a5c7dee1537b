"""Session factory and the few session-wide settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution, Arrow and the RocksDB state store.

    ``master`` is left to ``spark-submit`` when not given.  Keyword arguments
    are settings with ``__`` for the dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return ship(builder.config(map=settings).getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where none is configured.

    A cluster names a folder shared by all executors in
    ``spark.checkpoint.dir``.  A temporary folder is used only in local mode.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
    sc.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder for what a query writes and reads again; it is removed when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its scan has less than half as many.

    For work that costs far more than moving its rows, on tables of few large
    row groups.  A table of many parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    if query.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # it shuffles already, and counting its partitions would run it
    return df.repartition(cores) if query.toRdd().getNumPartitions() * 2 <= cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the session's Python workers, wherever the driver found it.

    Spark's file server hands out a zip of the sources, once a session context.
    Not needed where the package is installed on every machine, and harmless
    there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", None) is None:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "millrace.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, Path(package.name) / p.relative_to(package))
        sc.addPyFile(str(target))
        sc._millrace_shipped = str(target)
    return spark
