"""Session helpers for tests, the bench and local runs.

Library code never sets cluster configuration; it reads what the session has.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "demandlens") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", "8g")
             # call-site capture for error messages costs ~1 ms per DataFrame call
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the evaluation plans need in any session.

    The feature stage projects ~60 aliased columns through several layers;
    Catalyst's constraint propagation (inferring IsNotNull filters through
    every alias) grows combinatorially on such plans and can take minutes
    to plan a one-second job.  It only adds inferred filters, so turning it
    off changes no result.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.
    Only a local master may leave it unset: a scratch folder is created there.
    On a cluster a machine-local folder would lose data, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = configured or tempfile.mkdtemp(prefix="demandlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``demandlens`` importable in Python workers, which on a cluster do
    not have this repository: zip the package once per application and hand
    it to ``addPyFile`` (Spark distributes it to every executor)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="demandlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint
    folder and reading it back.  Unlike an RDD checkpoint, the result keeps
    file statistics (so Catalyst/AQE can size joins against it) and column
    pruning; like it, it survives executor loss."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
