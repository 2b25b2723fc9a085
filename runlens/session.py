"""Session helpers.

Cluster settings (shuffle partitions, checkpoint dir, AQE) come from the
session the caller provides; ``get_session`` only fills in local defaults for
tests and the bench, and ``checkpoint_dir`` reads ``spark.checkpoint.dir``
first so jobs cut lineage in the shared folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, app: str = "runlens", **conf: str) -> SparkSession:
    """Return the active session or build a local one with test defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("RUNLENS_MASTER", "local[8]"))
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset (tests)."""
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    ) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        # local runs and tests only: a scratch folder on this machine
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local
    temp dir on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/runlens-scratch/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make ``runlens`` importable in Python workers (once per context): the
    package is zipped and added with ``addPyFile``, which distributes it to
    every executor."""
    import os
    import uuid
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_runlens_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # the zip is built on the driver and served to executors by Spark itself
    local_zip = os.path.join(tempfile.mkdtemp(prefix="runlens-pkg-"), f"runlens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(local_zip, "w") as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(local_zip)  # Spark copies it to every executor
    sc._runlens_shipped = True
