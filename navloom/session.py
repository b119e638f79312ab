"""Session settings and lineage control."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "navloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; only a local session gets its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="navloom-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    Used between rounds of an iterative operator: the plan stays short, the next round sees
    real sizes, and a lost executor costs a re-read instead of all earlier rounds. A table is
    used because a checkpointed plan keeps the constraints of all rounds before it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session; they needn't share the driver's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_navloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='navloom-ship-')}/navloom", "zip", root, "navloom")
    sc.addPyFile(archive)
    sc._navloom_shipped = True
