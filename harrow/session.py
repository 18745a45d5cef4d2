"""Session helpers for tests, bench and local runs."""
from __future__ import annotations

import os
import tempfile
import warnings

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "harrow",
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A session on this machine alone, for tests and benchmarks; its checkpoint folder is a scratch folder."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HARROW_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="harrow-checkpoints-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for intermediate tables, which driver and executors must share.

    It is ``spark.checkpoint.dir`` of the session, else the context's checkpoint
    folder, else ``folder``.  On a cluster one of them has to be given; a session
    on one machine gets a scratch folder, and a warning that says so.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or folder
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="harrow-checkpoints-")
        warnings.warn(f"spark.checkpoint.dir is not set; intermediate tables go to {d}", stacklevel=2)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d
