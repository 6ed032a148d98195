"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "helixmart", cpus: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the given one.

    Adaptive execution picks join strategies from measured sizes, splits skewed
    partitions and merges small ones, so the partition count is only a start.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HELIX_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(folder or _own_folder(spark, "ckpt"))
    return df.checkpoint()


def task_count(spark: SparkSession) -> int:
    """Tasks for steps that compute much on few bytes, which adaptive execution would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that tasks share: below ``spark.checkpoint.dir`` where it is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return _own_folder(spark, name)


def _own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, which only a local session may use."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"helixmart-{name}-")
