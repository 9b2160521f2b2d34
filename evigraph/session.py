"""Session defaults and lineage cuts.

``checkpoint`` is the only way the library cuts lineage: it writes to the folder the
cluster names in ``spark.checkpoint.dir`` (shared by all executors). Only where that
setting is absent, as in local tests, a temporary folder is used.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("evigraph")
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only if none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "evigraph-checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return a reader of the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Plans run within join by shuffles, so that no table passes through the driver.

    Every small table that a plan broadcasts by itself takes pages of the driver's heap and a thread;
    a job of dozens of joins fills it so. The session's settings are put back.
    """
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer partitions than cores, spread over all of them before a CPU-bound Python stage.

    Such an input is a few small files; anything larger stays as it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the session's Python workers, once per application."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="evigraph-")  # on the driver only; executors fetch the archive from it
        stage = os.path.join(folder, "stage")
        shutil.copytree(os.path.join(root, "evigraph"), os.path.join(stage, "evigraph"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "evigraph_package"), "zip", stage))
        _SHIPPED.add(sc.applicationId)
    return spark
