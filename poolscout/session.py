"""Session helpers: shared scratch space, lineage cuts and broadcast gates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a side is never broadcast on request and a top-n is never gathered into one task.
SMALL_ROWS = 100_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not find it on their own path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='poolscout-')}/poolscout", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting gets a temporary
    folder; on a cluster a missing setting is an error, because a machine-local folder dies with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            current = tempfile.mkdtemp(prefix="poolscout-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all scratch tables and checkpoints made inside, deleted at the end::

        with scratch_scope(spark):
            near_duplicates(docs).write.parquet(out)

    What is to stay must be written elsewhere before the scope ends; a frame that is still to be computed would miss its files.
    """
    outer = shared_dir(spark)
    root = outer.rsplit("/", 1)[0]  # Spark makes a folder of its own below the one it is given
    own = f"{outer}/scope-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    try:
        yield shared_dir(spark)
    finally:
        spark.sparkContext.setCheckpointDir(root)
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_few_splits(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before heavy work per row. A large table has more splits than that
    and is not moved. Meant for plain scans, whose split count is known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint when the known row count is within the bound; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows <= bound else df
