"""Access to the parquet tables and to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only where none is configured.

    ``spark.checkpoint.dir`` is read from the session first, then a folder set on the context.
    A local temporary folder is used solely in local mode without either.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sentrymill-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later uses neither recompute nor lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, otherwise ``df`` as it is.

    The count stops after ``max_rows + 1`` rows. Beyond the bound Spark plans the join by itself.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_rows(df: DataFrame, max_rows: int = 10_000) -> list:
    """Rows of a fixed catalog table on the driver; raises if it is larger than its documented bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a catalog table has more than {max_rows} rows")
    return rows


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_MOVING = {"Join", "Aggregate", "Sort", "Window", "Distinct", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Deduplicate", "Intersect", "Except", "GlobalLimit"}


def _moves_rows(plan) -> bool:
    """Whether a logical plan has a node that exchanges rows."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        if node.nodeName() in _MOVING:
            return True
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return False


def spread(df: DataFrame) -> DataFrame:
    """``df`` repartitioned to the cores at hand if it is a plain scan of fewer partitions, before costly work per row.

    A plan that already exchanges rows is left alone, since counting its partitions could run it. On
    inputs of more partitions than cores nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _moves_rows(df._jdf.queryExecution().optimizedPlan()):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
