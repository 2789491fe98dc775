"""Cutting lineage with tables in the shared checkpoint folder."""

import tempfile
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only for a local session without any."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Survives lost executors, ends the lineage of iterative jobs, keeps column pruning, and gives later
    joins a real size to plan with.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_all(dfs: Sequence[DataFrame], name: str) -> list[DataFrame]:
    """``settle`` several tables at the same time, so that small ones do not wait for each other's last task."""
    checkpoint_root(dfs[0].sparkSession)
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(lambda df: settle(df, name), dfs))
