"""Session helpers: configuration used in tests and benches, tables, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 4, partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benches. On a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomspan")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "loomspan-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return _with_plain_size(df.checkpoint(eager=True))


def _with_plain_size(df: DataFrame) -> DataFrame:
    """The same cut rows without a size estimate, where that has outgrown any real size.

    A cut table keeps the estimate of the plan it came from. In loops of joins estimates multiply at each round
    until planning spends its time on numbers of millions of digits.
    """
    plan = df._jdf.queryExecution()
    if int(plan.analyzed().stats().sizeInBytes()) < 1 << 60:
        return df
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), df.sparkSession)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
