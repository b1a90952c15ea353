"""Incremental ingest with Structured Streaming: each micro-batch is merged into the state of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators import ingest


class State:
    """A table kept as versions: folders of Parquet, each marked once it is whole. One writer.

    Folders and marks stand in any file system that Hadoop knows; the newest marked version counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def version(self) -> int:
        fs, path = self._folder("marks")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=-1) if fs.exists(path) else -1

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v >= 0 else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, path = self._folder(f"marks/{version}")
        fs.create(path).close()


def ingest_stream(documents: DataFrame, state: State, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Starts a stream that keeps the newest version of each document; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        if state.version() >= epoch:
            return
        old = state.read()
        rows = batch if old is None else old.unionByName(batch)
        state.write(ingest.latest(rows, keys, [F.desc(version), *[F.desc(c) for c in sorted(set(batch.columns) - {version, *keys})]]), epoch)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by type in windows of event time; rows later than the watermark are dropped when streaming."""
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
