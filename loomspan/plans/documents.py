"""Chunking, extraction and streaming queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from loomspan.functions import chunkers, text
from loomspan.session import shared_folder, table
from loomspan.streaming import ingest as stream


def _chunks(kind):
    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").where("content is not null")
        wanted = {"prose": "corpus_class <> 'code' and not content like '#%'", "markdown": "corpus_class <> 'code'", "code": "corpus_class = 'code'"}[kind]
        out = chunkers.chunk_documents(d.where(wanted), "doc_id", "content", F.lit(kind), text.extension(F.col("uri")))
        return out.select("doc_id", "ord", F.sha2("chunk", 256).alias("sha"), "heading", "char_start", "char_end", "chunker")

    return run


def chunk_paragraphs(spark, sf_dir):
    """Blank-line paragraphs with their offsets, in SQL functions only."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n\n").alias("ps"))
    lengths = F.transform("ps", lambda p: F.length(p) + 2)
    starts = F.transform(F.sequence(F.lit(0), F.size("ps") - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))
    return d.select("doc_id", F.posexplode(F.arrays_zip(F.col("ps").alias("p"), starts.alias("s"))).alias("ord", "z")).select("doc_id", "ord", F.col("z.s").alias("char_start"), (F.col("z.s") + F.length("z.p")).alias("char_end"))


def stream_event_windows(spark, sf_dir):
    """An extension: events read as a stream, counted in windows of event time under a watermark.

    Each batch writes only the windows it changed; of a window the newest batch counts. Both state and output
    stand in the folder of the session's checkpoints, which all executors share.
    """
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(schema)
    events = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{work}/out/part-{batch}")
    query = stream.event_windows(events, late="3650 days").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", work + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(work + "/out")
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("w"))
    return last.select(F.unix_micros("start").alias("start"), "event_type", "w.n", F.round("w.total", 4).alias("total"))


QUERIES = {"chunk_prose": _chunks("prose"), "chunk_markdown": _chunks("markdown"), "chunk_code": _chunks("code"), "chunk_paragraphs": chunk_paragraphs, "stream_event_windows": stream_event_windows}
ORACLES = {
    "chunk_paragraphs": "WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ord, unnest(ps) AS p FROM p), s AS (SELECT doc_id, ord, length(p) AS n, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM u) SELECT doc_id, ord::INTEGER AS ord, char_start::INTEGER AS char_start, (char_start + n)::INTEGER AS char_end FROM s",
    "stream_event_windows": "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
