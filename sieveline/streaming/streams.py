"""Files and scans that keep arriving: the batch operators behind Structured Streaming.

The reference polls; here a directory is a stream. Matching is stateless, counts are windowed with a watermark, and the
keyed state of folders is merged batch by batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.history import DIRECTORIES, directories, upsert
from sieveline.operators.match import find_matches
from sieveline.session import remove
from sieveline.sources.files import lines


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def match_stream(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of arriving files: join 1 without state, since the rules are a static, broadcast side."""
    return find_matches(lines(files, "file_id", "path", "language"), rules)


def counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; what is later than the watermark is left out, so the state stays bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), key, "events")


def run(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Run what is there into a table in memory and stop: for tests and small sinks."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query


def upsert_directories(scans: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the folder table (sink 3) current: each batch is aggregated, merged and written as a new version
    beside the older ones, so neither a reader nor a repeated batch meets half a table."""
    spark = scans.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        current = read_directories(spark, target, before=number)
        upsert(current, directories(batch)).write.mode("overwrite").parquet(f"{target}/v{number}")
        # A repeated batch reads the version before it, a reader may still read that one; what is older goes.
        for old in _versions(spark, target):
            if old < number - 1:
                remove(spark, f"{target}/v{old}")

    query = scans.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [os.path.basename(s.getPath().toString()) for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def read_directories(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The newest complete version of the folder table (older than batch `before`)."""
    found = [v for v in _versions(spark, target) if before is None or v < before]
    return spark.read.schema(DIRECTORIES).parquet(f"{target}/v{max(found)}") if found else spark.createDataFrame([], DIRECTORIES)


def progress_of(query: StreamingQuery) -> list[dict]:
    """What each batch of a query has read and how fast (projection 25): for the console, not a data operator."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]} for p in query.recentProgress]
