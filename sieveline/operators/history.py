"""Scans over time: appended rows, keyed state, latest state, stores (sinks 2 to 4, 10, 11; aggregation 13; order 4; filters 5, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCANS = "scan_id string, source_directory string, files_processed int, vulnerabilities_found int, duration_ns bigint, scanned_at string"
DIRECTORIES = "directory string, first_scan string, last_scan string, scan_count bigint"


def ensure(spark: SparkSession, path: str, schema: str) -> None:
    """Create an empty table where there is none (sink 4)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], schema).write.parquet(path)


def append_scans(scans: DataFrame, path: str) -> None:
    """Add rows to the scan table (sink 2)."""
    scans.write.mode("append").parquet(path)


def instant(text: str = "scanned_at"):
    """A text time stamp as an instant; the text itself stays for those who order by it (trap 7)."""
    return F.expr(f"try_cast({text} as timestamp)")


def history(scans: DataFrame, as_text: bool = False) -> DataFrame:
    """Latest first (order 4): by instant, or by text as the table's reader does; durations in ns and in seconds (trap 8)."""
    rows = scans.withColumn("scanned", instant()).withColumn("duration_s", F.round(F.col("duration_ns") / 1e9, 3))
    return rows.orderBy(F.desc_nulls_last("scanned_at" if as_text else "scanned"), "scan_id")


def directories(scans: DataFrame, directory: str = "source_directory") -> DataFrame:
    """First scan, last scan and number of scans per folder (aggregation 13)."""
    at = F.struct(instant().alias("t"), F.col("scanned_at").alias("x"))
    per = scans.filter(f"{directory} is not null").groupBy(F.col(directory).alias("directory")).agg(F.min(F.when(instant().isNotNull(), at)).alias("a"), F.max(F.when(instant().isNotNull(), at)).alias("z"), F.count("*").alias("scan_count"))
    return per.select("directory", F.col("a.x").alias("first_scan"), F.col("z.x").alias("last_scan"), "scan_count")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert of directory rows (sink 3): known folders keep their first scan, take the later last one, add counts."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.directory") == F.col("b.directory"), "full_outer")
    later = F.when(F.expr("try_cast(b.last_scan as timestamp) >= try_cast(a.last_scan as timestamp) or a.last_scan is null"), F.col("b.last_scan")).otherwise(F.col("a.last_scan"))
    return both.select(F.coalesce("a.directory", "b.directory").alias("directory"), F.coalesce("a.first_scan", "b.first_scan").alias("first_scan"), F.coalesce(later, F.col("b.last_scan")).alias("last_scan"), (F.coalesce("a.scan_count", F.lit(0)) + F.coalesce("b.scan_count", F.lit(0))).alias("scan_count"))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest state per key of a log (sink 11): a struct maximum, combined before the shuffle."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")


def status_changes(events: DataFrame, status: str, at: str) -> DataFrame:
    """The log with an end time on the final states only (sink 11)."""
    return events.withColumn("end_time", F.when(F.upper(status).isin("COMPLETED", "FAILED"), F.col(at)))


def of_key(rows: DataFrame, key: str, value) -> DataFrame:
    """Point look-up (filters 5, 8 and 9); no row stands for 'not found'. A filter, so it reaches the scan."""
    return rows.filter(F.col(key) == value)


def delete_cascade(jobs: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str = "job_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Jobs without the given ones, and their children without the children of those (sink 10)."""
    keys = gone.select(key).distinct()
    return jobs.join(keys, key, "left_anti"), {name: rows.join(keys, key, "left_anti") for name, rows in children.items()}


def status_of(states: DataFrame, reports: DataFrame, alive: DataFrame) -> DataFrame:
    """(scan_id, status, report_available) of every scan with a state or a report.

    states: (scan_id, status), the latest. One that is running but not among the alive ones has failed; a scan without a
    state that has a report is completed.
    """
    told = states.select("scan_id", F.upper("status").alias("status"))
    both = told.join(reports.select("scan_id").distinct().withColumn("_reported", F.lit(True)), "scan_id", "full_outer").join(alive.select("scan_id").distinct().withColumn("_alive", F.lit(True)), "scan_id", "left")
    status = F.when(F.col("status").isNull(), F.when(F.col("_reported"), "COMPLETED")).when((F.col("status") == "RUNNING") & F.col("_alive").isNull(), "FAILED").otherwise(F.col("status"))
    return both.filter("status is not null or _reported").select("scan_id", status.alias("status"), (status == "COMPLETED").alias("report_available"))


def started(requests: DataFrame, at) -> DataFrame:
    """The rows that open the log of scans just asked for (X17): scan_id, source_directory, start, STARTED, nothing found yet.

    requests: scan_id (fresh_id() where it is new), source_directory; one without a folder scans the current one.
    """
    return requests.select("scan_id", F.coalesce("source_directory", F.lit(".")).alias("source_directory"), at.alias("start_time"), F.lit("STARTED").alias("status"), F.lit(0).alias("files_processed"), F.lit(0).alias("vulnerabilities_found"))


def recent(scans: DataFrame, created: str = "scanned_at") -> DataFrame:
    """(id, status, created) of scans."""
    return scans.select(F.col("scan_id").alias("id"), "status", F.col(created).alias("created"))
