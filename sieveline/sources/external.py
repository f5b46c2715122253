"""Results of other scanners and stored reports as findings (source 12; projections 13 to 16; composition X1; join 16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.severity import first_of, normalize, or_else
from sieveline.functions.text import absolute, fingerprint, location

NO_DETAILS, NO_SNIPPET = "No description available", "Content unavailable"


def results(docs: DataFrame, payload: str = "payload", at: str = "$.results") -> DataFrame:
    """One row per result of a result document: its columns beside `r`, a VARIANT, and its position."""
    held = docs.withColumn("_v", F.try_parse_json(payload)).filter("_v is not null")
    entries = held.withColumn("_a", F.expr(f"try_variant_get(_v, '{at}', 'array<variant>')"))
    return entries.select("*", F.posexplode("_a").alias("pos", "r")).drop("_v", "_a", payload)


def from_external(rows: DataFrame, folder: str = "/", owasp: str = "first") -> DataFrame:
    """Result rows (with r) as findings. owasp text: lists give none, as one of the loaders does (trap 10)."""
    text = lambda p: F.expr(f"try_variant_get(r, '{p}', 'string')")
    whole = lambda p: F.expr(f"try_variant_get(r, '{p}', 'bigint')")
    base = rows.select(
        *[c for c in rows.columns if c != "r"],
        text("$.check_id").alias("rule_id"),
        absolute(text("$.path"), folder).alias("path"),
        normalize(F.coalesce(text("$.extra.severity"), text("$.severity")), "external").alias("severity"),
        whole("$.start.line").alias("line_number"),
        whole("$.start.col").alias("column_number"),
        or_else(text("$.message"), text("$.extra.message"), F.lit(NO_DETAILS)).alias("details"),
        or_else(text("$.extra.lines"), F.lit(NO_SNIPPET)).alias("code_snippet"),
        first_of("r", "$.extra.metadata.cwe").alias("cwe_id"),
        first_of("r", "$.extra.metadata.owasp", owasp).alias("review_guidance"),
        F.coalesce(text("$.extra.metadata.confidence"), F.lit("MEDIUM")).alias("confidence"),
    )
    placed = base.withColumn("location", location(F.col("path"), F.col("line_number"), F.col("column_number")))
    return placed.withColumn("dependency_file", fingerprint(F.col("rule_id"), F.col("location")))


def report_statistics(reports: DataFrame, payload: str = "payload") -> DataFrame:
    """files_processed and vulnerabilities_found of reports: statistics first, the summary where they lack (join 16)."""
    v = reports.withColumn("_v", F.try_parse_json(payload))
    pick = lambda *ps: F.coalesce(*(F.expr(f"try_variant_get(_v, '{p}', 'bigint')") for p in ps))
    return v.withColumns({
        "files_processed": pick("$.statistics.files_processed", "$.summary.files_processed"),
        "vulnerabilities_found": pick("$.statistics.vulnerabilities_found", "$.summary.total_vulnerabilities"),
        "scan_duration": pick("$.statistics.scan_duration"),
    }).drop("_v", payload)
