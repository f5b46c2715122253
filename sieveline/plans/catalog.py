"""The named queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.operators import nested, report
from sieveline.plans import graphs, ranges, reports, scan

MODULES = (scan, reports, graphs, ranges, nested)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files have which findings, worst first: the whole catalogue over the source files."""
    found = scan.catalogue_findings(spark, sf_dir)
    return report.ranked(found, "rule_id", "path", "line_no", "column_no").select("path", "rule_id", "severity", "line_no", "column_no", "matched", "dependency_file")
