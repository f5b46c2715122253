"""Findings as reports: counts, coverage, rankings, texts and documents (aggregations 1 to 12, 16; orders 1 to 8; sinks 1, 5, 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.severity import ORDER, rank
from sieveline.functions.text import category_key, category_name, rfc3339
from sieveline.session import small

# Totals of the standards, the report's version, the words that a complexity count looks for, the headings of
# a summary, and the recommendations (what is counted, priority, text, items).
OWASP_TOTAL, CWE_TOTAL = 10, 25
TOOL_VERSION = "1.0.0"
COMPLEXITY = ["if", "else", "for", "while", "switch", "case", "catch", "try"]
SUMMARY, DETAILS = "=== VULNERABILITY SCAN SUMMARY ===", "=== DETAILED FINDINGS ==="
RECOMMENDATIONS = [
    ("critical", "URGENT", "Address critical vulnerabilities immediately as they pose the highest risk", ["Review all CRITICAL severity findings", "Implement fixes following remediation guidance", "Conduct security review before deployment"]),
    ("high", "HIGH", "Address high severity vulnerabilities promptly", ["Review all HIGH severity findings", "Schedule fixes for next release", "Consider additional security testing"]),
    ("sql", "HIGH", "Implement SQL injection prevention measures", ["Use parameterized queries or prepared statements", "Implement ORM with built-in protection", "Conduct security training on SQLi risks"]),
    ("xss", "MEDIUM", "Implement XSS protection", ["Use output encoding for dynamic content", "Implement Content Security Policy (CSP)", "Validate and sanitize all user input"]),
    ("everything", "GENERAL", "Improve secure coding practices", ["Conduct security code reviews", "Implement static analysis in CI/CD pipeline", "Provide secure coding training for developers"]),
]
#: Rows that may travel to all tasks at most.
SMALL = 50_000


def file_of(location: Column) -> Column:
    """What stands before the first ':' of a location."""
    return F.element_at(F.split(location, ":"), 1)


def count_by(findings: DataFrame, column: str, name: str = "findings") -> DataFrame:
    """Findings per value (aggregations 1 to 3)."""
    return findings.groupBy(column).agg(F.count("*").alias(name))


def breakdown(findings: DataFrame, *columns: str) -> DataFrame:
    """Counts per value of several columns in one pass over the findings: (dimension, value, findings)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return findings.select(each.alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("findings"))


def totals(findings: DataFrame, location: str = "location") -> DataFrame:
    """Findings, files with findings, rules that fired, and counts per level (aggregations 3 to 5), as one row."""
    per_level = [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in ORDER]
    return findings.agg(F.count("*").alias("findings"), F.countDistinct(file_of(F.col(location))).alias("files_with_issues"), F.countDistinct("rule_id").alias("rules_fired"), *per_level)


def rules_loaded(files: DataFrame, rules: DataFrame, mode: str = "per_language") -> DataFrame:
    """How many rules a scan loads (aggregation 4): once per language it meets, or again for every file."""
    per = rules.groupBy("language").agg(F.count("*").alias("n"))
    met = files.select("language") if mode == "per_file" else files.select("language").distinct()
    return met.join(small(per, SMALL), "language").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rules_loaded"))


def line_metrics(lines: DataFrame, key: str) -> DataFrame:
    """Lines, non-blank lines and complexity per file (aggregations 6 and 7): 1 and one more for every word a line holds."""
    words = F.lit(0)
    for w in COMPLEXITY:
        words = words + F.contains("line", F.lit(w)).cast("int")
    return lines.groupBy(key).agg(F.count("*").alias("all_lines"), F.count_if(F.col("line").rlike(r"\S")).alias("code_lines"), (F.lit(1) + F.sum(words)).alias("complexity"))


def rules_per_category(rules: DataFrame, order: str = "rule_id") -> DataFrame:
    """Rules per category key with the name met first (aggregation 10)."""
    named = rules.withColumn("key", category_key(F.col("category"))).withColumn("name", F.coalesce(category_name(F.col("category")), F.col("category")))
    return named.groupBy("key").agg(F.count("*").alias("rules"), F.min_by("name", order).alias("name"))


def compliance(findings: DataFrame, standards: dict[str, str]) -> DataFrame:
    """(standard, value, findings, covered, total): coverage of each standard and counts per value (aggregation 11).

    standards: name -> array or text column. One pass: values of all standards are exploded together.
    """
    kinds = dict(findings.dtypes)
    arrays = [F.transform(F.array_compact(F.col(c) if kinds[c].startswith("array") else F.array(c)), _tagged(name)) for name, c in standards.items()]
    held = findings.select(F.explode(F.concat(*(F.coalesce(a, F.array().cast("array<struct<standard:string,value:string>>")) for a in arrays))).alias("s"))
    counts = held.filter("s.value <> ''").groupBy("s.standard", "s.value").agg(F.count("*").alias("findings"))
    covered = counts.groupBy("standard").agg(F.count("*").alias("covered"))
    total = F.when(F.col("standard") == "OWASP", F.lit(OWASP_TOTAL)).when(F.col("standard") == "CWE", F.lit(CWE_TOTAL))
    return counts.join(F.broadcast(covered), "standard").withColumn("total", total)


def _tagged(name: str):
    return lambda x: F.struct(F.lit(name).alias("standard"), x.alias("value"))


def recommendations(findings: DataFrame) -> DataFrame:
    """(position, priority, recommendation, action_items, findings) of what the counts call for (aggregation 12)."""
    tests = {"critical": F.col("severity") == "CRITICAL", "high": F.col("severity") == "HIGH", "sql": F.col("category") == "SQL Injection", "xss": F.col("category") == "XSS", "everything": F.lit(True)}
    n = findings.agg(*(F.count_if(c).alias(k) for k, c in tests.items()))
    row = lambda k, key, p, r, items: F.struct(F.lit(k).alias("position"), F.lit(p).alias("priority"), F.lit(r).alias("recommendation"), F.array(*map(F.lit, items)).alias("action_items"), F.col(key).alias("findings"))
    each = F.explode(F.array(*(row(k, key, *rest) for k, (key, *rest) in enumerate(RECOMMENDATIONS, 1))))
    return n.select(each.alias("r")).select("r.*").filter("findings > 0")


def ranked(findings: DataFrame, *ties: str) -> DataFrame:
    """Worst first, then a total order (order 1; theirs leaves ties to chance)."""
    return findings.orderBy(rank(F.col("severity")), *(ties or ("rule_id", "location", "finding_id")))


def with_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", rank(F.col("severity")))


def by_severity_and_confidence(findings: DataFrame, confidence: str, *ties: str) -> DataFrame:
    """Worst first, surest first (order 2)."""
    return findings.orderBy(rank(F.col("severity")), F.desc(confidence), *ties)


def top_files(findings: DataFrame, n: int = 10, location: str = "location", seen: str = "finding_id") -> DataFrame:
    """The files with most findings; ties go to the file seen first (order 3). The limit is the feature."""
    per = findings.select(file_of(F.col(location)).alias("file"), seen).filter("file is not null").groupBy("file").agg(F.count("*").alias("findings"), F.min(seen).alias("first_seen"))
    return per.orderBy(F.desc("findings"), "first_seen").limit(n)


def head_and_rest(findings: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n with the number of all that follow (orders 5 and 7)."""
    rest = findings.agg(F.greatest(F.lit(0), F.count("*") - n).alias("remaining"))
    return findings.orderBy(*order).limit(n).join(F.broadcast(rest))


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key (order 8), as a struct minimum: combined before the shuffle, no window over a hot key."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def report_heads(findings: DataFrame, scans: DataFrame, rules_used: Column, config: dict | None = None) -> DataFrame:
    """(scan_id, report): each scan's report as a JSON document but for its findings (sink 1): statistics, summary, metadata.

    scans: scan_id, source_directory, files_processed, duration_ns, ended (an instant). Both breakdowns come from one pass
    over the findings; scans without findings have empty ones. config: max_workers, timeout, use_semgrep_registry.
    """
    each = F.explode(F.array(F.struct(F.lit("severity").alias("of"), F.col("severity").alias("value")), F.struct(F.lit("category").alias("of"), F.col("category").alias("value"))))
    counts = findings.select("scan_id", each.alias("d")).groupBy("scan_id", "d.of", F.coalesce("d.value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    pick = lambda of: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("of") == of, F.struct("value", "n")))))
    per = counts.groupBy("scan_id").agg(F.sum(F.when(F.col("of") == "severity", F.col("n"))).alias("found"), pick("severity").alias("severity_breakdown"), pick("category").alias("category_breakdown"))
    whole = scans.select("scan_id", "source_directory", "files_processed", "duration_ns", "ended").join(per, "scan_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    none = F.create_map().cast("map<string,bigint>")
    began = F.col("ended") - F.make_dt_interval(secs=(F.col("duration_ns") / 1e9).cast("decimal(18,6)"))
    defaults = {"max_workers": 8, "timeout": 300, "use_semgrep_registry": False} | (config or {})
    body = F.struct(
        "scan_id", rfc3339(F.col("ended")).alias("timestamp"), "source_directory",
        F.struct("files_processed", rules_used.alias("rules_loaded"), F.col("found").alias("vulnerabilities_found"), rfc3339(began, True).alias("scan_start_time"), rfc3339(F.col("ended"), True).alias("scan_end_time"), F.col("duration_ns").alias("scan_duration")).alias("statistics"),
        F.struct(F.col("found").alias("total_vulnerabilities"), F.coalesce("severity_breakdown", none).alias("severity_breakdown"), F.coalesce("category_breakdown", none).alias("category_breakdown")).alias("summary"),
        F.struct(F.lit(TOOL_VERSION).alias("tool_version"), rules_used.alias("rules_used"), F.struct(*(F.lit(v).alias(k) for k, v in defaults.items())).alias("scan_config")).alias("metadata"),
    )
    return whole.select("scan_id", F.to_json(body).alias("report"))


def finding_documents(findings: DataFrame, *without: str) -> DataFrame:
    """The findings with `document`: all their fields as one JSON object (X19), the elements of a report's vulnerabilities."""
    fields = [c for c in findings.columns if c not in without]
    return findings.select("*", F.to_json(F.struct(*fields)).alias("document"))


def report_rows(findings: DataFrame, heads: DataFrame, *order: str) -> DataFrame:
    """(scan_id, k, document): a report as rows, its head at 0 and its findings after, worst first (sinks 1, 6 and 9).

    A scan may hold a third of all findings, so a report isn't gathered into one value; write_reports() stores its rows.
    """
    place = W.partitionBy("scan_id").orderBy(rank(F.col("severity")), *order)
    rows = finding_documents(findings).withColumn("k", F.row_number().over(place)).select("scan_id", "k", "document")
    return heads.select("scan_id", F.lit(0).alias("k"), F.col("report").alias("document")).unionByName(rows)


def write_reports(rows: DataFrame, path: str) -> None:
    """Store report_rows() as lines of text, a folder per scan (sinks 1 and 6)."""
    rows.select("scan_id", "document").write.mode("append").partitionBy("scan_id").text(path)


def exported(heads: DataFrame, at: Column) -> DataFrame:
    """Reports as they are downloaded: with the time of the export (sink 9)."""
    return heads.withColumn("report", F.concat(F.regexp_replace("report", r"\}$", ""), F.lit(',"exportedAt":"'), rfc3339(at), F.lit('"}')))


def summary_lines(findings: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, k, text): every finding numbered within its key, worst first, as one row each (sink 5).

    Location, details, weakness, OWASP category and remediation have lines of their own; a weakness or category that isn't
    given has no line. Rows stay as small as a finding however hot a key is.
    """
    place = W.partitionBy(key).orderBy(rank(F.col("severity")), *order)
    numbered = findings.withColumn("k", F.row_number().over(place))
    said = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.col("k").cast("string"), F.lit(". ["), F.col("severity"), F.lit("] "), said("rule_id"))
    optional = [F.when(F.col(c) != "", F.concat(F.lit(f"   {label}: "), F.col(c))) for label, c in (("CWE", "cwe_id"), ("OWASP", "review_guidance"))]
    always = [F.concat(F.lit(f"   {label}: "), said(c)) for label, c in (("Location", "location"), ("Details", "details"), ("Remediation", "remediation"))]
    return numbered.select(key, "k", F.concat_ws("\n", head, *always[:2], *optional, always[2], F.lit("")).alias("text"))


def summary_head(findings: DataFrame, key: str, about: DataFrame | None = None) -> DataFrame:
    """(key, text): time and folder, how many findings, and the levels that occur (sink 5). about: key, ended, source_directory."""
    levels = [F.when(F.col(s) > 0, F.concat(F.lit(f"  {s.upper()}: "), F.col(s).cast("string"))) for s in map(str.lower, ORDER)]
    sums = findings.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ORDER))
    if about is not None:
        sums = sums.join(about.select(key, "ended", "source_directory"), key, "left")
    told = [] if about is None else [F.concat(F.lit("Scan Timestamp: "), rfc3339(F.col("ended"))), F.concat(F.lit("Source Directory: "), F.col("source_directory")), F.lit("")]
    return sums.select(key, F.concat_ws("\n", F.lit(SUMMARY), F.lit(""), *told, F.concat(F.lit("Total Vulnerabilities: "), F.col("n").cast("string")), F.lit(""), F.lit("Severity Breakdown:"), *levels, F.lit(""), F.lit(DETAILS), F.lit("")).alias("text"))


def summary_text(findings: DataFrame, key: str, *order: str, about: DataFrame | None = None) -> DataFrame:
    """(key, text): a readable summary: header, levels that occur, and all findings, numbered (sink 5).

    A summary is one value; of keys too hot for that, summary_head and summary_lines are rows.
    """
    lines = summary_lines(findings, key, *order).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("ls"))
    return summary_head(findings, key, about).join(lines, key).select(key, F.concat_ws("\n", "text", F.array_join(F.col("ls.text"), "\n")).alias("text"))
