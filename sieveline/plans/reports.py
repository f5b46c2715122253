"""Queries over findings, their reports and the history of scans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import severity as sev
from sieveline.functions import text
from sieveline.operators import history, report
from sieveline.plans.scan import LINES_SQL, scanned_lines
from sieveline.session import load, scratch_path
from sieveline.sources import external

CONTEXT = ("file_path", "lines", "semgrep", "batch", "match", "line", "registry")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Accepted findings with severities of one vocabulary."""
    return load(spark, d, "findings").withColumn("severity", sev.normalize(F.col("severity"), "both"))


def a1_severity(spark: SparkSession, d: str) -> DataFrame:
    return report.count_by(findings(spark, d), "severity")


def a2_category(spark: SparkSession, d: str) -> DataFrame:
    return report.count_by(findings(spark, d), "category")


def a1_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.breakdown(findings(spark, d), "severity", "category", "confidence")


def a3_files(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).select(report.file_of(F.col("location")).alias("file"))
    return report.count_by(rows, "file")


def a4_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.totals(findings(spark, d))


def a4_rules_loaded(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "source_files").withColumn("language", F.lower("language"))
    rules = load(spark, d, "scan_rules").withColumn("language", F.lower("language"))
    once = report.rules_loaded(files, rules).withColumn("mode", F.lit("per_language"))
    return once.unionByName(report.rules_loaded(files, rules, "per_file").withColumn("mode", F.lit("per_file")))


def a6_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.line_metrics(scanned_lines(spark, d), "file_id")


def a10_rule_categories(spark: SparkSession, d: str) -> DataFrame:
    return report.rules_per_category(load(spark, d, "scan_rules"))


def a11_compliance(spark: SparkSession, d: str) -> DataFrame:
    return report.compliance(findings(spark, d), {"OWASP": "review_guidance", "CWE": "cwe_id"}).withColumn("total", F.col("total").cast("bigint"))


def a11_rule_compliance(spark: SparkSession, d: str) -> DataFrame:
    """The same over rules, whose weaknesses are arrays."""
    return report.compliance(load(spark, d, "scan_rules"), {"OWASP": "owasp", "CWE": "cwe"}).withColumn("total", F.col("total").cast("bigint"))


def a12_recommendations(spark: SparkSession, d: str) -> DataFrame:
    out = report.recommendations(findings(spark, d).withColumn("category", F.when(F.col("category") == "Security - Injection", "SQL Injection").otherwise(F.col("category"))))
    return out.withColumn("position", F.col("position").cast("bigint")).withColumn("action_items", F.array_join("action_items", "; "))


def a14_languages(spark: SparkSession, d: str) -> DataFrame:
    """Files per language and the languages there are (aggregations 14 and 16)."""
    rows = load(spark, d, "source_files").groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language"))
    return rows.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


def a5_scan_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels per scan, one pass."""
    rows = findings(spark, d).groupBy("scan_id")
    return rows.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in sev.ORDER), F.countDistinct("rule_id").alias("rules"))


def o1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return report.with_rank(report.ranked(findings(spark, d))).select("finding_id", "severity", F.col("severity_rank").cast("bigint").alias("severity_rank"))


def o2_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).filter("code_snippet is not null").withColumn("score", sev.confidence_score(F.col("severity"), F.col("code_snippet"), F.col("code_snippet")))
    return report.by_severity_and_confidence(rows, "score", "finding_id").select("finding_id", "severity", "score")


def o3_top_files(spark: SparkSession, d: str) -> DataFrame:
    return report.top_files(findings(spark, d))


def o5_head(spark: SparkSession, d: str) -> DataFrame:
    return report.head_and_rest(findings(spark, d).select("finding_id", "rule_id", "severity"), 5, "finding_id")


def o7_first_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return report.head_and_rest(a12_recommendations(spark, d), 3, "position").select("position", "priority", "recommendation", "remaining")


def o8_primary_file(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_files").select("job_id", "created_at", "file_id", "path", "size")
    return report.first_per(rows, "job_id", "created_at", "file_id").select("job_id", "file_id", "path", "size")


def f4_severity_tab(spark: SparkSession, d: str) -> DataFrame:
    """The findings behind each severity's tab, and behind the one for all."""
    rows = findings(spark, d).select("finding_id", "rule_id", "location", "severity")
    tab = F.explode(F.array(F.lit("all"), F.lower("severity")))
    return rows.select(tab.alias("tab"), "finding_id", "rule_id", "location")


def f5_of_job(spark: SparkSession, d: str) -> DataFrame:
    return history.of_key(load(spark, d, "source_files"), "job_id", 2).select("file_id", "path")


def scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans with the instant they ended."""
    return load(spark, d, "scans").withColumn("ended", history.instant())


def heads(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "scan_rules").count()
    return report.report_heads(findings(spark, d).filter("scan_id is not null"), scans(spark, d), F.lit(n).cast("bigint"))


def k1_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every scan's report but for its findings, field by field."""
    at = lambda p, kind="string": F.get_json_object("report", f"$.{p}").cast(kind)
    counts = lambda p: F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(at(p), "map<string,bigint>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return heads(spark, d).select(
        at("scan_id").alias("scan_id"), at("timestamp").alias("timestamp"), at("source_directory").alias("source_directory"), at("statistics.files_processed", "bigint").alias("files_processed"), at("statistics.rules_loaded", "bigint").alias("rules_loaded"),
        at("statistics.vulnerabilities_found", "bigint").alias("vulnerabilities_found"), at("statistics.scan_start_time").alias("scan_start_time"), at("statistics.scan_end_time").alias("scan_end_time"), at("statistics.scan_duration", "bigint").alias("scan_duration"),
        at("summary.total_vulnerabilities", "bigint").alias("total"), counts("summary.severity_breakdown").alias("severities"), counts("summary.category_breakdown").alias("categories"), at("metadata.tool_version").alias("tool_version"), at("metadata.rules_used", "bigint").alias("rules_used"),
        at("metadata.scan_config.max_workers", "bigint").alias("max_workers"), at("metadata.scan_config.timeout", "bigint").alias("timeout"), at("metadata.scan_config.use_semgrep_registry").alias("use_registry"),
    )


def k1_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The findings of every report in its order, each as the JSON object it is there."""
    rows = findings(spark, d).filter("scan_id is not null").withColumns({"detected_at": F.unix_micros("detected_at"), "ingested_at": F.unix_micros("ingested_at"), "context": F.col("context.file_path")})
    out = report.report_rows(rows, heads(spark, d), "finding_id").filter("k > 0")
    return out.select("scan_id", F.col("k").cast("bigint").alias("k"), F.md5("document").alias("document"))


def k1_finding_documents(spark: SparkSession, d: str) -> DataFrame:
    """Findings as JSON documents of all their fields."""
    rows = load(spark, d, "findings").withColumns({"detected_at": F.unix_micros("detected_at"), "ingested_at": F.unix_micros("ingested_at")})
    flat = rows.select(*[c for c in rows.columns if c != "context"], *(F.col(f"context.{c}").alias(f"context_{c}") for c in CONTEXT))
    return report.finding_documents(flat).select("finding_id", F.md5("document").alias("document"))


def k5_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every scan's whole summary, a row per numbered finding; the header is number 0."""
    rows = findings(spark, d).filter("scan_id is not null")
    head = report.summary_head(rows, "scan_id", scans(spark, d)).select("scan_id", F.lit(0).cast("bigint").alias("k"), "text")
    return head.unionByName(report.summary_lines(rows, "scan_id", "finding_id").withColumn("k", F.col("k").cast("bigint")))


def k2_appended(spark: SparkSession, d: str) -> DataFrame:
    """The scan table as two appends leave it, after its creation (sinks 2 and 4)."""
    path = scratch_path(spark, "scans")
    rows = load(spark, d, "scans").select("scan_id", "source_directory", "files_processed", "vulnerabilities_found", "duration_ns", "scanned_at")
    history.ensure(spark, path, history.SCANS)
    first = F.col("scanned_at") < F.lit("2026-03-01")
    history.append_scans(rows.filter(first), path)
    history.append_scans(rows.filter(~first | first.isNull()), path)
    return spark.read.schema(history.SCANS).parquet(path)


def k9_exported(spark: SparkSession, d: str) -> DataFrame:
    """Reports as downloads: with the time of their export, here a fixed one."""
    out = report.exported(heads(spark, d), F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    return out.select("scan_id", F.get_json_object("report", "$.exportedAt").alias("exported_at"), F.get_json_object("report", "$.summary.total_vulnerabilities").cast("bigint").alias("total"))


def f9_scan(spark: SparkSession, d: str) -> DataFrame:
    """One scan's row and one unknown scan's, which has none."""
    rows = load(spark, d, "scans").select("scan_id", "status", "files_processed")
    return history.of_key(rows, "scan_id", "59b94609-d551-4945-a2b0-5f34e85f009f").unionByName(history.of_key(rows, "scan_id", "not-there"))


def x10_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every scan: those called running that are gone have failed, those with only a report are completed."""
    rows = load(spark, d, "scans").select("scan_id", F.when(F.pmod("files_processed", F.lit(3)) == 0, "RUNNING").otherwise(F.col("status")).alias("status"), "files_processed")
    alive = rows.filter(F.pmod("files_processed", F.lit(2)) == 0)
    known = rows.filter(F.coalesce(F.pmod("files_processed", F.lit(5)) != 4, F.lit(True)))
    return history.status_of(known, load(spark, d, "scan_reports").filter("scan_id is not null"), alive)


def x17_started(spark: SparkSession, d: str) -> DataFrame:
    return history.started(load(spark, d, "scans"), F.lit(0).cast("bigint")).withColumns({c: F.col(c).cast("bigint") for c in ("files_processed", "vulnerabilities_found")})


def x20_recent(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(load(spark, d, "scans"))


def e10_times(spark: SparkSession, d: str) -> DataFrame:
    """Instants as texts, and as milliseconds."""
    rows = scans(spark, d).select("scan_id", (F.col("ended") + F.make_dt_interval(secs=(F.pmod("duration_ns", F.lit(1000000000)) / 1000).cast("bigint").cast("decimal(18,6)") / 1000000)).alias("t"))
    return rows.select("scan_id", text.rfc3339(F.col("t")).alias("whole"), text.rfc3339(F.col("t"), True).alias("fine"), F.unix_millis("t").alias("ms"))


def k3_directories(spark: SparkSession, d: str) -> DataFrame:
    return history.directories(load(spark, d, "scans"))


def k3_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The folders of one half of the scans merged with those of the other: the same as all at once."""
    scans = load(spark, d, "scans")
    later = F.col("scanned_at") >= F.lit("2026-03-01")
    return history.upsert(history.directories(scans.filter(~later | later.isNull())), history.directories(scans.filter(later)))


def o4_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history(load(spark, d, "scans")).select("scan_id", F.unix_millis("scanned").alias("at_ms"), "duration_s")


def f8_directory(spark: SparkSession, d: str) -> DataFrame:
    return history.of_key(load(spark, d, "scans"), "source_directory", "/srv/scan/entity-cobalt").select("scan_id", "status")


def k11_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest report of each scan."""
    log = external.report_statistics(load(spark, d, "scan_reports")).select("scan_id", "received_at", "report_id", "producer", "files_processed", "vulnerabilities_found")
    return history.latest(log.filter("scan_id is not null"), "scan_id", "received_at", "report_id").select("scan_id", "report_id", "producer", "files_processed", "vulnerabilities_found")


def k11_final_states(spark: SparkSession, d: str) -> DataFrame:
    rows = history.status_changes(load(spark, d, "scans"), "status", "scanned_at")
    return rows.select("scan_id", F.upper("status").alias("status"), "end_time")


def j16_completion(spark: SparkSession, d: str) -> DataFrame:
    """Scans with what their latest report says, where the scan's own row lacks it."""
    scans = load(spark, d, "scans").select("scan_id", F.col("files_processed").alias("own_files"), "status")
    said = k11_latest_state(spark, d).select("scan_id", F.col("files_processed").alias("reported_files"), "vulnerabilities_found")
    return scans.join(said, "scan_id", "left").select("scan_id", F.coalesce(F.col("own_files").cast("bigint"), F.col("reported_files")).alias("files"), "vulnerabilities_found")


def k10_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Scans and findings left once the failed scans are deleted with all their findings."""
    rows = load(spark, d, "scans").select("scan_id", "status")
    gone = rows.filter(F.lower("status") == "failed")
    left, kids = history.delete_cascade(rows, {"findings": load(spark, d, "findings").select("scan_id", "finding_id")}, gone, "scan_id")
    return left.select(F.lit("scan").alias("kind"), "scan_id", F.lit(None).cast("bigint").alias("finding_id")).unionByName(kids["findings"].select(F.lit("finding").alias("kind"), "scan_id", "finding_id"))


def a13_events(spark: SparkSession, d: str) -> DataFrame:
    """First, last and number of events per user: the keyed state over a large log."""
    return load(spark, d, "events").groupBy("user_id").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("first_us"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us"), F.count("*").alias("events"))


def e8_event_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON texts, summed per event type."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return load(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("given"), F.sum("k").alias("total"), F.max("k").alias("largest"))


QUERIES = {f.__name__: f for f in (
    a1_severity, a2_category, a1_breakdown, a3_files, a4_totals, a4_rules_loaded, a6_lines, a10_rule_categories, a11_compliance, a11_rule_compliance, a12_recommendations, a14_languages, a5_scan_levels, o1_ranked, o2_by_confidence, o3_top_files, o5_head,
    o7_first_recommendations, o8_primary_file, f4_severity_tab, f5_of_job, k1_reports, k1_report_rows, k1_finding_documents, k2_appended, k5_summaries, k9_exported, f9_scan, x10_status, x17_started, x20_recent, e10_times, k3_directories, k3_upsert, o4_history, f8_directory, k11_latest_state, k11_final_states, j16_completion, k10_cascade, a13_events, e8_event_fields,
)}

_F = """
with f as (select * replace (case when upper(trim(severity)) = 'ERROR' then 'HIGH' when upper(trim(severity)) = 'WARNING' then 'MEDIUM' when upper(trim(severity)) in ('CRITICAL','HIGH','MEDIUM','LOW','INFO') then upper(trim(severity)) else 'MEDIUM' end as severity) from findings)
"""
_LEVELS = ", ".join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in sev.ORDER)
_RANK = "list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity) - 1"
_SCORE = "round(least(0.95, greatest(0.1, 0.5 + case lower(severity) when 'critical' then 0.2 when 'high' then 0.15 else 0 end + case when contains(lower(code_snippet), 'password') or contains(lower(code_snippet), 'secret') then 0.2 else 0 end + case when contains(lower(code_snippet), 'user') or contains(lower(code_snippet), 'input') then 0.1 else 0 end - case when contains(code_snippet, '//') or contains(code_snippet, '#') then 0.1 else 0 end))::double, 4)"
_COVER = "select standard, value, count(*) as findings, count(*) over (partition by standard) as covered, case standard when 'OWASP' then 10 else 25 end as total from s where value is not null and value <> '' group by standard, value"
_ADVICE = ", c as (select count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (category = 'Security - Injection') as sql, count(*) filter (category = 'XSS') as xss, count(*) as everything from f)"
_ADVICE_ALL = _F.rstrip() + _ADVICE + " select * from (" + " union all ".join(f"select {k}::bigint as position, '{p}' as priority, '{r}' as recommendation, '{'; '.join(items)}' as action_items, {key} as findings from c" for k, (key, p, r, items) in enumerate(report.RECOMMENDATIONS, 1)) + ") where findings > 0"
_DIRS = "select source_directory as directory, arg_min(scanned_at, (t, scanned_at)) as first_scan, arg_max(scanned_at, (t, scanned_at)) as last_scan, count(*) as scan_count from (select *, try_cast(scanned_at as timestamptz) as t from scans where source_directory is not null) group by 1"
_REPORT_LOG = """select scan_id, received_at, report_id, producer,
  coalesce(try_cast(j ->> '$.statistics.files_processed' as bigint), try_cast(j ->> '$.summary.files_processed' as bigint)) as files_processed,
  coalesce(try_cast(j ->> '$.statistics.vulnerabilities_found' as bigint), try_cast(j ->> '$.summary.total_vulnerabilities' as bigint)) as vulnerabilities_found
  from (select *, case when json_valid(payload) then payload::json end as j from scan_reports) where scan_id is not null"""
_LATEST = f"select scan_id, report_id, producer, files_processed, vulnerabilities_found from ({_REPORT_LOG}) qualify row_number() over (partition by scan_id order by received_at desc, report_id desc) = 1"
_TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_FINE = "(rtrim(rtrim(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z')"


def _document(context: str | None) -> str:
    """A finding as the JSON text of its fields, without those that are null."""
    fields = ["finding_id", "scan_id", "rule_id", "category", "severity", "location", "details", "remediation", *(["context"] if context else []), "cwe_id", "review_guidance", "confidence", "dependency_file", "line_number", "column_number", "code_snippet", "dependency_version", "detected_at", "ingested_at", *([] if context else [f"context_{c}" for c in CONTEXT])]
    value = {"detected_at": "epoch_us(detected_at)", "ingested_at": "epoch_us(ingested_at)", "context": context} | {f"context_{c}": f"context.{c}" for c in CONTEXT}
    return "md5('{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || to_json({value.get(c, c)})" for c in fields) + ") || '}')"


_WORDS = " + ".join(f"contains(line, '{w}')::int" for w in report.COMPLEXITY)
SQL = {
    "a1_severity": _F + "select severity, count(*) as findings from f group by 1",
    "a2_category": _F + "select category, count(*) as findings from f group by 1",
    "a1_breakdown": _F + "select 'severity' as dimension, severity as value, count(*) as findings from f group by 2 union all select 'category', category, count(*) from f group by 2 union all select 'confidence', confidence, count(*) from f group by 2",
    "a3_files": "select string_split(location, ':')[1] as file, count(*) as findings from findings group by 1",
    "a4_totals": _F + f"select count(*) as findings, count(distinct string_split(location, ':')[1]) as files_with_issues, count(distinct rule_id) as rules_fired, {_LEVELS} from f",
    "a4_rules_loaded": "with r as (select lower(language) as language, count(*) as n from scan_rules group by 1) select coalesce(sum(n), 0)::bigint as rules_loaded, 'per_language' as mode from (select distinct lower(language) as language from source_files) join r using (language) union all select coalesce(sum(n), 0)::bigint, 'per_file' from (select lower(language) as language from source_files) join r using (language)",
    "a6_lines": f"with {LINES_SQL} select file_id, count(*) as all_lines, count(*) filter (regexp_matches(line, '\\S')) as code_lines, 1 + sum({_WORDS})::bigint as complexity from lines group by 1",
    "a10_rule_categories": "select key, count(*) as rules, arg_min(name, rule_id) as name from (select rule_id, string_split(category, ' - ')[1] as key, coalesce(string_split(category, ' - ')[2], category) as name from scan_rules) group by 1",
    "a11_compliance": f"with s as (select 'OWASP' as standard, review_guidance as value from findings union all select 'CWE', cwe_id from findings) {_COVER}",
    "a11_rule_compliance": f"with s as (select 'OWASP' as standard, owasp as value from scan_rules union all select 'CWE', unnest(cwe) from scan_rules) {_COVER}",
    "a12_recommendations": _ADVICE_ALL,
    "a14_languages": "select coalesce(lower(language), 'unknown') as language, count(*) as files, sum(size)::bigint as bytes, min(file_id) as first_file, max(file_id) as last_file from source_files group by 1",
    "a5_scan_levels": _F + f"select scan_id, {_LEVELS}, count(distinct rule_id) as rules from f group by 1",
    "o1_ranked": _F + f"select finding_id, severity, ({_RANK})::bigint as severity_rank from f",
    "o2_by_confidence": _F + f"select finding_id, severity, {_SCORE} as score from f where code_snippet is not null",
    "o3_top_files": "select string_split(location, ':')[1] as file, count(*) as findings, min(finding_id) as first_seen from findings where location is not null group by 1 order by 2 desc, 3 limit 10",
    "o5_head": _F + "select finding_id, rule_id, severity, greatest(0, (select count(*) from f) - 5) as remaining from f order by finding_id limit 5",
    "o7_first_recommendations": f"with a as ({_ADVICE_ALL}) select position, priority, recommendation, greatest(0, (select count(*) from a) - 3) as remaining from a order by position limit 3",
    "o8_primary_file": "select job_id, file_id, path, size from source_files qualify row_number() over (partition by job_id order by created_at, file_id) = 1",
    "f4_severity_tab": _F + "select 'all' as tab, finding_id, rule_id, location from f union all select lower(severity), finding_id, rule_id, location from f",
    "f5_of_job": "select file_id, path from source_files where job_id = 2",
    "k1_reports": _F.rstrip() + f""", n as (select count(*) as rules from scan_rules), s as (select *, try_cast(scanned_at as timestamptz)::timestamp as t from scans),
      v as (select scan_id, count(*) as found from f group by 1),
      a as (select scan_id, string_agg(severity || '=' || n, ';' order by severity) as severities from (select scan_id, severity, count(*) as n from f group by 1, 2) group by 1),
      b as (select scan_id, string_agg(c || '=' || n, ';' order by c) as categories from (select scan_id, coalesce(category, '') as c, count(*) as n from f group by 1, 2) group by 1)
      select s.scan_id, {_TIME.format('t')} as timestamp, source_directory, files_processed::bigint as files_processed, rules as rules_loaded, coalesce(found, 0) as vulnerabilities_found, {_FINE.format('(t - to_microseconds(round(duration_ns / 1000.0)::bigint))')} as scan_start_time, {_FINE.format('t')} as scan_end_time, duration_ns as scan_duration,
      coalesce(found, 0) as total, coalesce(severities, '') as severities, coalesce(categories, '') as categories, '1.0.0' as tool_version, rules as rules_used, 8::bigint as max_workers, 300::bigint as timeout, 'false' as use_registry from s cross join n left join v using (scan_id) left join a using (scan_id) left join b using (scan_id)""",
    "k1_report_rows": _F + f"select scan_id, row_number() over (partition by scan_id order by {_RANK}, finding_id) as k, {_document('context.file_path')} as document from f where scan_id is not null",
    "k1_finding_documents": f"select finding_id, {_document(None)} as document from findings",
    "k2_appended": "select scan_id, source_directory, files_processed, vulnerabilities_found, duration_ns, scanned_at from scans",
    "k5_summaries": _F + f""", n as (select scan_id, count(*) as n, {_LEVELS} from f where scan_id is not null group by 1), s as (select scan_id, source_directory, try_cast(scanned_at as timestamptz)::timestamp as t from scans)
      select scan_id, row_number() over (partition by scan_id order by {_RANK}, finding_id) as k, concat_ws(chr(10), row_number() over (partition by scan_id order by {_RANK}, finding_id) || '. [' || severity || '] ' || coalesce(rule_id, ''), '   Location: ' || coalesce(location, ''), '   Details: ' || coalesce(details, ''),
        case when cwe_id <> '' then '   CWE: ' || cwe_id end, case when review_guidance <> '' then '   OWASP: ' || review_guidance end, '   Remediation: ' || coalesce(remediation, ''), '') as text from f where scan_id is not null
      union all select n.scan_id, 0, concat_ws(chr(10), '{report.SUMMARY}', '', 'Scan Timestamp: ' || {_TIME.format('t')}, 'Source Directory: ' || source_directory, '', 'Total Vulnerabilities: ' || n, '', 'Severity Breakdown:', {', '.join(f"case when {s.lower()} > 0 then '  {s}: ' || {s.lower()} end" for s in sev.ORDER)}, '', '{report.DETAILS}', '') from n left join s using (scan_id)""",
    "k9_exported": "select scan_id, '2026-01-01T00:00:00Z' as exported_at, coalesce(n, 0) as total from scans left join (select scan_id, count(*) as n from findings group by 1) using (scan_id)",
    "f9_scan": "select scan_id, status, files_processed from scans where scan_id in ('59b94609-d551-4945-a2b0-5f34e85f009f', 'not-there')",
    "x10_status": """with r as (select scan_id, files_processed as n, upper(case when files_processed % 3 = 0 then 'RUNNING' else status end) as status from scans), k as (select * from r where coalesce(n % 5 <> 4, true)), rep as (select distinct scan_id from scan_reports where scan_id is not null),
      b as (select coalesce(k.scan_id, rep.scan_id) as scan_id, k.status, rep.scan_id is not null as reported from k full join rep on k.scan_id = rep.scan_id),
      o as (select b.scan_id, case when b.status is null and reported then 'COMPLETED' when b.status = 'RUNNING' and not exists (select 1 from r where r.scan_id = b.scan_id and r.n % 2 = 0) then 'FAILED' else b.status end as status from b where b.status is not null or reported)
      select scan_id, status, status = 'COMPLETED' as report_available from o""",
    "x17_started": "select scan_id, coalesce(source_directory, '.') as source_directory, 0::bigint as start_time, 'STARTED' as status, 0::bigint as files_processed, 0::bigint as vulnerabilities_found from scans",
    "x20_recent": "select scan_id as id, status, scanned_at as created from scans",
    "e10_times": f"with s as (select scan_id, try_cast(scanned_at as timestamptz)::timestamp + to_microseconds((duration_ns % 1000000000) // 1000) as t from scans) select scan_id, {_TIME.format('t')} as whole, {_FINE.format('t')} as fine, epoch_us(t) // 1000 as ms from s",
    "k3_directories": _DIRS,
    "k3_upsert": _DIRS,
    "o4_history": "select scan_id, epoch_ms(try_cast(scanned_at as timestamptz)) as at_ms, round(duration_ns / 1e9, 3) as duration_s from scans",
    "f8_directory": "select scan_id, status from scans where source_directory = '/srv/scan/entity-cobalt'",
    "k11_latest_state": _LATEST,
    "k11_final_states": "select scan_id, upper(status) as status, case when upper(status) in ('COMPLETED', 'FAILED') then scanned_at end as end_time from scans",
    "j16_completion": f"select s.scan_id, coalesce(s.files_processed::bigint, l.files_processed) as files, l.vulnerabilities_found from scans s left join ({_LATEST}) l using (scan_id)",
    "k10_cascade": "with gone as (select scan_id from scans where lower(status) = 'failed') select 'scan' as kind, scan_id, null::bigint as finding_id from scans where scan_id not in (from gone) union all select 'finding', scan_id, finding_id from findings where scan_id is null or scan_id not in (from gone)",
    "a13_events": "select user_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, count(*) as events from events group by 1",
    "e8_event_fields": "select event_type, count(k) as given, sum(k)::bigint as total, max(k) as largest from (select event_type, try_cast(props ->> '$.k' as bigint) as k from (select event_type, case when json_valid(props) then props::json end as props from events)) group by 1",
}
