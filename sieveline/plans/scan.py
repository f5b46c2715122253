"""Queries over files, rules and their matches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import language as lang
from sieveline.functions import severity as sev
from sieveline.functions import text
from sieveline.operators import match, report
from sieveline.session import load, small
from sieveline.sources import external, files, rules


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(sql_text(str(x)) for x in p) + ")" for p in pairs)


EXT_SQL = r"lower(regexp_extract({0}, '(\.[^./\\]*)$', 1))"
LANG_SQL = "(case " + " ".join(f"when {EXT_SQL.format('{0}')} in ({', '.join(sql_text(e) for e in exts)}) then '{name}'" for name, exts in lang.EXTENSIONS.items()) + " end)"
WEB_SQL = "(case " + " ".join(f"when {EXT_SQL.format('{0}')} = '{e}' then '{name}'" for e, name in lang.WEB_EXTENSIONS.items()) + " else 'unknown' end)"
TRIM_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES_SQL = f"""
lines as (
  select file_id, path, language, unnest(generate_series(1, len(ls))) as line_no, unnest(ls) as line
  from (select file_id, path, {LANG_SQL.format('path')} as language, string_split(content, chr(10)) as ls from source_files where content is not null)
)"""
RULES_SQL = r"""
usable as (
  select rule_id, lower(language) as language, pattern from scan_rules
  where pattern is not null and pattern <> '' and not contains(pattern, '(?!') and not contains(pattern, '(?=') and not contains(pattern, '(?<')
    and coalesce(enabled, true) and try(regexp_matches('', pattern)) is false
)"""
QUANTIFIED = [("words", r"\w{10,20}="), ("letters", r"[a-z]{12,}\("), ("not-closed", r"[^\]]{60,}"), ("alpha", r"\p{L}+\d"), ("spelled", r"\x72eturn\s+\w{3}"), ("repeat", r"(?:ab|cd|er){2,3}"), ("exact", r"\bfor\b.{0,8}\("), ("lazy", r"\"[^\"]{4,}?\"")]
QUANTIFIED_LANGUAGES = ["java", "python", "javascript"]
MATCH_SQL = f"""
with {LINES_SQL}, {RULES_SQL}, hits as (
  select l.*, r.rule_id, r.pattern, regexp_extract_all(line, pattern) as ms, string_split_regex(line, pattern) as gs
  from lines l join usable r on l.language = r.language where regexp_matches(line, pattern)
), spread as (
  select *, unnest(generate_series(1, len(ms))) as k from hits
), matches as (
  select file_id, path, language, line_no, line, rule_id, ms[k] as matched,
    1 + list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) as column_no
  from spread
)
"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with the language of their ending."""
    return load(spark, sf_dir, "source_files").withColumn("language", lang.by_extension(F.col("path")))


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lines(scanned(spark, sf_dir), "file_id", "path", "language")


def usable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.compiled(rules.choose(rules.normalized(load(spark, sf_dir, "scan_rules"))), "linear")[0]


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.find_matches(scanned_lines(spark, sf_dir), usable_rules(spark, sf_dir))


def default_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules over the files; the worst findings first."""
    table = rules.defaults(spark)
    good, _ = rules.compiled(rules.of_type(rules.normalized(table), "regex"), "linear")
    return match.as_findings(match.find_matches(scanned_lines(spark, sf_dir), good), table)


def _discover(mode: str):
    return lambda spark, d: files.discover(load(spark, d, "source_files"), "path", mode).select("file_id", "path", text.extension(F.col("path")).alias("ending"))


def _discover_sql(mode: str) -> str:
    names = "|".join(n.replace(".", r"\.") for n in files.SKIPPED[mode])
    dots = "" if mode == "full" else r"|\.[^/.][^/]*"
    ends = ", ".join(sql_text(e) for e in lang.known_extensions())
    return f"select file_id, path, {EXT_SQL.format('path')} as ending from source_files where {EXT_SQL.format('path')} in ({ends}) and not regexp_matches(replace(path, chr(92), '/'), '(?:^|/)(?:{names}{dots})/')"


def s4_read_text(spark: SparkSession, d: str) -> DataFrame:
    """Contents as bytes with invalid ones put around them, read as text again."""
    raw = F.concat(F.unhex(F.lit("FFC328")), F.col("content").cast("binary"), F.unhex(F.lit("E28228")))
    rows = load(spark, d, "source_files").filter("content is not null").select("file_id", raw.alias("raw"))
    return rows.select("file_id", F.md5(files.text_of(F.col("raw"))).alias("text"), F.octet_length("raw").cast("bigint").alias("bytes"))


def rule_files(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as rule files, one per rule (JSON is YAML too), some broken: (path, language, content)."""
    body = F.to_json(F.struct(F.array(F.struct(
        F.col("rule_id").alias("id"), "category", F.col("rule_type").alias("type"), F.when(F.length("rule_id") % 2 == 0, F.to_json(F.struct("pattern"))).alias("_map"), "pattern", "severity", "message", F.col("remediation").alias("fix"), "tags", F.struct("cwe", "owasp", "confidence").alias("metadata"),
    )).alias("rules")))
    text_ = F.when(F.length("rule_id") % 7 == 0, F.lit("rules: [")).when(F.length("rule_id") % 11 == 0, F.lit("other: 1")).otherwise(body)
    return load(spark, d, "scan_rules").select(F.concat(F.lit("/rules/x/"), "rule_id", F.lit(".yaml")).alias("path"), F.lower("language").alias("language"), text_.cast("binary").alias("content"))


def s5_rule_files(spark: SparkSession, d: str) -> DataFrame:
    """Rules of rule files with their defaults, and the files that hold none (sources 5 and 6; projections 7 and 8)."""
    out = rules.parse_files(rule_files(spark, d))
    return out.select(text.basename(F.col("source_file")).alias("file"), "rule_id", "language", "category", "rule_type", "pattern", "severity", F.try_element_at("cwe", F.lit(1)).alias("cwe_id"), "owasp", "confidence", F.size("tags").cast("bigint").alias("n_tags"), F.col("reason").isNotNull().alias("broken"))


def proj08_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns given as a map, as a text, or as something else."""
    held = F.concat(F.lit('{"rules": [{"id": '), F.to_json(F.struct("rule_id")).substr(F.lit(12), F.length(F.to_json(F.struct("rule_id"))) - 12), F.lit(', "severity": 5, "pattern": '), F.when(F.length("rule_id") % 3 == 0, '{"pattern": "a.b(...)"}').when(F.length("rule_id") % 3 == 1, '"c(...)"').otherwise("[1]"), F.lit("}]}"))
    out = rules.parse_files(load(spark, d, "scan_rules").select("rule_id", F.lit("f").alias("path"), F.lit("x").alias("language"), held.alias("content")))
    return out.select("rule_id", "pattern", "severity", "category")


def s4_lines(spark: SparkSession, d: str) -> DataFrame:
    return scanned_lines(spark, d).groupBy("file_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("characters"), F.max("line_no").cast("bigint").alias("last_line"))


def s6_rule_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rules an automaton engine can't use, and whether they lack a pattern, use look-around, or are broken."""
    _, bad = rules.compiled(load(spark, d, "scan_rules"), "linear")
    return bad.select("rule_id", F.when(F.col("problem").isin("no pattern", "look-around or back-reference"), F.col("problem")).otherwise("broken").alias("problem"))


def s7_default_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.normalized(rules.defaults(spark)).select("rule_id", "language", "rule_type", "pattern", "severity", "confidence")


def s7_web_rules(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue taken for a web one: patterns with flags, severities in small letters."""
    rows = load(spark, d, "scan_rules").select("rule_id", F.lit("n").alias("name"), F.col("message").alias("description"), "category", F.lower("severity").alias("severity"), "pattern", F.when(F.length("rule_id") % 2 == 0, "gi").otherwise("g").alias("flags"), F.col("remediation").alias("recommendation"), "enabled")
    return rules.from_web(rows, ["java", "python"]).select("rule_id", "language", "pattern", "severity", "message", "owasp", "enabled")


def x2_rule_files(spark: SparkSession, d: str) -> DataFrame:
    """Every rule as a one-rule document."""
    return rules.as_rule_files(load(spark, d, "scan_rules")).select("rule_id", F.md5("document").alias("document"))


def s10_uploads(spark: SparkSession, d: str) -> DataFrame:
    return files.uploads(load(spark, d, "source_files")).select("file_id", "filename", "size")


def s11_first_uploads(spark: SparkSession, d: str) -> DataFrame:
    """The first file of each name in each job."""
    rows = load(spark, d, "source_files").select("job_id", "filename", "created_at", "file_id", "size").filter("filename is not null")
    return files.first_of_name(rows, "filename", ["created_at", "file_id"], ["job_id"]).select("job_id", "filename", "file_id", "size")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Exports in the shape of another scanner's results: one document per record, one result each."""
    payload = F.to_json(F.struct(F.array(F.struct(
        F.col("rule_id").alias("check_id"), F.col("context.file_path").alias("path"), F.struct(F.col("line_number").alias("line"), F.col("column_number").alias("col")).alias("start"),
        F.struct(F.col("details").alias("message"), F.col("severity").alias("severity"), F.col("code_snippet").alias("lines"), F.struct(F.array("cwe_id").alias("cwe"), F.col("review_guidance").alias("owasp"), F.col("confidence")).alias("metadata")).alias("extra"),
    )).alias("results")))
    return load(spark, d, "findings").select("finding_id", payload.alias("payload"))


def s12_external_results(spark: SparkSession, d: str) -> DataFrame:
    out = external.from_external(external.results(_results(spark, d)), "/srv/scan")
    return out.select("finding_id", F.col("pos").cast("bigint").alias("pos"), "rule_id", "path", "severity", "location", "details", "cwe_id", "review_guidance", "confidence", "dependency_file")


def proj14_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Weakness and category given as a text, as a list, as a number or not at all; lists of categories dropped on request."""
    cwe = F.when(F.pmod("finding_id", F.lit(4)) == 0, F.to_json(F.struct(F.col("cwe_id").alias("cwe")))).when(F.pmod("finding_id", F.lit(4)) == 1, F.to_json(F.struct(F.array("cwe_id", F.lit("CWE-1")).alias("cwe"), F.array("review_guidance").alias("owasp")))).when(F.pmod("finding_id", F.lit(4)) == 2, F.lit('{"cwe": 79}')).otherwise(F.lit("{}"))
    rows = load(spark, d, "findings").select("finding_id", F.concat(F.lit('{"results": [{"check_id": "r", "extra": {"metadata": '), cwe, F.lit("}}]}")).alias("payload"))
    held = external.results(rows)
    return external.from_external(held, owasp="text").select("finding_id", "cwe_id", "review_guidance", "severity", "code_snippet")


def proj01_language(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").select("file_id", lang.by_extension(F.col("path")).alias("language"), lang.web_by_extension(F.col("filename")).alias("web_language"), lang.extension_for(F.lower("language")).alias("ending"))


def proj03_content_language(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").select("file_id", lang.by_content(F.col("content")).alias("language"), lang.detect(F.col("path"), F.col("content")).alias("detected"))


def proj06_rules(spark: SparkSession, d: str) -> DataFrame:
    out = rules.dispatch(rules.normalized(load(spark, d, "scan_rules")))
    return out.select("rule_id", "language", "rule_type", "evaluator", "severity", "confidence", F.size("tags").cast("bigint").alias("n_tags"))


def filter03_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.choose(rules.normalized(load(spark, d, "scan_rules")), category="Security", severity="HIGH").select("rule_id", "category", "severity")


def u1_rule_set(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with the default rules added and one rule switched off."""
    table = rules.extend(load(spark, d, "scan_rules"), rules.defaults(spark).drop("metadata", "source_file"), ["js-xss"])
    return table.groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled_rules"))


def proj11_places(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").filter("context.file_path is not null")
    place = text.location(F.col("context.file_path"), F.col("line_number"), F.col("column_number"))
    return rows.select("finding_id", place.alias("place"), text.fingerprint(F.col("rule_id"), place).alias("fingerprint"), text.absolute(F.col("context.file_path"), "/srv/scan").alias("full_path"), text.label(F.col("code_snippet")).alias("label"))


def proj13_severities(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").groupBy("severity").agg(F.count("*").alias("n"))
    return rows.select("severity", "n", *(sev.normalize(F.col("severity"), m).alias(m) for m in ("own", "external", "both", "web")), sev.rank(F.col("severity")).cast("bigint").alias("severity_rank"))


def proj17_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").filter("code_snippet is not null")
    return rows.select("finding_id", sev.confidence_score(F.col("severity"), F.col("code_snippet"), F.col("code_snippet")).alias("score"))


def proj20_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "scans")
    return rows.select("scan_id", text.duration_text(F.lit(0), F.col("duration_ns") / 1000000).alias("took"), text.progress(F.col("vulnerabilities_found"), F.col("files_processed")).cast("bigint").alias("percent"), text.valid_id(F.col("scan_id")).alias("valid"))


def proj23_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Whether paths could be output files and, behind a host, addresses."""
    rows = load(spark, d, "source_files")
    path = F.when(F.pmod("file_id", F.lit(3)) == 0, F.concat("path", F.lit(".json"))).otherwise(F.col("path"))
    return rows.select("file_id", text.valid_output(path).alias("output"), text.valid_endpoint(F.concat(F.lit("https://scan.example:8080/"), path)).alias("endpoint"))


def proj22_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").groupBy("category").agg(F.count("*").alias("n"))
    return rows.select("category", "n", text.category_key(F.col("category")).alias("key"), text.category_name(F.col("category")).alias("name"))


def j1_matches(spark: SparkSession, d: str) -> DataFrame:
    out = match.as_findings(matched(spark, d), load(spark, d, "scan_rules"))
    return out.select("file_id", "rule_id", F.col("line_no").cast("bigint").alias("line_no"), "column_no", "matched", "location", "dependency_file", sev.normalize(F.col("severity")).alias("severity"))


def j1_byte_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the trimmed line counted in bytes."""
    out = match.find_matches(scanned_lines(spark, d), usable_rules(spark, d), match_on="trimmed", unit="byte")
    return out.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("column_no").alias("columns"))


def j1_ignoring_case(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the automaton dialect with letter case ignored."""
    good, _ = rules.compiled(rules.choose(rules.normalized(load(spark, d, "scan_rules"))), "linear", "(?i)")
    out = match.find_matches(scanned_lines(spark, d), good)
    return out.select("file_id", "rule_id", F.col("line_no").cast("bigint").alias("line_no"), "column_no", "matched")


def j1_look_around(spark: SparkSession, d: str) -> DataFrame:
    """Patterns with look-around, which only this engine's dialect can run."""
    chosen = rules.choose(rules.normalized(load(spark, d, "scan_rules"))).filter(F.col("pattern").rlike(r"\(\?[=!<>]"))
    good, _ = rules.compiled(chosen, "java", "(?i)")
    return match.find_matches(scanned_lines(spark, d), good).select("file_id", "rule_id", "line_no", "column_no", "matched")


def j1_quantified(spark: SparkSession, d: str) -> DataFrame:
    """Rules whose patterns count, name classes and spell characters by number."""
    table = spark.createDataFrame([(i, lang_, p) for lang_ in QUANTIFIED_LANGUAGES for i, p in QUANTIFIED], "rule_id string, language string, pattern string")
    good, _ = rules.compiled(table, "linear")
    out = match.find_matches(scanned_lines(spark, d), good)
    return out.select("file_id", "rule_id", F.col("line_no").cast("bigint").alias("line_no"), "column_no", "matched")


def j1_every_language(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalogue on the trimmed lines of every file whatever its language, with a score."""
    found = match.find_matches(scanned_lines(spark, d), usable_rules(spark, d), per_language=False, match_on="trimmed")
    known = found.join(small(load(spark, d, "scan_rules").select("rule_id", "severity"), rules.CATALOGUE_BOUND), "rule_id")
    return match.scored(known).select("file_id", "rule_id", F.col("line_no").cast("bigint").alias("line_no"), "column_no", "score")


def catalogue_findings(spark: SparkSession, d: str) -> DataFrame:
    """A whole scan: the files that discovery keeps, their lines, every usable rule of the catalogue, findings."""
    kept = files.discover(scanned(spark, d), "path", "full")
    rows = match.find_matches(files.lines(kept, "file_id", "path", "language"), usable_rules(spark, d))
    return match.as_findings(rows, rules.normalized(load(spark, d, "scan_rules")))


def x4_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan's findings, whole: what is matched where, and what its rule says about it."""
    return catalogue_findings(spark, d).select("file_id", "rule_id", F.col("line_no").cast("bigint").alias("line_no"), "column_no", "matched", "category", "severity", "details", "remediation", "cwe_id", "review_guidance", "confidence", "location", "dependency_file", "code_snippet")


def x4_report(spark: SparkSession, d: str) -> DataFrame:
    """The scan's report as rows: files read, rules loaded, findings in all and by severity, category and file."""
    found = catalogue_findings(spark, d).select("severity", "category", text.basename(F.col("path")).alias("file"))
    by = report.breakdown(found, "severity", "category", "file").select(F.col("dimension").alias("part"), "value", F.col("findings").alias("n"))
    kept = files.discover(scanned(spark, d), "path", "full")
    total = [(found.agg(F.count("*").alias("n")), "vulnerabilities_found"), (kept.agg(F.count("*").alias("n")), "files_processed"), (report.rules_loaded(kept, usable_rules(spark, d)).select(F.col("rules_loaded").alias("n")), "rules_loaded")]
    for df, name in total:
        by = by.unionByName(df.select(F.lit("total").alias("part"), F.lit(name).alias("value"), "n"))
    return by


def x4_default_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan without a catalogue, findings per file and rule."""
    return default_matches(spark, d).groupBy("path", "rule_id", "severity").agg(F.count("*").alias("findings"), F.min("line_no").cast("bigint").alias("first_line"))


def e2_occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_files").filter("content is not null")
    return rows.select("file_id", text.occurrences(F.col("content"), "return").cast("bigint").alias("returns"), text.occurrences(F.col("content"), "((").cast("bigint").alias("pairs"))


QUERIES = {
    "s1_discover": _discover("full"), "s2_discover_hidden": _discover("hidden"), "s3_discover_plain": _discover("plain"), "s4_read_text": s4_read_text, "s4_lines": s4_lines, "s5_rule_files": s5_rule_files, "proj08_patterns": proj08_patterns, "s6_rule_quarantine": s6_rule_quarantine,
    "s7_default_rules": s7_default_rules, "s7_web_rules": s7_web_rules, "x2_rule_files": x2_rule_files, "s10_uploads": s10_uploads, "s11_first_uploads": s11_first_uploads, "s12_external_results": s12_external_results, "proj14_metadata": proj14_metadata, "proj23_shapes": proj23_shapes, "proj01_language": proj01_language, "proj03_content_language": proj03_content_language,
    "proj06_rules": proj06_rules, "filter03_rules": filter03_rules, "u1_rule_set": u1_rule_set, "proj11_places": proj11_places, "proj13_severities": proj13_severities, "proj17_confidence": proj17_confidence, "proj20_formats": proj20_formats,
    "proj22_categories": proj22_categories, "j1_matches": j1_matches, "j1_byte_columns": j1_byte_columns, "j1_ignoring_case": j1_ignoring_case, "j1_look_around": j1_look_around, "j1_quantified": j1_quantified, "j1_every_language": j1_every_language, "x4_scan": x4_scan, "x4_report": x4_report, "x4_default_scan": x4_default_scan, "e2_occurrences": e2_occurrences,
}

_OWN = "case when upper(trim({0})) in ('CRITICAL','HIGH','MEDIUM','LOW','INFO') then upper(trim({0})) else 'MEDIUM' end"
_EXTERNAL = "case upper(trim({0})) when 'ERROR' then 'HIGH' when 'WARNING' then 'MEDIUM' when 'INFO' then 'LOW' else 'MEDIUM' end"
_BASE = r"regexp_extract({0}, '([^/\\]*)$', 1)"
_ABS = r"regexp_replace(regexp_replace(case when regexp_matches({0}, '^(?:/|[A-Za-z]:)') then {0} else '/srv/scan/' || {0} end, '/(?:\./)+', '/', 'g'), '/{{2,}}', '/', 'g')"
_SCORE = "round(least(0.95, greatest(0.1, 0.5 + case lower({0}) when 'critical' then 0.2 when 'high' then 0.15 else 0 end + case when contains(lower({1}), 'password') or contains(lower({1}), 'secret') then 0.2 else 0 end + case when contains(lower({1}), 'user') or contains(lower({1}), 'input') then 0.1 else 0 end - case when contains({2}, '//') or contains({2}, '#') then 0.1 else 0 end))::double, 4)"
_KEYWORD = {name: " + ".join(f"(length(h) - length(replace(h, {sql_text(w)}, ''))) // {len(w)}" for w in words) for name, words in lang.KEYWORDS.items()}
_BY_CONTENT = f"""
scores as (select file_id, path, {', '.join(f'{e} as s_{n}' for n, e in _KEYWORD.items())} from (select file_id, path, lower(substring(coalesce(content, ''), 1, {lang.CONTENT_WINDOW})) as h from source_files)),
told as (select *, case greatest({', '.join(f's_{n}' for n in _KEYWORD)}) when 0 then 'unknown' {' '.join(f"when s_{n} then '{n}'" for n in _KEYWORD)} end as language from scores)
"""
_DEFAULTS = f"(values {_values((r[0], r[1], r[2], r[3], r[4]) for r in rules.DEFAULTS)}) as t(rule_id, language, rule_type, pattern, severity)"
_DEFAULT_MATCH = f"""
with {LINES_SQL}, usable as (select * from {_DEFAULTS} where rule_type = 'regex'), hits as (
  select l.file_id, l.path, l.line_no, l.line, r.rule_id, r.severity, regexp_extract_all(line, pattern) as ms, string_split_regex(line, pattern) as gs
  from lines l join usable r on @ON@ where regexp_matches(line, pattern)
), matches as (
  select *, ms[k] as matched, 1 + list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) as column_no
  from (select *, unnest(generate_series(1, len(ms))) as k from hits)
)
"""
_KEPT = _discover_sql("full").split(" where ", 1)[1]
_SCAN_SQL = MATCH_SQL.replace("where content is not null", f"where content is not null and {_KEPT}") + f""", scan as (
  select m.file_id, m.path, m.rule_id, line_no, column_no::bigint as column_no, matched, category, {_OWN.format("coalesce(r.severity, '')")} as severity, message as details, remediation, cwe[1] as cwe_id, owasp as review_guidance, coalesce(nullif(upper(trim(confidence)), ''), 'HIGH') as confidence,
    concat_ws(':', {_BASE.format('m.path')}, line_no, column_no::bigint) as location, {TRIM_SQL.format('line')} as code_snippet from matches m join scan_rules r using (rule_id)) """
SQL = {
    "s1_discover": _discover_sql("full"),
    "s2_discover_hidden": _discover_sql("hidden"),
    "s3_discover_plain": _discover_sql("plain"),
    "s4_read_text": "select file_id, md5('(' || replace(content, chr(65533), '') || '(') as text, octet_length(encode(content)) + 6 as bytes from source_files where content is not null",
    "s5_rule_files": """with r as (select *, length(rule_id) % 7 = 0 or length(rule_id) % 11 = 0 as broken from scan_rules)
      select rule_id || '.yaml' as file, case when not broken then rule_id end as rule_id, case when not broken then lower(language) end as language, case when not broken then coalesce(category, 'Security') end as category, case when not broken then coalesce(rule_type, 'semgrep') end as rule_type, case when not broken then pattern end as pattern,
      case when not broken then coalesce(severity, 'MEDIUM') end as severity, case when not broken then cwe[1] end as cwe_id, case when not broken then coalesce(owasp, '') end as owasp, case when not broken then coalesce(confidence, 'HIGH') end as confidence, case when not broken then coalesce(len(tags), 0) end as n_tags, broken from r""",
    "proj08_patterns": "select rule_id, case length(rule_id) % 3 when 0 then 'a.b(...)' when 1 then 'c(...)' end as pattern, 'MEDIUM' as severity, 'Security' as category from scan_rules",
    "s4_lines": f"with {LINES_SQL} select file_id, count(*) as n_lines, sum(length(line))::bigint as characters, max(line_no) as last_line from lines group by file_id",
    "s6_rule_quarantine": """select rule_id, case when pattern is null or pattern = '' then 'no pattern' when regexp_matches(pattern, '\\(\\?(=|!|<=|<!|>)|\\\\[12]') then 'look-around or back-reference' else 'broken' end as problem
      from scan_rules where pattern is null or pattern = '' or regexp_matches(pattern, '\\(\\?(=|!|<=|<!|>)|\\\\[12]') or try(regexp_matches('', pattern)) is null""",
    "s7_default_rules": f"select rule_id, language, rule_type, pattern, severity, 'HIGH' as confidence from {_DEFAULTS}",
    "s7_web_rules": "select rule_id, l as language, case when length(rule_id) % 2 = 0 then '(?i)' || pattern else pattern end as pattern, upper(severity) as severity, coalesce(message, 'n') as message, string_split(category, ' - ')[1] as owasp, coalesce(enabled, true) as enabled from scan_rules, (select unnest(['java', 'python']) as l)",
    "x2_rule_files": """select rule_id, md5('{"rules":[{' || concat_ws(',', '"id":' || to_json(rule_id), '"languages":[' || coalesce(to_json(language), 'null') || ']', '"message":' || to_json(message), '"severity":' || to_json(upper(severity)), '"pattern":' || to_json(pattern)) || '}]}') as document from scan_rules where coalesce(pattern, '') <> ''""",
    "s10_uploads": f"select file_id, filename, size from source_files where {EXT_SQL.format('filename')} in ({', '.join(sql_text(e) for e in files.UPLOAD_EXTENSIONS)}) and size <= {files.UPLOAD_BYTES}",
    "s11_first_uploads": "select job_id, filename, file_id, size from source_files where filename is not null qualify row_number() over (partition by job_id, filename order by created_at, file_id) = 1",
    "s12_external_results": f"""select finding_id, 0::bigint as pos, rule_id, {_ABS.format('p')} as path, {_EXTERNAL.format("coalesce(severity, '')")} as severity, concat_ws(':', {_BASE.format(_ABS.format('p'))}, line_number, column_number) as location,
      coalesce(nullif(details, ''), 'No description available') as details, cwe_id, review_guidance, coalesce(confidence, 'MEDIUM') as confidence, md5(concat_ws(':', rule_id, concat_ws(':', {_BASE.format(_ABS.format('p'))}, line_number, column_number))) as dependency_file
      from (select *, context.file_path as p from findings)""",
    "proj14_metadata": "select finding_id, case finding_id % 4 when 0 then cwe_id when 1 then cwe_id end as cwe_id, null::varchar as review_guidance, 'MEDIUM' as severity, 'Content unavailable' as code_snippet from findings",
    "proj23_shapes": "select file_id, coalesce(ends_with(p, '.json') and not contains(p, '..'), false) as output, coalesce(regexp_full_match('https://scan.example:8080/' || p, 'https?://[a-zA-Z0-9.:\\-/?=&]+'), false) as endpoint from (select file_id, case when file_id % 3 = 0 then path || '.json' else path end as p from source_files)",
    "proj01_language": f"select file_id, {LANG_SQL.format('path')} as language, {WEB_SQL.format('filename')} as web_language, case lower(language) {' '.join(f'when {sql_text(n)} then {sql_text(e[0])}' for n, e in lang.EXTENSIONS.items())} else '.txt' end as ending from source_files",
    "proj03_content_language": f"with {_BY_CONTENT} select file_id, language, coalesce({LANG_SQL.format('path')}, language) as detected from told",
    "proj06_rules": f"""select rule_id, lower(trim(language)) as language, t as rule_type, case when t in ('regex', 'semgrep', 'graph') then t else 'none' end as evaluator, {_OWN.format("coalesce(severity, '')")} as severity, coalesce(nullif(upper(trim(confidence)), ''), 'HIGH') as confidence, coalesce(len(tags), 0) as n_tags
      from (select *, coalesce(nullif(lower(trim(rule_type)), ''), 'semgrep') as t from scan_rules)""",
    "filter03_rules": f"""select rule_id, category, severity from (select rule_id, category, enabled, {_OWN.format("coalesce(severity, '')")} as severity from scan_rules) where coalesce(enabled, true) and contains(category, 'Security') and severity = 'HIGH'""",
    "u1_rule_set": f"select lower(language) as language, count(*) as rules, count(*) filter (on_) as enabled_rules from (select language, coalesce(enabled, true) and rule_id <> 'js-xss' as on_ from scan_rules union all select language, rule_id <> 'js-xss' from {_DEFAULTS}) group by 1",
    "proj11_places": f"""select finding_id, place, md5(concat_ws(':', rule_id, place)) as fingerprint, {_ABS.format('p')} as full_path, case when length(code_snippet) > 30 then substring(code_snippet, 1, 30) || '...' else code_snippet end as label
      from (select *, concat_ws(':', {_BASE.format('p')}, line_number, column_number) as place from (select *, context.file_path as p from findings) where p is not null)""",
    "proj13_severities": f"""select severity, n, {_OWN.format("coalesce(severity, '')")} as own, {_EXTERNAL.format("coalesce(severity, '')")} as "external", case when upper(trim(severity)) = 'ERROR' then 'HIGH' when upper(trim(severity)) = 'WARNING' then 'MEDIUM' else {_OWN.format("coalesce(severity, '')")} end as both,
      lower(replace({_OWN.format("coalesce(severity, '')")}, 'INFO', 'LOW')) as web, coalesce(list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity) - 1, 5)::bigint as severity_rank from (select severity, count(*) as n from findings group by 1)""",
    "proj17_confidence": f"select finding_id, {_SCORE.format('severity', 'code_snippet', 'code_snippet')} as score from findings where code_snippet is not null",
    "proj20_formats": r"select scan_id, case when duration_ns is null then 'N/A' else concat(floor(duration_ns / 1000000 / 1000)::bigint, 's') end as took, case when files_processed > 0 then floor(vulnerabilities_found * 100.0 / files_processed + 0.5)::bigint else 0 end as percent, coalesce(regexp_matches(scan_id, '^[a-f0-9\-]{36}$'), false) as valid from scans",
    "proj22_categories": "select category, n, string_split(category, ' - ')[1] as key, string_split(category, ' - ')[2] as name from (select category, count(*) as n from findings group by 1)",
    "j1_matches": MATCH_SQL + f"""select m.file_id, m.rule_id, line_no, column_no::bigint as column_no, matched, place as location, md5(concat_ws(':', m.rule_id, place)) as dependency_file, {_OWN.format("coalesce(r.severity, '')")} as severity
      from (select *, concat_ws(':', {_BASE.format('path')}, line_no, column_no::bigint) as place from matches) m join scan_rules r using (rule_id)""",
    "j1_byte_columns": MATCH_SQL.replace("unnest(ls) as line", f"unnest(list_transform(ls, lambda x: {TRIM_SQL.format('x')})) as line").replace("lambda x: length(x)", "lambda x: octet_length(encode(x))") + "select rule_id, count(*) as n, sum(column_no)::bigint as columns from matches group by 1",
    "j1_ignoring_case": MATCH_SQL.replace("lower(language) as language, pattern from", "lower(language) as language, '(?i)' || pattern as pattern from") + "select file_id, rule_id, line_no, column_no::bigint as column_no, matched from matches",
    "j1_quantified": MATCH_SQL.replace(RULES_SQL, f"usable as (select r.rule_id, l.language, r.pattern from (values {_values(QUANTIFIED)}) r(rule_id, pattern), (select unnest({list(QUANTIFIED_LANGUAGES)}) as language) l)") + "select file_id, rule_id, line_no, column_no::bigint as column_no, matched from matches",
    "j1_every_language": MATCH_SQL.replace("unnest(ls) as line", f"unnest(list_transform(ls, lambda x: {TRIM_SQL.format('x')})) as line").replace("on l.language = r.language", "on true") + f"select file_id, m.rule_id, line_no, column_no::bigint as column_no, {_SCORE.format('severity', 'matched', 'line')} as score from matches m join scan_rules using (rule_id)",
    "x4_scan": _SCAN_SQL + "select file_id, rule_id, line_no, column_no, matched, category, severity, details, remediation, cwe_id, review_guidance, confidence, location, md5(concat_ws(':', rule_id, location)) as dependency_file, code_snippet from scan",
    "x4_report": _SCAN_SQL + f"""select 'severity' as part, severity as value, count(*) as n from scan group by 2 union all select 'category', category, count(*) from scan group by 2 union all select 'file', {_BASE.format('path')}, count(*) from scan group by 2
      union all select 'total', 'vulnerabilities_found', count(*) from scan union all select 'total', 'files_processed', count(*) from source_files where {_KEPT} union all select 'total', 'rules_loaded', count(*) from usable where language in (select {LANG_SQL.format('path')} from source_files where {_KEPT})""",
    "x4_default_scan": _DEFAULT_MATCH.replace("@ON@", "l.language = r.language") + "select path, rule_id, severity, count(*) as findings, min(line_no) as first_line from matches group by all",
    "e2_occurrences": "select file_id, (length(content) - length(replace(content, 'return', ''))) // 6 as returns, (length(content) - length(replace(content, '((', ''))) // 2 as pairs from source_files where content is not null",
}
