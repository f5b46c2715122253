"""Rules as rows: loading, normalizing, checking and choosing (sources 5 to 7; projections 6 to 8; filters 1 to 3; U1, U2)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.severity import normalize
from sieveline.functions.text import required_literal
from sieveline.session import cut

RULE = "rule_id string, language string, category string, rule_type string, pattern string, severity string, message string, remediation string, cwe array<string>, owasp string, confidence string, tags array<string>, metadata map<string,string>, source_file string, enabled boolean"
LOADED = "rule_id string, language string, pattern string, literal string, matches_empty boolean, problem string"
#: What the driver reads of a catalogue at most; catalogues are written by hand and have hundreds of rules.
CATALOGUE_BOUND = 50_000

# The rules a scan starts with when it has no catalogue.
DEFAULTS = [
    ("py-sql-injection", "python", "regex", r"""(execute|cursor\.execute|query)\s*\(\s*["'].*%.*["']""", "HIGH", "Potential SQL injection vulnerability", "Use parameterized queries", "CWE-89", "A03:2021"),
    ("py-command-injection", "python", "regex", r"(os\.system|subprocess\.call|subprocess\.run|os\.popen)\s*\([^)]*\+", "HIGH", "Potential command injection vulnerability", "Use subprocess with shell=False and validate inputs", "CWE-78", "A03:2021"),
    ("java-sql-injection", "java", "regex", r"""(executeQuery|executeUpdate|execute)\s*\(\s*["'].*\+""", "HIGH", "Potential SQL injection vulnerability", "Use PreparedStatement with parameter binding", "CWE-89", "A03:2021"),
    ("java-println", "java", "semgrep", "System.out.println(...)", "LOW", "Avoid using System.out.println in production code", "Use a logging framework like SLF4J", "CWE-532", "A09:2021"),
    ("js-xss", "javascript", "regex", r"(innerHTML|outerHTML|document\.write)\s*=.*\+", "MEDIUM", "Potential XSS vulnerability", "Sanitize user input before DOM insertion", "CWE-79", "A03:2021"),
]


def _text(value, default: str = "") -> str:
    return value if isinstance(value, str) else default


def _first(value) -> str:
    if isinstance(value, list):
        value = next((x for x in value if isinstance(x, str)), "")
    return _text(value)


def project(raw: dict, language: str, source_file: str) -> tuple | None:
    """One rule of a file with its defaults; a value of the wrong type counts as missing (projection 7)."""
    if not isinstance(raw, dict):
        return None
    meta = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    pattern = raw.get("pattern")
    if isinstance(pattern, dict):  # projection 8
        pattern = pattern.get("pattern")
    cwe = raw.get("cwe", meta.get("cwe"))
    return (
        _text(raw.get("id")), language, _text(raw.get("category"), _text(meta.get("category"), "Security")), _text(raw.get("type"), "semgrep"), pattern if isinstance(pattern, str) else None,
        _text(raw.get("severity"), "MEDIUM"), _text(raw.get("message")), _text(raw.get("fix")), [x for x in (cwe if isinstance(cwe, list) else [cwe]) if isinstance(x, str)],
        _first(raw.get("owasp", meta.get("owasp"))), _text(raw.get("confidence"), _text(meta.get("confidence"), "HIGH")), [x for x in raw.get("tags") or [] if isinstance(x, str)] if isinstance(raw.get("tags"), list) else [],
        {str(k): v if isinstance(v, str) else str(v) for k, v in meta.items()}, source_file, True,
    )


PARSED = f"{RULE}, reason string"


def parse_files(contents: DataFrame) -> DataFrame:
    """Rules of rule files (path, content: bytes or text), parsed where the files are (sources 5 and 6; projections 7 and 8).

    The language is the first folder below the catalogue's root (column `language`). One row per rule with an identifier;
    a file that can't be parsed, or holds no list of rules, is one row with its reason and no rule.
    """
    names = [x.split()[0] for x in PARSED.replace("map<string,string>", "map").split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml  # gated: only this loader needs it

        load = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rows: list[tuple] = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                try:
                    held = yaml.load(content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or "", load)  # noqa: S506
                    entries = held["rules"] if isinstance(held, dict) and isinstance(held.get("rules"), list) else None
                    if entries is None:
                        raise ValueError("no list of rules")
                    rows += [(*r, None) for r in (project(x, language, path) for x in entries) if r and r[0]]
                except (yaml.YAMLError, ValueError, RecursionError) as error:
                    rows.append((*[None] * 13, path, None, str(error).split("\n")[0] or "broken"))
            yield pd.DataFrame(rows, columns=names)

    return contents.select("path", "language", "content").mapInPandas(parse, PARSED)


def from_yaml(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rules, quarantine) of the .yaml and .yml files below folder/<language>, on any file system Spark reads (sources 5 and 6, U2)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_extract(F.col("path"), rf"{re.escape(folder.rstrip('/').split('/')[-1])}/([^/]+)/", 1)
    kept = files.filter(F.lower("path").rlike(r"\.ya?ml$")).select("path", below.alias("language"), "content")
    parsed = cut(parse_files(kept), "rule-files")
    return parsed.filter("reason is null").drop("reason"), parsed.filter("reason is not null").select(F.col("source_file").alias("path"), "reason")


def defaults(spark: SparkSession) -> DataFrame:
    """The rules of a scan without a catalogue (source 7)."""
    rows = [(i, lang, "Security", kind, pattern, sev, msg, fix, [cwe], owasp, "HIGH", [], {}, None, True) for i, lang, kind, pattern, sev, msg, fix, cwe, owasp in DEFAULTS]
    return spark.createDataFrame(rows, RULE)


WEB_RULE = "rule_id string, name string, description string, category string, severity string, pattern string, flags string, recommendation string, enabled boolean"


def from_web(rows: DataFrame, languages: Iterable[str] | None = None) -> DataFrame:
    """Rules of a web catalogue (WEB_RULE rows) as rules of the engine: flags become part of the pattern, severities upper
    case, the category's key the OWASP one. They name no language: they are for find_matches(per_language=False), or one row
    for each of `languages`."""
    flags = F.array_join(F.array_compact(F.array(*(F.when(F.contains("flags", F.lit(f)), F.lit(f)) for f in "ims"))), "")
    tongue = F.explode(F.array(*map(F.lit, languages))) if languages else F.lit(None).cast("string")
    return rows.select(
        "rule_id", tongue.alias("language"), "category", F.lit("regex").alias("rule_type"), F.when(F.coalesce(flags, F.lit("")) == "", F.col("pattern")).otherwise(F.concat(F.lit("(?"), flags, F.lit(")"), "pattern")).alias("pattern"), F.upper("severity").alias("severity"),
        F.coalesce("description", "name").alias("message"), F.col("recommendation").alias("remediation"), F.array().cast("array<string>").alias("cwe"), F.element_at(F.split("category", " - "), 1).alias("owasp"), F.lit("HIGH").alias("confidence"), F.array().cast("array<string>").alias("tags"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


def as_rule_files(rules: DataFrame) -> DataFrame:
    """(rule_id, document): each rule as a file of its own for an external matcher (X2); one without a pattern has none."""
    rule = F.struct(F.col("rule_id").alias("id"), F.array("language").alias("languages"), "message", F.upper("severity").alias("severity"), "pattern")
    return rules.filter(F.coalesce("pattern", F.lit("")) != "").select("rule_id", F.to_json(F.struct(F.array(rule).alias("rules"))).alias("document"))


def normalized(rules: DataFrame) -> DataFrame:
    """Severity in the vocabulary, confidence HIGH and no tags where missing, names in lower case (projection 6)."""
    return rules.withColumns({
        "language": F.lower(F.trim("language")),
        "severity": normalize(F.col("severity")),
        "confidence": F.coalesce(F.nullif(F.upper(F.trim("confidence")), F.lit("")), F.lit("HIGH")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "rule_type": F.coalesce(F.nullif(F.lower(F.trim("rule_type")), F.lit("")), F.lit("semgrep")),
    })


def of_type(rules: DataFrame, kind: str) -> DataFrame:
    """Rules of one type (filter 1)."""
    return rules.filter(F.col("rule_type") == kind)


def dispatch(rules: DataFrame) -> DataFrame:
    """Each rule with the evaluator it goes to: regex, semgrep, graph, or none for unknown types (filter 2)."""
    return rules.withColumn("evaluator", F.when(F.col("rule_type").isin("regex", "semgrep", "graph"), F.col("rule_type")).otherwise(F.lit("none")))


def choose(rules: DataFrame, ids: Iterable[str] | None = None, category: str | None = None, severity: str | None = None, enabled: bool | None = True) -> DataFrame:
    """Enabled rules, by identifier, by part of the category, by exact severity (filter 3)."""
    if enabled is not None:
        rules = rules.filter(F.coalesce("enabled", F.lit(True)) == enabled)
    if ids is not None:
        rules = rules.filter(F.col("rule_id").isin(list(ids)))
    if category is not None:
        rules = rules.filter(F.contains("category", F.lit(category)))
    return rules if severity is None else rules.filter(F.col("severity") == severity)


def extend(rules: DataFrame, own: DataFrame, disabled: Iterable[str] = ()) -> DataFrame:
    """Own rules beside the given ones, some of them switched off."""
    return rules.unionByName(own, allowMissingColumns=True).withColumn("enabled", F.coalesce("enabled", F.lit(True)) & ~F.col("rule_id").isin(list(disabled)))


def compiled(rules: DataFrame, dialect: str = "java", flags: str = "") -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine) of regular-expression rules, so that no pattern fails a query at run time (trap 5).

    dialect linear: look-around and back-references are problems too, as in automaton engines (trap 4). Each usable rule
    carries a text its matches must hold and whether it can match nothing.
    """
    spark = rules.sparkSession
    rows = rules.select("rule_id", F.lower("language").alias("language"), "pattern").limit(CATALOGUE_BOUND + 1).collect()
    if len(rows) > CATALOGUE_BOUND:
        raise ValueError(f"a catalogue of more than {CATALOGUE_BOUND} rules can't be broadcast; match it part by part")
    read = [(r.rule_id, r.language, r.pattern, *_checked(spark, flags, r.pattern, dialect)) for r in rows]
    out = [(i, lang, None if pattern is None else flags + pattern, literal, empty, problem) for i, lang, pattern, literal, empty, problem in read]
    return spark.createDataFrame([r for r in out if not r[5]], LOADED), spark.createDataFrame([r for r in out if r[5]], LOADED)


_known: dict[tuple[str, str, str], tuple[str | None, bool, str | None]] = {}


def _checked(spark: SparkSession, flags: str, pattern: str | None, dialect: str) -> tuple[str | None, bool, str | None]:
    """(required literal, matches empty text, problem) of a pattern; each is compiled once a session."""
    if not pattern:
        return None, False, "no pattern"
    if dialect == "linear" and any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!", "(?>", "\\1", "\\2")):
        return None, False, "look-around or back-reference"
    if (key := (flags, pattern, dialect)) not in _known:
        if len(_known) > CATALOGUE_BOUND:
            _known.clear()
        try:
            empty = bool(spark.sparkContext._jvm.java.util.regex.Pattern.compile(flags + pattern).matcher("").find())
            _known[key] = (None if empty else required_literal(pattern), empty, None)
        except Exception as error:
            _known[key] = (None, False, str(getattr(error, "java_exception", error)).split("\n")[0].split(": ", 1)[-1])
    return _known[key]
