"""Rules against lines: the theta join every scan rests on (joins 1 to 2; function E1; compositions X4, X7, X9).

Lines meet the rules of their language by a broadcast join (rule tables are catalogues of bounded size), then a residual
test: first the text a match must hold, which costs a substring search, then the regular expression. All matches of a
line with their columns come from two array functions; no Python is on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.severity import confidence_score
from sieveline.functions.text import fingerprint, location, trim_all
from sieveline.session import small

#: Matches summed up at once.
BLOCK = 128
#: Rules that may travel to the findings at most; more are joined by shuffle.
CATALOGUE_BOUND = 50_000


def spans(line: str, pattern: str, unit: str = "codepoint") -> Column:
    """Array of (column, matched) of all matches, columns 1-based in code points or bytes (E1, trap 1).

    The gaps between matches and the matches themselves, laid end to end, give each match's place. Matches are summed up in
    blocks of BLOCK and the blocks once more, so a text with n matches costs about n * (BLOCK + n / BLOCK²) steps, not n².
    Right for patterns that can't match nothing.
    """
    length = "octet_length" if unit == "byte" else "length"
    return F.expr(f"""
        flatten(transform(transform(array(filter(zip_with(split({line}, {pattern}, -1), regexp_extract_all({line}, {pattern}, 0), (g, m) -> struct(g, m)), x -> x.m is not null)), all ->
          transform(sequence(0, greatest(size(all) - 1, 0) div {BLOCK}), k ->
            aggregate(slice(all, k * {BLOCK} + 1, {BLOCK}), struct(0L as at, cast(array() as array<struct<column_no:bigint,matched:string>>) as found),
              (a, x) -> struct(a.at + {length}(x.g) + {length}(x.m) as at, array_append(a.found, struct(a.at + {length}(x.g) as column_no, x.m as matched)) as found)))),
          blocks -> flatten(zip_with(blocks, slice(aggregate(blocks, array(1L), (s, b) -> array_append(s, element_at(s, -1) + b.at)), 1, size(blocks)), (b, s) -> transform(b.found, x -> struct(x.column_no + s as column_no, x.matched as matched))))))""")


def candidates(lines: DataFrame, rules: DataFrame, per_language: bool = True) -> DataFrame:
    """Lines beside the rules that match them. rules: as compiled() gives them; those that match nothing are left out.

    compiled() has checked the catalogue's size, so it may travel to the lines; each line is put in lower case once.
    """
    usable = rules.filter(~F.col("matches_empty"))
    usable = usable if per_language else usable.drop("language")
    low = lines.withColumn("_low", F.lower("line"))
    beside = low.join(F.broadcast(usable), "language") if per_language else low.crossJoin(F.broadcast(usable))
    # The literal test stands first: Spark evaluates conjunctions from the left.
    return beside.filter((F.col("literal").isNull() | F.contains("_low", F.col("literal"))) & F.rlike("line", F.col("pattern"))).drop("_low")


def find_matches(lines: DataFrame, rules: DataFrame, per_language: bool = True, match_on: str = "raw", unit: str = "codepoint") -> DataFrame:
    """Every match of every rule, one row each, with its column and text (join 1 and its variants).

    lines: line_no, line, language and any columns to keep. match_on trimmed: columns count in the trimmed line (trap 2).
    """
    if match_on == "trimmed":
        lines = lines.withColumn("line", trim_all(F.col("line")))
    hits = candidates(lines, rules, per_language).withColumn("m", F.explode(spans("line", "pattern", unit)))
    return hits.select("*", "m.column_no", "m.matched").drop("m", "pattern", "literal", "matches_empty", "problem")


def as_findings(matches: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Matches as findings: what the rule says about them, their place and their fingerprint (projections 11 and 12, X9)."""
    about = rules.select("rule_id", "category", "severity", F.col("message").alias("details"), "remediation", F.try_element_at("cwe", F.lit(1)).alias("cwe_id"), F.col("owasp").alias("review_guidance"), "confidence")
    placed = matches.join(small(about, CATALOGUE_BOUND), "rule_id").withColumn("location", location(F.col(path), F.col("line_no"), F.col("column_no")))
    return placed.withColumn("dependency_file", fingerprint(F.col("rule_id"), F.col("location"))).withColumn("code_snippet", trim_all(F.col("line")))


def scored(matches: DataFrame) -> DataFrame:
    """Matches with the score of projection 17 (the client's variant of join 1)."""
    return matches.withColumn("score", confidence_score(F.col("severity"), F.col("matched"), F.col("line")))
