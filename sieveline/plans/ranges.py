"""Queries of the pattern algebra over source files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import algebra
from sieveline.session import load

CALL = r"\w+\.\w+\("
ASSIGN = r"\w+ = \w+"
STRING = r'"[^"\n]*"'
LINE = r"[^\n]*exec[^\n]*"
ASSIGNED_CALL = "$X = $F(...)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").filter("content is not null").select("file_id", "path", "language", "content")


def _out(ranges: DataFrame) -> DataFrame:
    return ranges.select("file_id", F.col("start").cast("bigint").alias("start_at"), F.col("stop").cast("bigint").alias("stop_at"), "text")


def d2_leaf(spark: SparkSession, d: str) -> DataFrame:
    return _out(algebra.leaf(files(spark, d), ASSIGN))


def d1_template(spark: SparkSession, d: str) -> DataFrame:
    """Calls on a new object's method with one argument or more, with the metavariables bound."""
    found = algebra.match_template(files(spark, d), ASSIGNED_CALL)
    return found.select("file_id", F.col("start").cast("bigint").alias("start_at"), F.col("stop").cast("bigint").alias("stop_at"), "X", "F")


def d3_all_of(spark: SparkSession, d: str) -> DataFrame:
    """Quoted texts whose first word is their last one: two patterns that bind the same name."""
    f = files(spark, d)
    first, last = algebra.bind(algebra.leaf(f, STRING), r"^\"(\w+)", "word"), algebra.bind(algebra.leaf(f, STRING), r"(\w+)\"$", "word")
    return _out(algebra.all_of(first, last, "word"))


def d4_any_of(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return _out(algebra.any_of(algebra.leaf(f, CALL), algebra.leaf(f, ASSIGN), algebra.leaf(f, CALL)))


def d5_none_of(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return _out(algebra.none_of(algebra.leaf(f, STRING), algebra.leaf(f, r'"SELECT[^"\n]*"')))


def d6_not_matching(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return _out(algebra.not_matching(algebra.leaf(f, CALL), algebra.leaf(f, LINE)))


def d7_inside(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return _out(algebra.inside(algebra.leaf(f, STRING), algebra.leaf(f, LINE)))


def d8_not_inside(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return _out(algebra.not_inside(algebra.leaf(f, STRING), algebra.leaf(f, LINE)))


def d9_where_matches(spark: SparkSession, d: str) -> DataFrame:
    bound = algebra.bind(algebra.leaf(files(spark, d), CALL), r"\w+\.(\w+)\(", "method")
    return _out(algebra.where_matches(bound, "method", "get|load|exec")).groupBy("text").agg(F.count("*").alias("n"))


def d10_where_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Texts in calls, if a template of statements matches what the argument is bound to."""
    bound = algebra.bind(algebra.leaf(files(spark, d), r'\w+\("[^"\n]*"'), r'\(("[^"\n]*")', "arg")
    return _out(algebra.where_template(bound, "arg", "WHERE $COL = ")).groupBy("text").agg(F.count("*").alias("n"))


def d11_where_compares(spark: SparkSession, d: str) -> DataFrame:
    bound = algebra.bind(algebra.leaf(files(spark, d), r"[<>] \d+"), r"(\d+)", "bound")
    return _out(algebra.where_compares(bound, "bound", "value > 1000 and value % 2 = 0"))


def d12_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").filter("rule_id is not null").select(F.col("rule_id")).distinct()
    return rows.select("rule_id", F.round(algebra.entropy(F.col("rule_id")), 4).alias("entropy"))


def d13_focus(spark: SparkSession, d: str) -> DataFrame:
    bound = algebra.bind(algebra.leaf(files(spark, d), r"getParameter\(\"\w+\"\)"), r'"(\w+)"', "name")
    return _out(algebra.focus(bound, "name"))


def d20_paths(spark: SparkSession, d: str) -> DataFrame:
    return algebra.for_paths(files(spark, d), ["src/**", "*.py"], ["**/tests/**"]).select("file_id", "path")


def d22_fix(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "findings").filter("code_snippet is not null")
    return rows.select("finding_id", algebra.fix(F.col("code_snippet"), r"\bMD5\b", "SHA256").alias("all_fixed"), algebra.fix(F.col("code_snippet"), "[aeiou]", "_", 1).alias("first_fixed"))


def d21_fix_template(spark: SparkSession, d: str) -> DataFrame:
    """Files with every getInstance call rewritten by a template that keeps its receiver."""
    f = files(spark, d)
    found = algebra.fix_template(algebra.match_template(f, '$X.getInstance("MD5")'), '$X.getInstance("SHA-256")', ["X"])
    return algebra.apply_fixes(f, found).select("file_id", F.md5("fixed").alias("fixed"))


def d22_first_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The first three vowels of each snippet rewritten."""
    rows = load(spark, d, "findings").filter("code_snippet is not null")
    return rows.select("finding_id", algebra.fix(F.col("code_snippet"), "[aeiou]", "_", 3).alias("fixed"))


def d23_options(spark: SparkSession, d: str) -> DataFrame:
    """A pattern whose rule ignores letter case."""
    return _out(algebra.leaf(files(spark, d), "select [^\\n\"]*", options={"generic_caseless": True}))


def d24_languages(spark: SparkSession, d: str) -> DataFrame:
    return algebra.for_language(files(spark, d), ["Java", "cpp"]).groupBy("language").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (d1_template, d2_leaf, d3_all_of, d4_any_of, d5_none_of, d6_not_matching, d7_inside, d8_not_inside, d9_where_matches, d10_where_pattern, d11_where_compares, d12_entropy, d13_focus, d20_paths, d21_fix_template, d22_fix, d22_first_fixes, d23_options, d24_languages)}


def _leaf(pattern: str) -> str:
    p = f"(?m){pattern}".replace("'", "''")
    return f"""(select file_id, p0 as start_at, p0 + length(text) as stop_at, text from (
      select file_id, ms[k] as text, list_sum(list_transform(gs[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)::bigint as p0
      from (select *, unnest(generate_series(1, len(ms))) as k from (select file_id, regexp_extract_all(content, '{p}') as ms, string_split_regex(content, '{p}') as gs from source_files where content is not null))))"""


_PLAIN, _NAMES = algebra.template(ASSIGNED_CALL)
_TEMPLATE = _PLAIN.replace("'", "''")
_IN = "o.file_id = i.file_id and o.start_at <= i.start_at and i.stop_at <= o.stop_at"
_SAME = "o.file_id = i.file_id and o.start_at = i.start_at and i.stop_at = o.stop_at"
_SELECTS = r'"SELECT[^"\n]*"'
SQL = {
    "d2_leaf": f"from {_leaf(ASSIGN)}",
    "d1_template": f"select file_id, start_at, stop_at, regexp_extract(text, '{_TEMPLATE}', 1) as X, regexp_extract(text, '{_TEMPLATE}', 2) as F from {_leaf(_PLAIN)}",
    "d3_all_of": f"select * from {_leaf(STRING)} where regexp_extract(text, '^\"(\\w+)', 1) <> '' and regexp_extract(text, '^\"(\\w+)', 1) = regexp_extract(text, '(\\w+)\"$', 1)",
    "d4_any_of": f"from {_leaf(CALL)} union from {_leaf(ASSIGN)}",
    "d5_none_of": f"select * from {_leaf(STRING)} i where not exists (select 1 from {_leaf(_SELECTS)} o where {_SAME})",
    "d6_not_matching": f"select * from {_leaf(CALL)} i where not exists (select 1 from {_leaf(LINE)} o where o.file_id = i.file_id and o.start_at < i.stop_at and i.start_at < o.stop_at)",
    "d7_inside": f"select * from {_leaf(STRING)} i where exists (select 1 from {_leaf(LINE)} o where {_IN})",
    "d8_not_inside": f"select * from {_leaf(STRING)} i where not exists (select 1 from {_leaf(LINE)} o where {_IN})",
    "d9_where_matches": f"select text, count(*) as n from {_leaf(CALL)} where regexp_matches(regexp_extract(text, '\\w+\\.(\\w+)\\(', 1), '^(?:get|load|exec)') group by 1",
    "d10_where_pattern": "select text, count(*) as n from " + _leaf('\\w+\\("[^"\\n]*"') + " where regexp_matches(text, '\\bWHERE\\b\\s*[A-Za-z_][\\w.]*\\s*=') or regexp_matches(text, '\\bWHERE\\b\\s*(\\d[\\w.]*|''[^'']*'')\\s*=') group by 1",
    "d11_where_compares": f"select * from {_leaf(r'[<>] ' + chr(92) + 'd+')} where try_cast(regexp_extract(text, '(\\d+)', 1) as double) > 1000 and try_cast(regexp_extract(text, '(\\d+)', 1) as double) % 2 = 0",
    "d12_entropy": "select rule_id, round(abs(sum(-p * log2(p))), 4) as entropy from (select rule_id, count(*) / any_value(length(rule_id)) as p from (select rule_id, unnest(string_split(rule_id, '')) as c from (select distinct rule_id from findings where rule_id is not null)) group by rule_id, c) group by 1",
    "d13_focus": "select file_id, start_at + position(name in text) - 1 as start_at, start_at + position(name in text) - 1 + length(name) as stop_at, name as text from (select *, regexp_extract(text, '\"(\\w+)\"', 1) as name from " + _leaf('getParameter\\(\\"\\w+\\"\\)') + ")",
    "d20_paths": "select file_id, path from (select *, replace(path, chr(92), '/') as p from source_files where content is not null) where regexp_matches(p, '(?:^|/)src/.*$|(?:^|/)[^/]*\\.py$') and not regexp_matches(p, '(?:^|/)(?:.*/)?tests/.*$')",
    "d22_fix": "select finding_id, regexp_replace(code_snippet, '\\bMD5\\b', 'SHA256', 'g') as all_fixed, regexp_replace(code_snippet, '[aeiou]', '_') as first_fixed from findings where code_snippet is not null",
    "d21_fix_template": r"""select file_id, md5(regexp_replace(content, '([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\.\s*\bgetInstance\b\s*\(\s*"MD5"\s*\)', '\1.getInstance("SHA-256")', 'g')) as fixed from source_files where regexp_matches(content, '[A-Za-z_]\w*\s*\.\s*\bgetInstance\b\s*\(\s*"MD5"\s*\)')""",
    "d22_first_fixes": "select finding_id, regexp_replace(regexp_replace(regexp_replace(code_snippet, '[aeiou]', '_'), '[aeiou]', '_'), '[aeiou]', '_') as fixed from findings where code_snippet is not null",
    "d23_options": "from " + _leaf('(?i)select [^\\n"]*'),
    "d24_languages": "select language, count(*) as n from source_files where content is not null and lower(language) in ('java', 'cpp') group by 1",
}
