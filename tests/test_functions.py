import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import language, severity, text
from sieveline.sources import config, files, rules


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("value", "expected"), [("\t a \r\n", "a"), ("", ""), (None, None)])
def test_trim(spark, value, expected):
    assert one(spark, text.trim_all(F.lit(value)), x=1) == expected


@pytest.mark.parametrize(("t", "part", "n"), [("aaaa", "aa", 2), ("", "a", 0), ("abc", "", 0), (None, "a", None)])
def test_occurrences(spark, t, part, n):
    assert one(spark, text.occurrences(F.lit(t), part), x=1) == n


@pytest.mark.parametrize(("path", "name", "ending"), [("a/b.PY", "b.PY", ".py"), ("c:\\d\\e.tar.gz", "e.tar.gz", ".gz"), ("Makefile", "Makefile", ""), ("a.b/c", "c", "")])
def test_names(spark, path, name, ending):
    assert one(spark, text.basename(F.lit(path)), x=1) == name
    assert one(spark, text.extension(F.lit(path)), x=1) == ending


@pytest.mark.parametrize(("done", "total", "expected"), [(1, 8, 13), (1, 3, 33), (0, 0, 0), (5, 5, 100)])
def test_progress(spark, done, total, expected):
    assert one(spark, text.progress(F.lit(done), F.lit(total)), x=1) == expected


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [(r"os\.system\s*\(", "os.system"), (r"a|bcd", None), (r"\w+", None), (r"(abc)?def", "def"), (r"abcd*e", "abc"), (r"(?i)Velvet\s*=", "velvet"), (r"ab", None), (r"x[abc]yzw", "yzw"), (r"abc{2}def", "def")],
)
def test_required_literal(pattern, literal):
    assert text.required_literal(pattern) == literal


@pytest.mark.parametrize(("value", "mode", "expected"), [("high", "own", "HIGH"), ("weird", "own", "MEDIUM"), (None, "own", "MEDIUM"), ("ERROR", "external", "HIGH"), ("WARNING", "external", "MEDIUM"), ("INFO", "external", "LOW"), ("x", "external", "MEDIUM"), ("error", "both", "HIGH"), ("INFO", "web", "low")])
def test_severity(spark, value, mode, expected):
    assert one(spark, severity.normalize(F.lit(value).cast("string"), mode), x=1) == expected


def test_unknown_severity_ranks_last(spark):
    assert one(spark, severity.rank(F.lit("odd")), x=1) == 5


@pytest.mark.parametrize(("sev", "matched", "line", "score"), [("critical", "password of user", "x", 0.95), ("low", "x", "// x", 0.4), ("high", "secret", "x", 0.85), ("low", "x", "x", 0.5)])
def test_confidence(spark, sev, matched, line, score):
    assert one(spark, severity.confidence_score(F.lit(sev), F.lit(matched), F.lit(line)), x=1) == score


@pytest.mark.parametrize(("content", "expected"), [("import x\ndef f", "python"), ("", "unknown"), (None, "unknown"), ("class", "java"), ("#include <a>\nusing namespace std;", "cpp"), ("z" * 2000 + "def def def", "unknown")])
def test_language_by_content(spark, content, expected):
    assert one(spark, language.by_content(F.lit(content).cast("string")), x=1) == expected


def test_language_of_graph(spark):
    df = spark.createDataFrame([("a", None, ["METHOD"], [], ["java.util"], ["List"]), ("b", "CPP", [], [], [], []), ("c", None, [], [], [], [])], "scan_id string, language string, types array<string>, names array<string>, imports array<string>, data_types array<string>")
    assert {r[0]: r[1] for r in language.by_graph(df).collect()} == {"a": "java", "b": "cpp", "c": "unknown"}


def test_discovery_and_reading(spark, tmp_path):
    for name, body in {"a.py": b"x\xff = 1\n", "node_modules/b.js": b"1", ".hid/c.py": b"1", "d.txt": b"1", "vendor/e.py": b"1", "f.PY": "é".encode()}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    found = {r.path.rsplit("/", 1)[1]: r.content for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert found == {"a.py": "x = 1\n", "f.PY": "é"}
    assert {r.path.rsplit("/", 1)[1] for r in files.read_folder(spark, str(tmp_path), "plain").collect()} == {"a.py", "e.py", "f.PY"}


def test_lines_keep_the_last_and_the_carriage_return(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None)], "file_id int, content string")
    assert sorted(map(tuple, files.lines(df, "file_id").collect())) == [(1, 1, "a\r"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]


def test_rules_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    d = tmp_path / "python" / "lang"
    d.mkdir(parents=True)
    (d / "a.yaml").write_text("rules:\n- id: r1\n  pattern: eval\n  severity: odd\n  metadata: {cwe: [CWE-1, CWE-2], owasp: [A1]}\n- id: r2\n  pattern: {pattern: x}\n  tags: [a, 1]\n- nonsense\n- severity: HIGH\n")
    (d / "b.YML").write_text("rules: [")
    (d / "c.yaml.broken").write_text("rules: []")
    good, bad = rules.from_yaml(spark, str(tmp_path))
    got = {r.rule_id: r for r in rules.normalized(good).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].severity == "MEDIUM" and got["r1"].cwe == ["CWE-1", "CWE-2"] and got["r1"].owasp == "A1" and got["r1"].language == "python"
    assert got["r2"].pattern == "x" and got["r2"].tags == ["a"] and got["r2"].rule_type == "semgrep"
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["b.YML"]


def test_quarantine(spark):
    df = spark.createDataFrame([("a", "java", "x+"), ("b", "java", "(x"), ("c", "java", "(?!x)y"), ("d", "java", None), ("e", "java", "x*")], "rule_id string, language string, pattern string")
    good, bad = rules.compiled(df, "linear")
    assert {r.rule_id: r.matches_empty for r in good.collect()} == {"a": False, "e": True}
    assert {r.rule_id for r in bad.collect()} == {"b", "c", "d"}
    assert {r.rule_id for r in rules.compiled(df)[0].collect()} == {"a", "c", "e"}


ATOMS = ["a", "b", "exec", "\\(", "\\.", "\\w", "\\d", "[a-z]", "[^)]", "[]x]", "[\\]a]", "\\p{L}", "\\x41", "\\u0062", "\\03", "(ab|c)", "(?:exec)", "(x)", ".", "\\bfoo", "\\s", "=", "id"]
BOUNDS = ["", "", "", "?", "*", "+", "{2}", "{1,3}", "{0,2}", "{2,}", "+?", "*+"]


def test_required_text_never_loses_a_match(spark):
    """Filtered by the required text or not, the same lines match: 1,500 patterns, each on lines made from its own pieces."""
    r = random.Random(11)
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    rows = []
    for _ in range(1500):
        pattern = "".join(r.choice(ATOMS) + r.choice(BOUNDS) for _ in range(r.randrange(1, 6)))
        java.compile(pattern)
        lines = ["".join(r.choice(["a", "b", "exec", "EXEC", "(", ".", "7", "x", "Ab", "c", "foo", " ", "=", "id", "]", "\x03", "é"]) for _ in range(r.randrange(0, 14))) for _ in range(40)]
        rows += [(pattern, text.required_literal(pattern), line) for line in lines]
    df = spark.createDataFrame(rows, "pattern string, literal string, line string")
    hits = df.filter(F.rlike("line", F.col("pattern")))
    assert hits.filter("literal is not null").count() > 300
    assert hits.filter("literal is not null and not contains(lower(line), literal)").collect() == []


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [(r"\w{10,20}=", None), (r"[a-z]{100}", None), (r"[^\]]{120,}", None), (r"\p{Alpha}+\d", None), (r"\x41bcd", "bcd"), (r"os\.system\(", "os.system("), (r"abc{2,3}d", None), (r"foo+bar", "foo"), (r"[[a-z]]xyz", None), (r"\Qabc\E", None), ("(?i)PassWord", "password"), ("(?x)a b c d", None), (r"a|bcd", None), (r"(abc)\10def", "def")],
)
def test_required_text(pattern, literal):
    assert text.required_literal(pattern) == literal


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("timeout: 5\nverbose: true\n")
    (tmp_path / "b.json").write_text('{"timeout": 6}')
    held = config.read_config(str(tmp_path / "a.yaml"))
    assert config.merge_config({"timeout": None, "x": 1}, held) == {"timeout": None, "verbose": True, "x": 1}
    assert config.merge_config({"timeout": None, "x": 1}, held, given_wins=False)["timeout"] == 5
    assert config.read_config(str(tmp_path / "b.json")) == {"timeout": 6}
    with pytest.raises(ValueError):
        config.read_config("a.toml")


def test_table_of_a_database(spark):
    url = "jdbc:derby:memory:scans;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database at hand")
    spark.range(100).selectExpr("id", "'x' as status").write.format("jdbc").option("url", url).option("dbtable", "scans").save()
    got = config.jdbc_table(spark, url, "scans", "ID", (0, 100), 4)
    assert got.count() == 100 and got.rdd.getNumPartitions() == 4


def test_web_rules(spark):
    rows = spark.createDataFrame([("r", "n", None, "A02:2021 - Crypto", "high", "md5\\(", "gi", "x", None), ("q", "n", "d", None, "low", "a", None, None, False)], rules.WEB_RULE)
    got = {r.rule_id: r for r in rules.from_web(rows).collect()}
    assert (got["r"].pattern, got["r"].severity, got["r"].owasp, got["r"].message, got["r"].enabled) == ("(?i)md5\\(", "HIGH", "A02:2021", "n", True)
    assert (got["q"].pattern, got["q"].enabled, got["q"].language) == ("a", False, None)
    assert rules.from_web(rows, ["java", "python"]).count() == 4


def test_fresh_ids(spark):
    ids = spark.range(3).select(text.fresh_id().alias("i")).select(text.valid_id(F.col("i")).alias("ok"), "i").collect()
    assert all(r.ok for r in ids) and len({r.i for r in ids}) == 3


def test_rule_files_that_are_broken(spark):
    bodies = [("a/x.yaml", "java", b"rules:\n- {id: r, pattern: {pattern: p}, severity: 7, metadata: {cwe: [CWE-1]}}\n- 5\n- {pattern: x}"), ("a/y.yaml", "java", b"rules: ["), ("a/z.yaml", "java", b"a: 1"), ("a/w.yaml", "java", b"\xff\xfe")]
    out = rules.parse_files(spark.createDataFrame(bodies, "path string, language string, content binary")).collect()
    assert [(r.rule_id, r.pattern, r.severity, r.cwe) for r in out if r.reason is None] == [("r", "p", "MEDIUM", ["CWE-1"])]
    assert sorted(r.source_file for r in out if r.reason) == ["a/w.yaml", "a/y.yaml", "a/z.yaml"]


@pytest.mark.parametrize(("path", "expected"), [("a/../b.py", "/srv/b.py"), ("../../../x", "/x"), ("/a/./b/../c/..", "/a"), ("/..", "/"), ("C:/a/../b", "C:/b"), ("a..b/c", "/srv/a..b/c"), ("./a//b", "/srv/a/b"), (None, None)])
def test_absolute_paths(spark, path, expected):
    assert one(spark, text.absolute(F.lit(path), "/srv/"), x=1) == expected
