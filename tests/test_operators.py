import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sieveline.operators import algebra, flow, graph, history, match, nested, report, taint
from sieveline.sources import external, graphs, rules

NODE = "scan_id bigint, pos bigint, id bigint, type string, name string, className string, arguments int, initializer string, hasElse boolean, dataType string, scope string"
EDGE = "scan_id bigint, pos bigint, source bigint, target bigint, type string"


def make(spark, nodes, edges):
    n = spark.createDataFrame([(1, k, i, t, *(rest + [None] * 7)[:7]) for k, (i, t, *rest) in enumerate(nodes)], NODE)
    return n, spark.createDataFrame([(1, k, a, b, t) for k, (a, b, t) in enumerate(edges)], EDGE)


def test_spans(spark):
    df = spark.createDataFrame([("ab12cd345e", "[0-9]+"), ("é😀1 1", "1"), ("none", "1"), ("111", "1")], "line string, p string")
    got = [[tuple(x) for x in r[0]] for r in df.select(match.spans("line", "p")).collect()]
    assert got == [[(3, "12"), (7, "345")], [(3, "1"), (5, "1")], [], [(1, "1"), (2, "1"), (3, "1")]]
    assert [tuple(x) for x in df.filter("p = '1' and line like 'é%'").select(match.spans("line", "p", "byte")).first()[0]] == [(7, "1"), (9, "1")]


def test_spans_of_long_lines(spark):
    many = "ab" * 3000
    df = spark.createDataFrame([(many, "b"), ("b" * 129, "b")], "line string, p string")
    got = [[x.column_no for x in r[0]] for r in df.select(match.spans("line", "p")).collect()]
    assert got == [list(range(2, 6001, 2)), list(range(1, 130))]


def test_ranges_against_brute_force(spark):
    r = random.Random(8)
    make_ = lambda n: sorted({(r.randrange(3), (a := r.randrange(40_000) if r.random() < 0.5 else r.randrange(60)), a + r.randrange(1, 30) ** r.randrange(1, 4)) for _ in range(n)})
    inner, outer = make_(120), make_(40)
    frame = lambda rows: spark.createDataFrame([(*x, "t") for x in rows], "file_id int, start int, stop int, text string")
    got = lambda f: sorted((x.file_id, x.start, x.stop) for x in f(frame(inner), frame(outer)).collect())
    held = [i for i in inner if any(o[0] == i[0] and o[1] <= i[1] and i[2] <= o[2] for o in outer)]
    hit = [i for i in inner if any(o[0] == i[0] and o[1] < i[2] and i[1] < o[2] for o in outer)]
    assert 0 < len(held) < len(inner)
    assert got(algebra.inside) == held and got(algebra.not_inside) == [i for i in inner if i not in held] and got(algebra.not_matching) == [i for i in inner if i not in hit]
    assert algebra.not_inside(frame(inner), frame(outer).limit(0)).count() == len(inner)


def test_templates(spark):
    f = spark.createDataFrame([(1, 'st.executeQuery("a" + id, f(x, (y)));\nx = x;\nx = y;\nMessageDigest . getInstance("MD5")')], "file_id int, content string")
    assert [(r.text, r.X) for r in algebra.match_template(f, "$X = $X;").collect()] == [("x = x;", "x")]
    (call,) = algebra.match_template(f, '$S.executeQuery("..." + $ARG, ...)').collect()
    assert (call.S, call.ARG, call.text) == ("st", "id", 'st.executeQuery("a" + id, f(x, (y)))')
    old = algebra.match_template(f, '$X.getInstance("MD5")')
    fixed = algebra.apply_fixes(f, algebra.fix_template(old, '$X.getInstance("SHA-256")', ["X"]))
    assert fixed.first().fixed.endswith('x = y;\nMessageDigest.getInstance("SHA-256")')


def test_first_fixes(spark):
    df = spark.createDataFrame([("aXbXcXd",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(algebra.fix(F.col("t"), "X", "<$0>", 2)).collect()]
    assert got == ["a<X>b<X>cXd", "none", None]


def test_matches_by_language_and_plan(spark):
    table, _ = rules.compiled(spark.createDataFrame([("r1", "java", "exec\\("), ("r2", "python", "exec"), ("r3", "java", "x*")], "rule_id string, language string, pattern string"))
    lines = spark.createDataFrame([(1, "java", 1, "a.exec(b); exec(c)"), (2, "cpp", 1, "exec("), (3, "python", 2, None)], "file_id int, language string, line_no int, line string")
    out = match.find_matches(lines, table)
    assert sorted((r.rule_id, r.column_no) for r in out.collect()) == [("r1", 3), ("r1", 12)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert match.find_matches(lines, table, per_language=False).count() == 6


def test_nested_levels(spark):
    docs = [
        (1, '{"vulnerabilities":[null,{"context":{"lines":"x","semgrep":[null,{"trace":[{"a":1},null]}],"batch":{"members":{"p":1}}}}]}'), (2, '"{\\"report\\": {\\"vulnerabilities\\": {\\"context\\": \\"{\\\\\\"lines\\\\\\": [1, null, 2]}\\"}}}"'), (3, '{"vulnerabilities":'), (4, None), (5, ""), (6, "[]"),
        (7, '{"vulnerabilities": null}'), (8, '{"vulnerabilities":[{"context":"-"},{"context":null}]}'), (9, '{"vulnerabilities":[' + "{}," * 20_000 + "{}]}"), (10, "[" * 200_000),
    ]
    df = spark.createDataFrame([(i, p, "n", 0) for i, p in docs], "report_id bigint, payload string, node_path string, ordinal int")
    out = nested.with_parents(nested.shred(df, "report_id", "payload", nested.SCAN_REPORT)).cache()
    got = {}
    for r in out.filter("record_id <> 9").collect():
        got.setdefault(r.record_id, set()).add(r.node_path)
    v = "vulnerabilities"
    assert got == {1: {f"{v}/1", f"{v}/1/lines/0", f"{v}/1/semgrep/1", f"{v}/1/semgrep/1/trace/0", f"{v}/1/batch/0", f"{v}/1/batch/0/members/0"}, 2: {f"{v}/0", f"{v}/0/lines/0", f"{v}/0/lines/2"}, 8: {f"{v}/0", f"{v}/1"}}
    assert out.filter("record_id = 9").count() == 20_001
    trace = out.filter("table_name = 'vulnerabilities/semgrep/trace'").first()
    assert trace.parent_path == f"{v}/1/semgrep/1" and trace.depth == 3 and trace.node == '{"a":1}'
    orphaned = out.filter("parent_path is not null").join(out.select("record_id", F.col("node_path").alias("parent_path")), ["record_id", "parent_path"], "left_anti")
    assert orphaned.count() == 0
    assert nested.shred(df.limit(0), "report_id", "payload", nested.SCAN_REPORT).count() == 0


def test_nested_odd_documents(spark):
    """What a VARIANT doesn't hold is read all the same: depth, repeated keys, what stands behind a document, many wrappings."""
    v, deep = "vulnerabilities", "[" * 30_000 + "]" * 30_000
    wrapped = '{"vulnerabilities": {"context": {"lines": 1}}}'
    for _ in range(7):
        wrapped = json.dumps({"report": wrapped})
    docs = [
        (1, '{"vulnerabilities":[{"context":{"lines":' + deep + "}}]}"), (2, '{"vulnerabilities":1,"vulnerabilities":[{"a":1}]}'), (3, '{"vulnerabilities":[{}]} x'), (4, '{"vulnerabilities":[{}]}], [1'), (5, wrapped), (6, '{"vulnerabilities":[{"context":"{\\"lines\\":1,\\"lines\\":[2,3]}"}]}'),
        (None, '{"vulnerabilities":[{}]}'), (8, ' {"vulnerabilities":[{"x":"\\ud800","n":1e5}]} '), (9, '{"report":{"report":[]}}'), (10, "\ufeff{}"), (11, '{"vulnerabilities":[{}],"n":01}'),
    ]
    df = spark.createDataFrame(docs, "report_id bigint, payload string")
    nodes = nested.shred(df, "report_id", "payload", nested.SCAN_REPORT).cache()
    got = sorted((r.record_id or 0, r.node_path) for r in nodes.collect())
    assert got == [(0, f"{v}/0"), (1, f"{v}/0"), (1, f"{v}/0/lines/0"), (2, f"{v}/0"), (5, f"{v}/0"), (5, f"{v}/0/lines/0"), (6, f"{v}/0"), (6, f"{v}/0/lines/0"), (6, f"{v}/0/lines/1"), (8, f"{v}/0")]
    assert nodes.filter("record_id = 1 and ordinal = 0 and node like '[%'").first().node == deep[1:-1]
    assert [(r.value, r.parent_path) for r in nested.table(nodes, f"{v}/lines").filter("record_id = 6").orderBy("ordinal").collect()] == [("2", f"{v}/0"), ("3", f"{v}/0")]


@pytest.mark.parametrize("text", ["", "[", "[1,]", '{"a":}', '{"a":1,}', "[1 2]", "{1:2}", "1 2", '["a', "[1]]", "nul", "01", "-", '{"a" 1}', "[,1]"])
def test_deep_reader_takes_no_broken_text(text):
    with pytest.raises(ValueError):
        nested.parse_deep(text)


def test_deep_reader_agrees_with_the_library():
    r = random.Random(6)

    def value(depth):
        kind = r.randrange(8 if depth else 5)
        return [None, True, -3, 2.5e10, 'a"\\\u00e9\n'][kind] if kind < 5 else [value(depth - 1) for _ in range(r.randrange(4))] if kind < 7 else {str(k): value(depth - 1) for k in range(r.randrange(4))}

    for _ in range(300):
        x = value(5)
        text = json.dumps(x, indent=r.choice([None, 1]))
        assert nested.parse_deep(text) == x and json.loads(nested.write_deep(x)) == x


def test_components_against_search(spark):
    r = random.Random(4)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    links = spark.createDataFrame([(1, a, b) for a, b in pairs], "scan_id int, a bigint, b bigint")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = deque([start])
            while todo:
                x = todo.popleft()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    assert {x.id: x.component for x in graph.components(links).collect()} == want
    assert graph.components(links.limit(0)).count() == 0


def test_views_and_inferred_edges(spark):
    nodes = [(1, "METHOD", "f"), (2, "METHOD_CALL", "g", None, 1), (3, "IF_STATEMENT", None, None, None, None, True), (4, "METHOD", "g"), (5, "TRY_CATCH_BLOCK"), (6, "TYPE_CATCH_CALL"), (6, "LOCAL_VARIABLE", "v", None, None, "x"), (9, "STRING_LITERAL")]
    edges = [(1, 2, "CONTAINS"), (1, 3, "CONTAINS_CONTROL_FLOW"), (3, 2, "CONTAINS_CONTROL_FLOW"), (5, 6, "DECLARES"), (1, 77, "CONTAINS"), (1, 2, "CONTAINS")]
    n, e = make(spark, nodes, edges)
    _, out = graph.full_cfg(n, e)
    kinds = sorted((r.source, r.target, r.type) for r in out.collect() if r.type not in graph.VIEWS["cfg_full"][1])
    assert kinds == [(2, 3, "SEQUENTIAL_FLOW"), (2, 4, "CALLS"), (3, 2, "ELSE_BRANCH")]
    assert {(r.source, r.target) for r in graph.dangling(n, e).collect()} == {(1, 77)}
    assert {r.id for r in graph.orphans(n, e).collect()} == {4, 9}
    s = graph.statistics(n, e).first()
    assert (s.total_nodes, s.total_edges, s.method_calls, s.assignments, s.control_flow_nodes) == (8, 6, 2, 1, 2)
    assert {(r.id, r.type) for r in graphs.last_by_id(n).filter("id = 6").collect()} == {(6, "LOCAL_VARIABLE")}


def test_taint_paths_prefer_short_then_small(spark):
    nodes = [(1, "PARAMETER", "p"), (2, "LOCAL_VARIABLE", "a"), (3, "LOCAL_VARIABLE", "b"), (4, "METHOD_CALL", "executeQuery", None, 1), (5, "METHOD_CALL", "println", None, 0), (6, "METHOD_CALL", "println", None, 2), (7, "STRING_LITERAL", None)]
    edges = [(1, 2, "DATA_FLOW"), (2, 4, "DATA_FLOW"), (1, 3, "DATA_FLOW"), (3, 4, "DATA_FLOW"), (4, 5, "DATA_FLOW"), (7, 4, "DATA_FLOW")]
    rows = [(r.source, r.sink, r.severity, r.path) for r in taint.taint(*make(spark, nodes, edges)).collect()]
    assert rows == [(1, 4, "LOW", [1, 2, 4])]


def brute_weights(spark_nodes, links, starts, factor, threshold):
    best = {}
    todo = [(s, s, c) for s, c in starts.items()]
    while todo:
        s, x, c = todo.pop()
        if c <= best.get((s, x), 0) + 1e-12:
            continue
        best[s, x] = c
        todo += [(s, y, c * factor[y]) for y in links.get(x, ()) if c * factor[y] >= threshold]
    return best


def test_weighted_propagation_against_search(spark):
    r = random.Random(8)
    names = ["trim", "substring", "load", "format"]
    nodes = [(i, "PARAMETER" if i < 3 else "METHOD_CALL", names[i % 4], None, 1, None, None, "String") for i in range(25)]
    edges = list({(r.randrange(25), r.randrange(25), "DATA_FLOW") for _ in range(70)})
    n, e = make(spark, nodes, edges)
    links = {}
    for a, b, _ in edges:
        links.setdefault(a, set()).add(b)
    factor = {i: taint.MODIFIERS.get(names[i % 4], 1.0) for i in range(25)}
    want = brute_weights(n, links, dict.fromkeys(range(3), 0.98), factor, 0.6)
    got = {(x.source, x.id): x.confidence for x in taint.propagate(n, e, 0.6).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sanitizers_stop_and_paths_are_simple(spark):
    nodes = [(1, "PARAMETER", "p", None, None, None, None, "String"), (2, "METHOD_CALL", "escapeHtml", None, 1), (3, "METHOD_CALL", "executeQuery", None, 1), (4, "LOCAL_VARIABLE", "v")]
    edges = [(1, 2, "DATA_FLOW"), (2, 3, "DATA_FLOW"), (1, 4, "DATA_FLOW"), (4, 3, "DATA_FLOW"), (4, 1, "DATA_FLOW"), (3, 4, "DATA_FLOW")]
    rows = [(r.path, round(r.confidence, 6)) for r in taint.weighted_taint(*make(spark, nodes, edges), threshold=0.5).collect()]
    assert rows == [([1, 4, 3], round(0.98**3 * 0.99**3, 6))]


def test_line_flow(spark):
    src = "// c\nint x = 1;\nif (x > 0) {\n  return y;\n}\n"
    lines = spark.createDataFrame([(1, "java", k + 1, s) for k, s in enumerate(src.split("\n"))], "file_id int, language string, line_no int, line string")
    nodes = {r.node: (r.type, r.line_no) for r in flow.cfg_nodes(lines).collect()}
    assert nodes == {0: ("entry", 1), 1: ("assignment", 2), 2: ("control", 3), 3: ("statement", 4), 4: ("statement", 5), -1: ("exit", 6)}
    assert sorted((r.source, r.target) for r in flow.cfg_edges(lines).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, -1)]
    d = flow.dfg_nodes(lines)
    kinds = {r.node: (r.kind, r.name) for r in d.collect()}
    assert {(kinds[r.source][1], r.name) for r in flow.dfg_edges(d).collect()} == set()
    assert ("use", "int") in kinds.values()


def test_definition_reaches_use_on_its_line(spark):
    lines = spark.createDataFrame([(1, "python", 1, "total = 1"), (1, "python", 2, "total = total + 1"), (1, "python", 3, "print(total)")], "file_id int, language string, line_no int, line string")
    d = flow.dfg_nodes(lines)
    edges = sorted((r.source, r.target) for r in flow.dfg_edges(d).filter("name = 'total'").collect())
    assert edges == [(1, 2), (3, 4), (3, 6)]


def test_directories_and_upsert(spark):
    scans = spark.createDataFrame([("a", "/x", "2026-01-01T00:00:00+05:30"), ("b", "/x", "2025-12-31T23:00:00Z"), ("c", None, "2026"), ("d", "/y", None)], "scan_id string, source_directory string, scanned_at string")
    got = {r.directory: (r.first_scan, r.last_scan, r.scan_count) for r in history.directories(scans).collect()}
    assert got == {"/x": ("2026-01-01T00:00:00+05:30", "2025-12-31T23:00:00Z", 2), "/y": (None, None, 1)}
    merged = history.upsert(history.directories(scans), history.directories(scans.limit(1)))
    assert {r.directory: r.scan_count for r in merged.collect()} == {"/x": 3, "/y": 1}


def test_external_results(spark):
    doc = '{"results":[{"check_id":"r","path":"a/b.py","start":{"line":3,"col":5},"extra":{"message":"m","severity":"ERROR","metadata":{"cwe":["CWE-1","CWE-2"],"owasp":"A1"}}},{"check_id":5}]}'
    out = external.from_external(external.results(spark.createDataFrame([(doc,), ("{",), (None,)], "payload string")), "/w").collect()
    assert [(r.rule_id, r.severity, r.location, r.cwe_id, r.review_guidance) for r in out] == [("r", "HIGH", "b.py:3:5", "CWE-1", "A1"), ("5", "MEDIUM", "", None, None)]
    assert out[1].details == external.NO_DETAILS and out[1].code_snippet == external.NO_SNIPPET


@pytest.mark.parametrize(("text", "count", "expected"), [("aXbX", None, "a-b-"), ("aXbX", 1, "a-bX"), ("aXbXcX", 2, "a-b-cX"), ("ab", 1, "ab")])
def test_fix(spark, text, count, expected):
    assert spark.range(1).select(algebra.fix(F.lit(text), "X", "-", count)).first()[0] == expected


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.py", "a/b.py", True), ("src/**", "x/src/a/b.c", True), ("src/*", "src/a/b.c", False), ("**/test/*", "a/test/x", True), ("a?c", "abc", True)])
def test_glob(spark, pattern, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(algebra.glob(pattern))).first()[0] is hit


def test_entropy(spark):
    assert abs(spark.range(1).select(algebra.entropy(F.lit("aabb"))).first()[0] - 1.0) < 1e-9
    assert spark.range(1).select(algebra.entropy(F.lit("aaaa"))).first()[0] == 0.0


def test_top_files_ties_and_ranking(spark):
    f = spark.createDataFrame([(1, "HIGH", "b:1"), (2, "ODD", "a:1"), (3, "CRITICAL", "b:2"), (4, "LOW", "a:9"), (5, None, None)], "finding_id int, severity string, location string")
    assert [(r.file, r.findings) for r in report.top_files(f).collect()] == [("b", 2), ("a", 2)]
    assert [r.finding_id for r in report.ranked(f, "finding_id").collect()] == [3, 1, 4, 2, 5]
