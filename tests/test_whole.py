"""Operators do their whole job: nothing ends at a number of rows, steps or rounds that the job doesn't set."""

import json
from collections import deque

import pytest
from pyspark.sql import functions as F

from sieveline import session
from sieveline.operators import graph, report, taint
from sieveline.plans import graphs, reports


def test_summaries_list_every_finding(spark):
    rows = [("s", i, "HIGH" if i == 25 else "LOW", "r", f"a:{i}", "d", "CWE-1" if i == 25 else None, "" if i == 25 else "A1", "fix") for i in range(26)]
    f = spark.createDataFrame(rows, "scan_id string, finding_id int, severity string, rule_id string, location string, details string, cwe_id string, review_guidance string, remediation string")
    text = report.summary_text(f, "scan_id", "finding_id").first().text.split("\n")
    assert text[:9] == [report.SUMMARY, "", "Total Vulnerabilities: 26", "", "Severity Breakdown:", "  HIGH: 1", "  LOW: 25", "", report.DETAILS]
    assert text[10:17] == ["1. [HIGH] r", "   Location: a:25", "   Details: d", "   CWE: CWE-1", "   Remediation: fix", "", "2. [LOW] r"]
    assert [t for t in text if t[:1].isdigit()][-1] == "26. [LOW] r"


def test_full_summaries_number_what_the_table_holds(spark):
    d = "/root/testdata/sf0.001"
    n = reports.findings(spark, d).filter("scan_id is not null").groupBy("scan_id").count().collect()
    out = reports.k5_summaries(spark, d).collect()
    assert sorted((r.scan_id, r.k) for r in out) == sorted((x["scan_id"], k) for x in n for k in range(x["count"] + 1))


def searched(links, starts, goals):
    """{(scan, source, sink): steps} by breadth-first search."""
    near, out = {}, {}
    for g, a, b in links:
        near.setdefault((g, a), set()).add(b)
    for g, s in starts:
        far, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near.get((g, x), ()):
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        out |= {(g, s, x): k for x, k in far.items() if (g, x) in goals and x != s}
    return out


def test_shortest_paths_have_no_bound(spark):
    links = [(1, k, k + 1) for k in range(34)] + [(1, 3, 2), (2, 0, 5)]
    frame = spark.createDataFrame(links, "scan_id int, a bigint, b bigint")
    ends = spark.createDataFrame([(1, 0), (1, 34), (2, 0), (2, 5)], "scan_id int, id bigint")
    out = graph.shortest_paths(frame, ends, ends).collect()
    assert sorted((r.scan_id, r.source, r.path) for r in out) == [(1, 0, list(range(35))), (2, 0, [0, 5])]
    assert [r.scan_id for r in graph.shortest_paths(frame, ends, ends, 2).collect()] == [2]


def test_all_shortest_against_search(spark):
    d = "/root/testdata/sf0.001"
    n, e = (t.collect() for t in graphs.tables(spark, d))
    last = {(r.scan_id, r.id): r for r in sorted(n, key=lambda r: r.pos)}
    links = {(r.scan_id, r.source, r.target) for r in e if r.type in graph.FORWARD} | {(r.scan_id, r.target, r.source) for r in e if r.type in graph.BACKWARD}
    flow = {(r.scan_id, r.source, r.target) for r in e if r.type == "DATA_FLOW"}
    methods = {}
    for (g, i), r in last.items():
        if r.type == "METHOD":
            methods.setdefault((g, r.name), []).append(i)
    for r in e:
        if r.type == "INVOKES" and (c := last.get((r.scan_id, r.target))) and c.type == "METHOD_CALL":
            flow |= {(r.scan_id, r.source, m) for m in methods.get((r.scan_id, c.name), ())}
    links |= flow | {(g, b, a) for g, a, b in flow}
    starts = {k for k, r in last.items() if r.type == "PARAMETER" or (r.type == "METHOD_CALL" and r.name in ("getParameter", "readLine", "getInputStream", "nextLine", "read"))}
    goals = {k for k, r in last.items() if r.type == "METHOD_CALL" and r.arguments > 0 and r.name in ("executeQuery", "println", "print", "info", "debug", "warn", "error", "log", "severe", "warning")}
    want = searched(links, starts, goals)
    out = graphs.g16_paths(spark, d).collect()
    assert {(r.scan_id, r.source, r.sink): r.steps for r in out} == want and len(out) == len(want)
    assert any(last[g, s].type == "METHOD_CALL" for g, s, _ in want)
    for r in out:
        way = [int(x) for x in r.path.split(">")]
        assert (way[0], way[-1], len(way)) == (r.source, r.sink, r.steps + 1) and all((r.scan_id, a, b) in links for a, b in zip(way, way[1:]))


def test_weighted_paths_go_on_through_sinks(spark):
    nodes = [(0, "PARAMETER", "p", None, None, None, None, "String"), *((k, "METHOD_CALL", "executeQuery" if k in (3, 10) else "load", None, 1) for k in range(1, 11))]
    links = [(k, k + 1, "DATA_FLOW") for k in range(10)] + [(5, 4, "DATA_FLOW")]
    n = spark.createDataFrame([(1, k, i, t, *(rest + [None] * 7)[:7]) for k, (i, t, *rest) in enumerate(nodes)], "scan_id bigint, pos bigint, id bigint, type string, name string, className string, arguments int, initializer string, hasElse boolean, dataType string, scope string")
    e = spark.createDataFrame([(1, k, a, b, t) for k, (a, b, t) in enumerate(links)], "scan_id bigint, pos bigint, source bigint, target bigint, type string")
    out = taint.weighted_taint(n, e, threshold=0.5)
    assert sorted((r.sink, r.path, round(r.confidence, 6)) for r in out.collect()) == [(s, list(range(s + 1)), round((0.98 * 0.99) ** (s + 1), 6)) for s in (3, 10)]


def test_taint_keeps_far_sinks(spark):
    last = 20
    n = spark.createDataFrame([(1, k, k, "PARAMETER" if k == 0 else "METHOD_CALL", "println" if k == last else "load", 2) for k in range(last + 1)], "scan_id bigint, pos bigint, id bigint, type string, name string, arguments int")
    e = spark.createDataFrame([(1, k, k, k + 1, "DATA_FLOW") for k in range(last)], "scan_id bigint, pos bigint, source bigint, target bigint, type string")
    assert [(r.source, r.sink, r.path) for r in taint.taint(n, e).collect()] == [(0, last, list(range(last + 1)))]


def test_reports_hold_every_finding(spark, tmp_path):
    f = spark.createDataFrame([("s", 1, "LOW", "c", "r"), ("s", 2, "HIGH", None, "q")], "scan_id string, finding_id int, severity string, category string, rule_id string")
    scans = spark.sql("select 's' as scan_id, '/x' as source_directory, 3 as files_processed, 1500000000L as duration_ns, timestamp'2026-01-02 03:04:05.25' as ended union all select 't', null, 0, 0L, null")
    heads = report.report_heads(f, scans, F.lit(7), {"timeout": 9})
    got = {r.scan_id: json.loads(r.report) for r in heads.collect()}
    assert got["s"]["statistics"] == {"files_processed": 3, "rules_loaded": 7, "vulnerabilities_found": 2, "scan_start_time": "2026-01-02T03:04:03.75Z", "scan_end_time": "2026-01-02T03:04:05.25Z", "scan_duration": 1500000000}
    assert got["s"]["summary"] == {"total_vulnerabilities": 2, "severity_breakdown": {"HIGH": 1, "LOW": 1}, "category_breakdown": {"": 1, "c": 1}} and got["t"]["summary"]["total_vulnerabilities"] == 0
    assert got["s"]["metadata"]["scan_config"] == {"max_workers": 8, "timeout": 9, "use_semgrep_registry": False}
    rows = report.report_rows(f, heads, "finding_id")
    assert [json.loads(r.document).get("rule_id") for r in rows.filter("scan_id = 's'").orderBy("k").collect()] == [None, "q", "r"]
    report.write_reports(rows, str(tmp_path / "reports"))
    assert spark.read.text(str(tmp_path / "reports")).count() == 4
    assert json.loads(report.exported(heads, F.lit("2026-01-01T00:00:00Z").cast("timestamp")).filter("scan_id = 's'").first().report)["exportedAt"] == "2026-01-01T00:00:00Z"


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(1, k, k + 1) for k in range(150)] + [(2, 0, k) for k in range(1, 400)]
    out = graph.components(spark.createDataFrame(chain, "scan_id int, a bigint, b bigint")).collect()
    assert len(out) == 551 and {r.component for r in out} == {0}


def test_hundred_steps(spark):
    last = 100
    n = spark.createDataFrame([(1, k, k, "PARAMETER" if k == 0 else "METHOD_CALL", "println" if k == last else "load", 2) for k in range(last + 1)], "scan_id bigint, pos bigint, id bigint, type string, name string, arguments int")
    links = spark.createDataFrame([(1, k, k + 1) for k in range(last)], "scan_id bigint, a bigint, b bigint")
    ends = lambda i: n.filter(F.col("id") == i).select("scan_id", "id")
    assert [r.path for r in graph.shortest_paths(links, ends(0), ends(last)).collect()] == [list(range(last + 1))]


def test_labels_sanitizers_and_propagators(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 1, 6), (1, 6, 7), (1, 9, 8)], "scan_id int, a bigint, b bigint")
    seeds = spark.createDataFrame([(1, 1, "IN", None, False), (1, 3, "CAT", "IN", False), (1, 8, "IN", None, True)], "scan_id int, id bigint, label string, requires string, by_side_effect boolean")
    targets = spark.createDataFrame([(1, 4, "CAT"), (1, 2, "CAT"), (1, 7, None), (1, 9, None), (1, 11, None)], "scan_id int, id bigint, requires string")
    got = lambda **k: sorted((r.source, r.sink, r.label) for r in taint.labelled_taint(links, seeds, targets, **k).collect())
    assert got() == [(1, 4, "CAT"), (1, 7, "IN"), (8, 9, "IN")]
    assert got(blocked=spark.createDataFrame([(1, 6)], "scan_id int, id bigint"), extra=spark.createDataFrame([(1, 2, 11)], "scan_id int, a bigint, b bigint")) == [(1, 4, "CAT"), (1, 11, "IN"), (8, 9, "IN")]


def test_valid_paths_by_sink(spark):
    rows = [(["x", "y"], "exec", True, False), (["x", "y"], "eval", True, False), (["x", "y"], "println", False, True), (["x", "y"], "exec", False, True), (["x"], "exec", False, False), (["x", "y"], "other", False, False)]
    df = spark.createDataFrame([(0, k, p, s, c, v, 0.9) for k, (p, s, c, v) in enumerate(rows, 1)], "source int, sink int, path array<string>, sink_name string, cleaned boolean, checked boolean, confidence double")
    assert sorted(r.sink for r in taint.valid_paths(df, 0.5).collect()) == [2, 4]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_rounds_that_are_replaced_go(spark):
    first = session.cut(spark.range(3))
    assert first.count() == 3
    session.discard(first)
    kept = session.cut(spark.range(2))
    assert first._cut_path not in session._standing and kept._cut_path in session._standing


def test_stored_graphs_share_folders(spark, rows, tmp_path):
    """The number of folders and files doesn't grow with the number of graphs, and each graph comes back whole."""
    path, times = str(tmp_path / "graphs"), 2
    n = spark.range(600).selectExpr("case when id < 300 then concat('g\\n', id) when id < 599 then '' end as scan_id", "id as pos", "id", "'METHOD' as type", "'a\"b\\n' as name")
    e = n.selectExpr("scan_id", "pos", "id as source", "id + 1 as target", "'CONTAINS' as type").filter("pos % 2 = 0")
    for _ in range(times):  # the second time appends
        graph.write_graphs(n, e, path, exportedAt=F.lit("now"))
    folders = {p.parent for p in (tmp_path / "graphs").rglob("*.json*") if p.name[0] not in "._"}
    assert len(folders) <= 3 * graph.FOLDERS < 3 * 302
    whole = rows(graph.as_documents(n, e, exportedAt=F.lit("now")))
    assert rows(graph.read_graphs(spark, path, "string")) == sorted(whole * times, key=repr) and len(whole) == 600 + 300 + 302
    for one in ("g\n7", ""):
        assert rows(graph.read_graphs(spark, path, "string", one)) == sorted([r for r in whole if r[0] == one] * times, key=repr)
