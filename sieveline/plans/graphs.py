"""Queries over code graphs and flow, each with its SQL where SQL can say it.

The graphs are made from orders (nodes) and lineitem (edges): 200 consecutive order keys are one graph, types and names
follow from the keys, every fiftieth node repeats its predecessor's identifier, and some edges dangle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import language as lang
from sieveline.operators import flow, graph, history, match, report, taint
from sieveline.plans.scan import LINES_SQL, RULES_SQL, TRIM_SQL, scanned_lines, usable_rules
from sieveline.session import cut, load, scratch_path
from sieveline.sources import graphs

SPAN = 200
TYPES = ["FILE", "CLASS", "METHOD", "CONSTRUCTOR", "PARAMETER", "FIELD", "LOCAL_VARIABLE", "METHOD_CALL", "OBJECT_CREATION", "TRY_CATCH_BLOCK", "TYPE_CATCH_CALL", "RETURN_STATEMENT", "BINARY_EXPRESSION", "ASSIGNMENT", "FIELD_ACCESS", "STRING_LITERAL", "IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "METHOD_CALL", "METHOD_CALL"]
EDGES = ["CONTAINS", "DECLARES", "INVOKES", "CONTAINS_CONTROL_FLOW", "CONTAINS_EXCEPTION_HANDLING", "CONTAINS_EXPRESSION", "CONTAINS_LITERAL", "ACCESSES", "CONTAINS_ASSIGNMENT", "UNRELATED", "UNRELATED", "UNRELATED", "DATA_FLOW"]
NAMES = ["getParameter", "readLine", "executeQuery", "println", "trim", "escapeHtml", "isValid", "load", "save", "exec", "gets", "strcpy", "malloc"]


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the made graphs."""
    k = F.col("o_orderkey")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    nodes = orders.select(
        F.floor(k / SPAN).alias("scan_id"), k.alias("pos"), F.when(k % 50 == 0, k - 1).otherwise(k).alias("id"), _pick(TYPES, k).alias("type"), _pick(NAMES, F.floor(k / 3)).alias("name"), _pick(NAMES, F.floor(k / 5)).alias("className"),
        (k % 3).cast("int").alias("arguments"), F.when(k % 4 == 0, F.lit("new Object()")).alias("initializer"), (k % 2 == 0).alias("hasElse"), F.when(k % 7 == 0, F.lit("String")).otherwise(F.lit("int")).alias("dataType"), F.lit(None).cast("string").alias("scope"),
    )
    a = F.col("l_orderkey")
    edges = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(
        F.floor(a / SPAN).alias("scan_id"), (a * 10 + F.col("l_linenumber")).alias("pos"), a.alias("source"), F.when(F.col("l_partkey") % 97 == 0, a + 1000000).otherwise(a + F.col("l_partkey") % 9 - 4).alias("target"), _pick(EDGES, F.col("l_partkey") + F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("type")
    )
    return nodes, edges


def _view(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        n, e = graph.view(*tables(spark, d), name)
        return n.select("scan_id", F.lit("node").alias("kind"), "pos", "type", F.col("id").alias("source"), F.lit(None).cast("bigint").alias("target")).unionByName(e.select("scan_id", F.lit("edge").alias("kind"), "pos", "type", "source", "target"))

    return run


def g3_closed_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = graph.view(*tables(spark, d), "cfg_full")
    return graph.closed(n, e).select("scan_id", "pos", "source", "target", "type")


def g3_full_cfg(spark: SparkSession, d: str) -> DataFrame:
    return graph.full_cfg(*tables(spark, d))[1].select("scan_id", "source", "target", "type")


def g7_sequential(spark: SparkSession, d: str) -> DataFrame:
    return graph.sequential(*tables(spark, d)).select("scan_id", "source", "target")


def g8_branches(spark: SparkSession, d: str) -> DataFrame:
    return graph.branches(*tables(spark, d))


def g10_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.calls(tables(spark, d)[0]).select("scan_id", "source", "target")


def g11_catches(spark: SparkSession, d: str) -> DataFrame:
    return graph.catches(*tables(spark, d))


def a8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(*tables(spark, d))


def a9_plain_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts that give initializers no credit, of the graphs and of their control-flow views."""
    n, e = tables(spark, d)
    whole = graph.statistics(n, e, initializers=False).withColumn("of", F.lit("graph"))
    return whole.unionByName(graph.statistics(*graph.view(n, e, "cfg_full"), initializers=False).withColumn("of", F.lit("cfg")))


def a17_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each graph, its views and its tainted sinks."""
    n, e = tables(spark, d)
    return taint.analysis_metadata(n, e, taint.reached_sinks(n, e))


def j15_orphans(spark: SparkSession, d: str) -> DataFrame:
    """What the check of a control-flow view complains of: nodes without edges, edges without nodes."""
    n, e = graph.view(*tables(spark, d), "cfg_full")
    return graph.orphans(n, e).select("scan_id", "pos", F.lit("node").alias("kind")).unionByName(graph.dangling(n, e).select("scan_id", "pos", F.lit("edge").alias("kind")))


def j10_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Variables whose initializer names a source."""
    n, _ = tables(spark, d)
    told = n.withColumn("initializer", F.when(F.col("initializer").isNotNull(), F.concat(F.lit("new "), "className", F.lit("("), F.lit("get"), F.lit(")"))))
    return taint.mentions(told).groupBy("scan_id", "id").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


def j11_places(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the places that the views' copies know."""
    n, _ = tables(spark, d)
    last = graphs.last_by_id(n).select("scan_id", "id")
    copy = lambda every, name: last.filter(F.col("id") % every == 0).select("scan_id", "id", F.concat(F.lit(name), (F.col("id") % 5).cast("string")).alias("fileName"), (F.col("id") % 100).alias("lineNumber"))
    return taint.with_places(last, copy(2, "d"), copy(3, "c")).select("scan_id", "id", F.col("fileName").alias("file_name"), F.col("lineNumber").alias("line_number"))


def j12_parameters(spark: SparkSession, d: str) -> DataFrame:
    return taint.callee_links(*tables(spark, d))


def x12_one_graph(spark: SparkSession, d: str) -> DataFrame:
    """The control-flow view of one graph, by its identifier."""
    n, e = (history.of_key(t, "scan_id", 3) for t in tables(spark, d))
    n, e = graph.view(n, e, "cfg")
    return n.select("pos", F.lit("node").alias("kind"), "type").unionByName(e.select("pos", F.lit("edge").alias("kind"), "type"))


def x14_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return taint.cleaning_nodes(tables(spark, d)[0])


def k7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Graphs written as JSON lines and read back."""
    n, e = tables(spark, d)
    path = scratch_path(spark, "graphs")
    graph.write_graphs(n.select("scan_id", "pos", "id", "type", "name"), e, path, exportedAt=F.lit("2026-01-01T00:00:00Z"))
    rows = graph.read_graphs(spark, path)
    doc = F.from_json("document", "type string, exportedAt string, id bigint, source bigint, target bigint, totalNodes bigint, totalEdges bigint")
    return rows.withColumn("d", doc).select("scan_id", "part", "pos", F.coalesce("d.type", "d.exportedAt").alias("what"), F.coalesce("d.id", "d.source", "d.totalNodes").alias("a"), F.coalesce("d.target", "d.totalEdges").alias("b"))


def d14_rule_taint(spark: SparkSession, d: str) -> DataFrame:
    """Taint by a rule's own sources, labels, sanitizers, propagators and sinks."""
    n, e = tables(spark, d)
    last = cut(graphs.last_by_id(n).select("scan_id", "id", "type", "name"), "last")
    parameters = last.filter("type = 'PARAMETER'").select("scan_id", "id", F.lit("INPUT").alias("label"), F.lit(None).cast("string").alias("requires"), (F.col("id") % 2 == 0).alias("by_side_effect"))
    joined = last.filter("type = 'BINARY_EXPRESSION' or type = 'ASSIGNMENT'").select("scan_id", "id", F.lit("CONCAT").alias("label"), F.lit("INPUT").alias("requires"), F.lit(False).alias("by_side_effect"))
    sinks = last.filter("type = 'METHOD_CALL' and name in ('executeQuery', 'exec', 'println')").select("scan_id", "id", F.when(F.col("name") != "println", "CONCAT").alias("requires"))
    blocked = last.filter("type = 'METHOD_CALL' and name = 'escapeHtml'").select("scan_id", "id")
    extra = e.filter("type = 'UNRELATED'").select("scan_id", F.col("source").alias("a"), F.col("target").alias("b"))
    return taint.labelled_taint(taint.flow_links(n, e), parameters.unionByName(joined), sinks, blocked, extra)


def x13_last_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.last_by_id(tables(spark, d)[0]).select("scan_id", "id", "pos", "type", "name")


def x13_names(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ids_by_name(tables(spark, d)[0]).select("scan_id", "name", F.size("ids").cast("bigint").alias("n"), F.element_at("ids", 1).alias("first_id"))


def proj09_call_flags(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d)[0].filter("type = 'METHOD_CALL'")
    return n.withColumns(graphs.call_flags(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("taint_source", "taint_sink", "dangerous", "memory_operation")), F.count("vulnerability").alias("flagged"))


def proj10_sql_literals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "findings").groupBy(graphs.sql_literal(F.col("code_snippet")).alias("holds_sql")).agg(F.count("*").alias("n"))


def s8_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The graphs written as JSON documents, read back and taken apart."""
    n, e = tables(spark, d)
    ns = n.groupBy(F.col("scan_id").cast("string").alias("scan_id")).agg(F.collect_list(F.struct("id", "type", "name", "arguments", "hasElse")).alias("nodes"))
    es = e.groupBy(F.col("scan_id").cast("string").alias("scan_id")).agg(F.collect_list(F.struct("source", "target", "type")).alias("edges"))
    parsed = graphs.parse(ns.join(es, "scan_id").select(F.to_json(F.struct("*")).alias("payload")))
    nodes = graphs.nodes(parsed).groupBy("scan_id").agg(F.count("*").alias("n_nodes"), F.sum("id").alias("ids"), F.sum("arguments").cast("bigint").alias("arguments"))
    return nodes.join(graphs.edges(parsed).groupBy("scan_id").agg(F.count("*").alias("n_edges")), "scan_id")


def g6_ast(spark: SparkSession, d: str) -> DataFrame:
    """Graph documents read and handed on as their syntax view."""
    n, e = tables(spark, d)
    docs = n.select(F.col("scan_id").cast("string").alias("scan_id"), F.struct("id", "type", "name").alias("x")).groupBy("scan_id").agg(F.collect_list("x").alias("nodes"))
    ends = e.select(F.col("scan_id").cast("string").alias("scan_id"), F.struct("source", "target", "type").alias("x")).groupBy("scan_id").agg(F.collect_list("x").alias("edges"))
    parsed = graphs.parse(docs.join(ends, "scan_id").select(F.to_json(F.struct("*")).alias("payload")))
    n, e = graph.view(graphs.nodes(parsed), graphs.edges(parsed), "ast")
    return n.select("scan_id", "type", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(e.select("scan_id", "type", F.col("source").alias("a"), F.col("target").alias("b")))


def proj04_graph_language(spark: SparkSession, d: str) -> DataFrame:
    """Languages of graphs: some say theirs, the others import what a language has, or nothing."""
    n = tables(spark, d)[0]
    sets = n.groupBy("scan_id").agg(F.collect_set("type").alias("types"), F.collect_set("name").alias("names"), F.collect_set("dataType").alias("data_types"))
    imports = F.when(F.col("scan_id") % 3 == 0, F.array(F.lit("java.util.List"))).when(F.col("scan_id") % 3 == 1, F.array(F.lit("import os"), F.lit("stdio.h"))).otherwise(F.array().cast("array<string>"))
    out = lang.by_graph(sets.withColumn("imports", imports).withColumn("language", F.when(F.col("scan_id") % 5 == 0, F.lit("Cpp"))))
    return out.select("scan_id", "language", F.col("score").cast("bigint").alias("score"))


def g12_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(tables(spark, d)[1])


def g13_data_flow(spark: SparkSession, d: str) -> DataFrame:
    return graph.data_flow(*tables(spark, d))


def g14_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.data_flow(*tables(spark, d)))


def g15_reached_sinks(spark: SparkSession, d: str) -> DataFrame:
    return taint.reached_sinks(*tables(spark, d))


def g16_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps from every source to every sink it leads to, over the mixed adjacency and the data flow."""
    return g16_paths(spark, d).select("scan_id", "source", "sink", "steps")


def g16_paths(spark: SparkSession, d: str) -> DataFrame:
    """The same with the paths; of equally short ones the one with the smallest identifiers."""
    n, e = tables(spark, d)
    links = cut(graph.adjacency(e).unionByName(graph.data_flow(n, e)).distinct(), "links-both")
    out = graph.shortest_paths(links, taint.sources(n), taint.sinks(n))
    return out.select("scan_id", "source", "sink", (F.size("path") - 1).cast("bigint").alias("steps"), F.array_join("path", ">").alias("path"))


def g17_taint(spark: SparkSession, d: str) -> DataFrame:
    out = taint.taint(*tables(spark, d))
    return out.select("scan_id", "source", "sink", "sink_name", "severity", (F.size("path") - 1).cast("bigint").alias("steps"), F.array_join("path", ">").alias("path"))


def f13_names(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d)[0].groupBy("name").agg(F.count("*").alias("n"))
    return n.select("name", "n", taint.sanitizes(F.col("name")).alias("sanitizes"), taint.validates(F.col("name")).alias("validates"))


def f14_weights(spark: SparkSession, d: str) -> DataFrame:
    n = tables(spark, d)[0]
    s = taint.weighted_sources(n).select("scan_id", "id", "confidence", F.lit("source").alias("kind"))
    return s.unionByName(taint.weighted_sinks(n).select("scan_id", "id", F.col("weight").alias("confidence"), F.lit("sink").alias("kind")))


def g18_flow(spark: SparkSession, d: str) -> DataFrame:
    return taint.flow_links(*tables(spark, d))


def g19_weighted_reach(spark: SparkSession, d: str) -> DataFrame:
    out = taint.propagate(*tables(spark, d), threshold=0.6)
    return out.select("scan_id", "source", "id", "cleaned", "checked", F.round("confidence", 7).alias("confidence"))


def x15_weighted_taint(spark: SparkSession, d: str) -> DataFrame:
    out = taint.weighted_taint(*tables(spark, d), threshold=0.6)
    return out.select("scan_id", "source", "sink", "sink_name", F.round("confidence", 7).alias("confidence"), F.array_join("path", ">").alias("path"), "cleaned", "checked", F.col("place").cast("bigint").alias("place"))


def g22_line_cfg(spark: SparkSession, d: str) -> DataFrame:
    out = flow.cfg_nodes(scanned_lines(spark, d))
    return out.select("file_id", F.col("node").cast("bigint").alias("node"), "type", "label", "line_no")


def g22_line_cfg_edges(spark: SparkSession, d: str) -> DataFrame:
    return flow.cfg_edges(scanned_lines(spark, d))


def proj18_line_types(spark: SparkSession, d: str) -> DataFrame:
    out = flow.cfg_nodes(scanned_lines(spark, d))
    return out.groupBy("file_id", "type").agg(F.count("*").alias("n"))


def e3_definitions(spark: SparkSession, d: str) -> DataFrame:
    rows = flow.significant(scanned_lines(spark, d), block_comments=False)
    return flow.definitions(rows).select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("ord").cast("bigint").alias("ord"), "name", "type")


def e4_uses(spark: SparkSession, d: str) -> DataFrame:
    rows = flow.significant(scanned_lines(spark, d), block_comments=False)
    return flow.uses(rows).groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("line_no").cast("bigint").alias("first_line"))


def g23_line_dfg(spark: SparkSession, d: str) -> DataFrame:
    nodes = flow.dfg_nodes(scanned_lines(spark, d))
    return flow.dfg_edges(nodes).select("file_id", F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), "name")


def a15_variables(spark: SparkSession, d: str) -> DataFrame:
    out = flow.variables(flow.dfg_nodes(scanned_lines(spark, d)))
    return out.select("file_id", "name", "type", F.size("definition_sites").cast("bigint").alias("definitions"), F.size("use_sites").cast("bigint").alias("uses"))


def j8_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Each node of a graph with the last declaration of its name before it."""
    n = tables(spark, d)[0].withColumn("declares", F.col("type").isin("LOCAL_VARIABLE", "PARAMETER", "FIELD"))
    return flow.latest_declaration(n, ["scan_id"]).select("scan_id", "pos", "name", "declared_at")


def j13_sensitive_uses(spark: SparkSession, d: str) -> DataFrame:
    lines = scanned_lines(spark, d)
    return flow.sensitive_uses(flow.dfg_nodes(lines), lines).select("file_id", "line_no", "name")


def j14_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Lines after a return or throw once the edges out of those are cut."""
    lines = scanned_lines(spark, d)
    nodes, edges = flow.cfg_nodes(lines), flow.cfg_edges(lines)
    ends = nodes.filter("code like '%return%' or code like '%throw%'").select("file_id", F.col("node").cast("bigint").alias("source"))
    return flow.unreachable(nodes, edges.join(ends, ["file_id", "source"], "left_anti")).select("file_id", F.col("node").cast("bigint").alias("node"), "line_no")


def s17_pseudo_ast(spark: SparkSession, d: str) -> DataFrame:
    out = flow.pseudo_ast(scanned_lines(spark, d))
    return out.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("ord").cast("bigint").alias("ord"), "type", "name", F.col("indent").cast("bigint").alias("indent"))


def g24_ast_flow(spark: SparkSession, d: str) -> DataFrame:
    out = flow.ast_flow(flow.pseudo_ast(scanned_lines(spark, d)))
    return out.select("file_id", "type", F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"))


def f10_semantics(spark: SparkSession, d: str) -> DataFrame:
    out = flow.semantic_matches(flow.pseudo_ast(scanned_lines(spark, d)))
    return out.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "rule_id", "severity", "confidence")


def x7_composition(spark: SparkSession, d: str) -> DataFrame:
    """Pattern, semantic, data-flow and control-flow matches of all files together, counted per rule, and the files' metrics."""
    lines = scanned_lines(spark, d)
    matches = match.find_matches(lines, usable_rules(spark, d), match_on="trimmed").select("file_id", "line_no", "rule_id")
    parts = [f10_semantics(spark, d).select("file_id", "line_no", "rule_id"), j13_sensitive_uses(spark, d).select("file_id", "line_no", F.lit("sensitive-data-exposure").alias("rule_id")), flow.unreachable(flow.cfg_nodes(lines), flow.cfg_edges(lines)).select("file_id", "line_no", F.lit("unreachable-code").alias("rule_id"))]
    for p in parts:
        matches = matches.unionByName(p)
    found = matches.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))
    sizes = report.line_metrics(lines, "file_id").agg(F.sum("code_lines").alias("code"), F.sum("complexity").alias("complexity"), F.count("*").alias("files"))
    each = F.explode(F.array(F.struct(F.lit("(code lines)").alias("rule_id"), F.col("code").alias("n")), F.struct(F.lit("(complexity)").alias("rule_id"), F.col("complexity").alias("n"))))
    return found.unionByName(sizes.select(each.alias("m"), "files").select("m.rule_id", "m.n", "files"))


def k8_dot(spark: SparkSession, d: str) -> DataFrame:
    n, e = tables(spark, d)
    out = graph.dot(n.withColumn("label", F.col("name")), graph.closed(n, e))
    return out.select("scan_id", F.md5("dot").alias("dot"))


QUERIES = {
    "g1_cfg_view": _view("cfg"), "g2_cfg_wide_view": _view("cfg_wide"), "g4_dfg_view": _view("dfg"), "g5_ast_view": _view("ast"),
} | {f.__name__: f for f in (
    g3_closed_edges, g3_full_cfg, g7_sequential, g8_branches, g10_calls, g11_catches, a8_statistics, j15_orphans, x13_last_nodes, x13_names, proj09_call_flags, proj10_sql_literals, s8_ingest, g6_ast, proj04_graph_language, g12_adjacency, g13_data_flow, g14_components, g15_reached_sinks,
    g16_shortest, g16_paths, j10_mentions, j11_places, j12_parameters, x12_one_graph, x14_cleaning, k7_documents, d14_rule_taint, a9_plain_statistics, a17_metadata, g17_taint, f13_names, f14_weights, g18_flow, g19_weighted_reach, x15_weighted_taint, g22_line_cfg, g22_line_cfg_edges, proj18_line_types, e3_definitions, e4_uses, g23_line_dfg, a15_variables, j8_declarations, j13_sensitive_uses, j14_unreachable, s17_pseudo_ast,
    g24_ast_flow, f10_semantics, x7_composition, k8_dot,
)}


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_G = f"""
with recursive n as (
  select o_orderkey // {SPAN} as scan_id, o_orderkey as pos, case when o_orderkey % 50 = 0 then o_orderkey - 1 else o_orderkey end as id, {_array(TYPES)}[o_orderkey % {len(TYPES)} + 1] as type, {_array(NAMES)}[(o_orderkey // 3) % {len(NAMES)} + 1] as name,
    {_array(NAMES)}[(o_orderkey // 5) % {len(NAMES)} + 1] as className, o_orderkey % 3 as arguments, case when o_orderkey % 4 = 0 then 'new Object()' end as initializer, o_orderkey % 2 = 0 as hasElse, case when o_orderkey % 7 = 0 then 'String' else 'int' end as dataType
  from orders
), e as (
  select l_orderkey // {SPAN} as scan_id, l_orderkey * 10 + l_linenumber as pos, l_orderkey as source, case when l_partkey % 97 = 0 then l_orderkey + 1000000 else l_orderkey + l_partkey % 9 - 4 end as target, {_array(EDGES)}[(l_partkey + l_suppkey * 3 + l_linenumber) % {len(EDGES)} + 1] as type
  from lineitem
), m as (select * from n qualify row_number() over (partition by scan_id, id order by pos desc) = 1),
df0 as (
  select scan_id, source as a, target as b from e where type = 'DATA_FLOW'
  union select e.scan_id, e.source, d.id from e join m c on c.scan_id = e.scan_id and c.id = e.target and c.type = 'METHOD_CALL' join m d on d.scan_id = e.scan_id and d.type = 'METHOD' and d.name = c.name where e.type = 'INVOKES'
), df as (select scan_id, a, b from df0 union select scan_id, b, a from df0),
adj as (select scan_id, source as a, target as b from e where type in {_list(graph.FORWARD)} union select scan_id, target, source from e where type in {_list(graph.BACKWARD)}),
src as (select * from m where type = 'PARAMETER' or (type = 'METHOD_CALL' and name in {_list(taint.SOURCES)})),
snk as (select * from m where type = 'METHOD_CALL' and name in {_list(taint.SINKS)} and arguments > 0)
"""


def _view_sql(name: str) -> str:
    node_types, edge_types = graph.VIEWS[name]
    return _G + f"select scan_id, 'node' as kind, pos, type, id as source, null::bigint as target from n where type in {_list(node_types)} union all select scan_id, 'edge', pos, type, source, target from e where type in {_list(edge_types)}"


_FULL_N, _FULL_E = graph.VIEWS["cfg_full"]
_CLOSED = f"kn as (select * from n where type in {_list(_FULL_N)}), ke as (select * from e where type in {_list(_FULL_E)} and exists (select 1 from kn where kn.scan_id = e.scan_id and kn.id = e.source) and exists (select 1 from kn where kn.scan_id = e.scan_id and kn.id = e.target))"
_SEQ = """select scan_id, target as source, nxt as target from (select scan_id, target, lead(target) over (partition by scan_id, source order by target) as nxt from (
  select distinct x.scan_id, x.source, x.target from {0} x join {1} a on a.scan_id = x.scan_id and a.id = x.source and a.type in ('METHOD', 'CONSTRUCTOR') join {1} b on b.scan_id = x.scan_id and b.id = x.target and b.type not in ('METHOD', 'CONSTRUCTOR') where x.type in ('CONTAINS', 'CONTAINS_CONTROL_FLOW'))) where nxt is not null"""
_BRANCH = "select e.scan_id, e.source, e.target, case when n.type <> 'IF_STATEMENT' then 'LOOP_BODY' when n.hasElse then 'ELSE_BRANCH' else 'THEN_BRANCH' end as type from e join {0} n on n.scan_id = e.scan_id and n.id = e.source and n.type in ('IF_STATEMENT', 'FOR_LOOP', 'WHILE_LOOP', 'FOR_EACH_LOOP') where e.type = 'CONTAINS_CONTROL_FLOW'"
_CALL = "select u.scan_id, u.id as source, d.id as target, 'CALLS' as type from {0} u join (select distinct scan_id, id, name from {0} where type in ('METHOD', 'CONSTRUCTOR')) d on d.scan_id = u.scan_id and d.name = case u.type when 'METHOD_CALL' then u.name else u.className end where u.type in ('METHOD_CALL', 'OBJECT_CREATION')"
_CATCH = "select e.scan_id, e.source, e.target, 'CATCH_BRANCH' as type from e join {1} c on c.scan_id = e.scan_id and c.id = e.target and c.type = 'TYPE_CATCH_CALL' join {0} t on t.scan_id = e.scan_id and t.id = e.source and t.type = 'TRY_CATCH_BLOCK' where e.type = 'DECLARES'"
_KM = "km as (select * from kn qualify row_number() over (partition by scan_id, id order by pos desc) = 1)"
_CONTROL = " or ".join(f"contains(code, '{w}')" for w in flow.CONTROL_WORDS)
_FUNC = "case language " + " ".join(f"when '{k}' then regexp_matches(code, '{p}')" for k, p in flow.FUNCTION_PATTERNS.items()) + " else false end"
_SIG = f"""
with {LINES_SQL}, code0 as (select *, {TRIM_SQL.format('line')} as code from lines), codes as (select * from code0 where code <> '' and not regexp_matches(code, '^(?://|#)')),
sig as (select *, row_number() over (partition by file_id order by line_no) as node from codes where not starts_with(code, '/*')),
cfg as (
  select file_id, node, case when {_FUNC} then 'function' when {_CONTROL} then 'control' when regexp_matches(code, '\\w+\\s*[=]\\s*') and not contains(code, '==') and not contains(code, '!=') then 'assignment' when regexp_matches(code, '\\w+\\s*\\(') then 'call' else 'statement' end as type,
    case when length(code) > 30 then substring(code, 1, 30) || '...' else code end as label, line_no, code from sig
  union all select file_id, 0, 'entry', 'ENTRY', 1, null from lines group by 1 union all select file_id, -1, 'exit', 'EXIT', max(line_no), null from lines group by 1
),
cfge as (
  select file_id, node - 1 as source, node as target, 'next' as label from sig union all
  select file_id, coalesce(max(node), 0), -1, 'end' from sig group by 1
),
defs as (
  select file_id, line_no, i - 1 as ord, case language when 'java' then ns2[i] else ns[i] end as name, case language when 'java' then ns[i] end as type from (
    select *, unnest(generate_series(1, len(ns))) as i from (
      select *, case language when 'javascript' then regexp_extract_all(code, '(?:let|const|var)\\s+(\\w+)', 1) when 'python' then regexp_extract_all(code, '(\\w+)\\s*=', 1) when 'java' then regexp_extract_all(code, '(\\w+)\\s+(\\w+)\\s*[=;]', 1) else [] end as ns,
        case language when 'java' then regexp_extract_all(code, '(\\w+)\\s+(\\w+)\\s*[=;]', 2) else [] end as ns2 from codes))
),
words as (select file_id, line_no, list_filter(regexp_extract_all(code, '\\b[a-zA-Z_]\\w*\\b'), lambda w: length(w) > 1 and not list_contains({_array(flow.NOT_VARIABLES)}, w)) as ws from codes),
uses as (select file_id, line_no, name, min(ord) as ord from (select file_id, line_no, unnest(ws) as name, unnest(generate_series(0, len(ws) - 1)) as ord from words) group by 1, 2, 3),
dfg as (select *, row_number() over (partition by file_id order by line_no, rank, ord) as node from (select file_id, line_no, ord, name, type, 'definition' as kind, 0 as rank from defs union all select file_id, line_no, ord, name, null, 'use', 1 from uses)),
dfge as (select file_id, source, node as target, name from (select *, last_value(case when kind = 'definition' then node end ignore nulls) over (partition by file_id, name order by node rows between unbounded preceding and current row) as source from dfg) where kind = 'use' and source is not null),
sens as (select d.file_id, d.line_no, d.name from dfg d join lines l using (file_id, line_no) where d.kind = 'use' and ({' or '.join(f"contains(lower(d.name), '{w}')" for w in flow.SENSITIVE)}) and ({' or '.join(f"contains(l.line, '{w}')" for w in flow.EXPOSING)}))
"""
_HAS = lambda *ws: "(" + " or ".join(f"contains(code, '{w}')" for w in ws) + ")"
_PAREN = "(contains(code, '(') and contains(code, ')'))"
_NAMED = "coalesce(nullif(regexp_extract(code, '{0}\\s+(\\w+)', 1), ''), 'unknown')"
_AST = _SIG.rstrip() + f""",
js as (select file_id, language, line_no, unnest(generate_series(0, len(ts) - 1)) as ord, unnest(ts) as type, null as name, 0 as indent, code from (
  select *, list_filter([case when {_HAS('function ', '=> ')} then 'FunctionDeclaration' end, case when {_HAS('var ', 'let ', 'const ')} then 'VariableDeclaration' end, case when {_PAREN} then 'CallExpression' end], lambda x: x is not null) as ts from code0 where language in ('javascript', 'typescript'))),
py as (select file_id, language, line_no, 0 as ord, type, case type when 'FunctionDef' then {_NAMED.format('def')} when 'ClassDef' then {_NAMED.format('class')} end as name, length(line) - length(regexp_replace(line, '^\\s+', '')) as indent, code from (
  select *, case when starts_with(code, 'def ') then 'FunctionDef' when starts_with(code, 'class ') then 'ClassDef' when starts_with(code, 'import ') or starts_with(code, 'from ') then 'Import' when contains(code, '=') and not contains(code, '==') then 'Assign' when {_PAREN} then 'Expr' end as type from code0 where language = 'python' and code <> '') where type is not null),
j0 as (select *, {_HAS('class ')} and contains(code, '{{') as is_class, nullif(regexp_extract(code, '(?:public|private|protected)\\s+(?:static\\s+)?(?:\\w+\\s+)?(\\w+)\\s*\\(', 1), '') as method from code0 where language = 'java' and code <> '' and not starts_with(code, 'package ') and not starts_with(code, 'import ')),
j1 as (select *, last_value(case when is_class then 1 end ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and current row) is not null and {_HAS('public ', 'private ', 'protected ')} as member from j0),
java as (select file_id, language, line_no, 0 as ord, type, case type when 'ClassDeclaration' then {_NAMED.format('class')} when 'MethodDeclaration' then method end as name, 0 as indent, code from (
  select *, case when is_class then 'ClassDeclaration' when member and contains(code, '(') then case when method is not null then 'MethodDeclaration' end when member and contains(code, ';') then 'FieldDeclaration' end as type from j1) where type is not null),
ast as (from js union all from py union all from java),
checks as (select file_id, line_no, unnest(list_filter([
  case when type = 'CallExpression' and contains(code, 'app.') and {_HAS('.get(', '.post(')} and not ({' or '.join(f"contains(lower(code), '{w}')" for w in flow.AUTH_WORDS)}) then {{'rule_id': 'missing-auth-check', 'severity': 'high', 'confidence': 0.7::double}} end,
  case when type = 'CallExpression' and {_HAS('innerHTML', 'document.write')} then {{'rule_id': 'xss-reflection', 'severity': 'high', 'confidence': 0.8::double}} end,
  case when type = 'CallExpression' and contains(code, 'cookie') and not (contains(code, 'secure') and contains(code, 'httpOnly')) then {{'rule_id': 'insecure-cookie', 'severity': 'medium', 'confidence': 0.9::double}} end,
  case when type = 'Expr' and contains(code, 'cursor.execute') and contains(code, '%s') then {{'rule_id': 'sql-injection-python', 'severity': 'critical', 'confidence': 0.9::double}} end,
  case when type = 'Expr' and contains(code, 'pickle.load') then {{'rule_id': 'insecure-deserialization-python', 'severity': 'high', 'confidence': 0.95::double}} end,
  case when type = 'Import' and contains(code, 'random') then {{'rule_id': 'weak-random-python', 'severity': 'medium', 'confidence': 0.6::double}} end,
  case when type = 'MethodDeclaration' and name = 'readObject' and not ({' or '.join(f"contains(lower(code), '{w}')" for w in flow.CHECK_WORDS)}) then {{'rule_id': 'insecure-serialization-java', 'severity': 'high', 'confidence': 0.8::double}} end,
  case when type = 'MethodDeclaration' and contains(code, 'Statement') and contains(code, 'executeQuery') and not contains(code, 'PreparedStatement') then {{'rule_id': 'sql-injection-java', 'severity': 'critical', 'confidence': 0.9::double}} end
  ], lambda x: x is not null)) as r from ast)
"""
_WEIGHT = lambda table: "case name " + " ".join(f"when '{k}' then {v}::double" for k, v in table.items()) + " end"
_FLOW_TYPES = _list(["DATA_FLOW", "DECLARES", "ACCESSES", *taint.CONTROL_TYPES])
_REACH = """, reach(scan_id, source, id) as (select scan_id, id, id from src union select r.scan_id, r.source, df.b from reach r join df on df.scan_id = r.scan_id and df.a = r.id)"""
_CLEANS = f"(lower({{0}}) in {_list(taint.SANITIZER_NAMES)} or regexp_matches({{0}}, '{taint.SANITIZER}'))"
_CHECKS = f"(lower({{0}}) in {_list(taint.VALIDATOR_NAMES)} or regexp_matches({{0}}, '{taint.VALIDATOR}'))"
_WALK = """, lnk as (select * from adj union select * from df), walk(scan_id, source, node, steps, path) using key (scan_id, source, node) as (
  select scan_id, id, id, 0::bigint, [id] from src
  union select w.scan_id, w.source, lnk.b, min(w.steps) + 1, min(list_append(w.path, lnk.b)) from walk w join lnk on lnk.scan_id = w.scan_id and lnk.a = w.node where not exists (select 1 from recurring.walk r where r.scan_id = w.scan_id and r.source = w.source and r.node = lnk.b) group by all)"""
_FACTORS = "coalesce(case x.name " + " ".join(f"when '{k}' then {v}::double" for k, v in taint.MODIFIERS.items()) + " end, 1.0::double)"
_SPREAD = f""", ctl as (select distinct scan_id, source as id from e where type in {_list(taint.CONTROL_TYPES)}),
hop as (
  select l.scan_id, l.a, l.b, {_FACTORS} * case when ctl.id is not null then {taint.CONTROLLED}::double else 1.0::double end as factor, coalesce({_CLEANS.format('x.name')}, false) as cleans, coalesce({_CHECKS.format('x.name')}, false) as checks, false as call
  from (select scan_id, source as a, target as b from e where type in {_FLOW_TYPES} union select scan_id, target, source from e where type = 'CONTAINS_ASSIGNMENT') l join m x on x.scan_id = l.scan_id and x.id = l.b left join ctl on ctl.scan_id = l.scan_id and ctl.id = l.b
  union all select distinct u.scan_id, u.id, p.id, {taint.CALLEE}::double, false, false, true from m u join m f on f.scan_id = u.scan_id and f.name = u.name and f.type in ('METHOD', 'CONSTRUCTOR') join e on e.scan_id = f.scan_id and e.source = f.id and e.type = 'DECLARES' join m p on p.scan_id = e.scan_id and p.id = e.target and p.type = 'PARAMETER' where u.type = 'METHOD_CALL'
),
ws as (select scan_id, id, case type when 'METHOD_CALL' then {_WEIGHT(taint.SOURCE_WEIGHTS)} when 'PARAMETER' then case when contains(dataType, 'String') then 0.98 else 0.5 end when 'FIELD' then case when contains(lower(dataType), 'string') or regexp_matches(lower(name), 'input|request|param') then 0.95 end end::double as c from m),
heat(scan_id, source, id, cleaned, checked, c) using key (scan_id, source, id, cleaned, checked) as (
  select scan_id, id, id, false, false, c from ws where c >= 0.6
  union select z.scan_id, z.source, z.b, z.cl, z.ch, max(z.v) from (
    select h.scan_id, h.source, hop.b, h.cleaned or hop.cleans as cl, h.checked or hop.checks as ch,
      h.c * case when call then factor else factor * case when h.checked or hop.checks then least(1.0::double, case when h.cleaned or hop.cleans then {taint.SANITIZED}::double else 1.0::double end + {taint.VALIDATED}::double) when h.cleaned or hop.cleans then {taint.SANITIZED}::double else 1.0::double end end as v
    from heat h join hop on hop.scan_id = h.scan_id and hop.a = h.id) z
  where z.v >= 0.6 and not exists (select 1 from recurring.heat r where r.scan_id = z.scan_id and r.source = z.source and r.id = z.b and r.cleaned = z.cl and r.checked = z.ch and r.c >= z.v - 1e-12) group by all)"""
_GRAPH_SCORES = {k: f"(case when list_has_any(types, {_array(lang.NODE_TYPES[k])}) then 3 else 0 end + case when {' or '.join(f'''len(list_filter(imports, lambda x: contains(x, '{i}'))) > 0''' for i in lang.IMPORTS[k])} then 2 else 0 end + case when list_has_any(names, {_array(lang.KEYWORDS[k])}) then 2 else 0 end + case when list_has_any(data_types, {_array(lang.DATA_TYPES[k])}) then 1 else 0 end)" for k in lang.KEYWORDS}
SQL = {
    "g1_cfg_view": _view_sql("cfg"), "g2_cfg_wide_view": _view_sql("cfg_wide"), "g4_dfg_view": _view_sql("dfg"), "g5_ast_view": _view_sql("ast"),
    "g3_closed_edges": _G.rstrip() + f", {_CLOSED} select scan_id, pos, source, target, type from ke",
    "g3_full_cfg": _G.rstrip() + f""", {_CLOSED}, {_KM}, alle as (select scan_id, source, target, type from ke union all select *, 'SEQUENTIAL_FLOW' from ({_SEQ.format('ke', 'km')}) union all {_BRANCH.format('kn')} union all {_CALL.format('kn')} union all {_CATCH.format('kn', 'km')})
      select scan_id, source, target, type from alle""",
    "g6_ast": _G + f"select scan_id::varchar as scan_id, type, id as a, null::bigint as b from n where type in {_list(graph.VIEWS['ast'][0])} union all select scan_id::varchar, type, source, target from e where type in {_list(graph.VIEWS['ast'][1])}",
    "g7_sequential": _G + _SEQ.format("e", "m"),
    "g8_branches": _G + _BRANCH.format("n"),
    "g10_calls": _G + f"select scan_id, source, target from ({_CALL.format('n')})",
    "g11_catches": _G + _CATCH.format("n", "m"),
    "a8_statistics": _G + f"""select scan_id, coalesce(total_nodes, 0) as total_nodes, coalesce(method_calls, 0) as method_calls, coalesce(assignments, 0) as assignments, coalesce(string_literals, 0) as string_literals, coalesce(control_flow_nodes, 0) as control_flow_nodes, coalesce(total_edges, 0) as total_edges from
      (select scan_id, count(*) as total_nodes, count(*) filter (type in {_list(graph.CALLS)}) as method_calls, count(*) filter (type = 'ASSIGNMENT' or (type in ('LOCAL_VARIABLE', 'FIELD') and initializer is not null)) as assignments, count(*) filter (type = 'STRING_LITERAL') as string_literals, count(*) filter (type in {_list(graph.CONTROL)}) as control_flow_nodes from n group by 1)
      full join (select scan_id, count(*) as total_edges from e group by 1) using (scan_id)""",
    "a9_plain_statistics": _G.rstrip() + f""", vn as (select scan_id, type, 'graph' as of from n union all select scan_id, type, 'cfg' from n where type in {_list(_FULL_N)}), ve as (select scan_id, 'graph' as of from e union all select scan_id, 'cfg' from e where type in {_list(_FULL_E)})
      select scan_id, of, coalesce(total_nodes, 0) as total_nodes, coalesce(method_calls, 0) as method_calls, coalesce(assignments, 0) as assignments, coalesce(string_literals, 0) as string_literals, coalesce(control_flow_nodes, 0) as control_flow_nodes, coalesce(total_edges, 0) as total_edges from
      (select scan_id, of, count(*) as total_nodes, count(*) filter (type in {_list(graph.CALLS)}) as method_calls, count(*) filter (type = 'ASSIGNMENT') as assignments, count(*) filter (type = 'STRING_LITERAL') as string_literals, count(*) filter (type in {_list(graph.CONTROL)}) as control_flow_nodes from vn group by 1, 2)
      full join (select scan_id, of, count(*) as total_edges from ve group by 1, 2) using (scan_id, of)""",
    "a17_metadata": _G.rstrip() + _REACH + f""", t as (select r.scan_id, r.source, r.id from reach r join snk on snk.scan_id = r.scan_id and snk.id = r.id where r.source <> r.id),
      u as (select scan_id, 'n' as w from n union all select scan_id, 'e' from e union all select scan_id, 'dn' from n where type in {_list(graph.VIEWS['dfg'][0])} union all select scan_id, 'de' from e where type in {_list(graph.VIEWS['dfg'][1])} union all select scan_id, 'cn' from n where type in {_list(graph.VIEWS['cfg'][0])} union all select scan_id, 'ce' from e where type in {_list(graph.VIEWS['cfg'][1])} union all select scan_id, 't' from t)
      select scan_id, count(*) filter (w = 'n') as node_count, count(*) filter (w = 'e') as edge_count, count(*) filter (w = 'dn') as dfg_node_count, count(*) filter (w = 'de') as dfg_edge_count, count(*) filter (w = 'cn') as cfg_node_count, count(*) filter (w = 'ce') as cfg_edge_count, count(*) filter (w = 't') as tainted_path_count from u group by 1""",
    "j15_orphans": _G.rstrip() + f", kn as (select * from n where type in {_list(_FULL_N)}), ke as (select * from e where type in {_list(_FULL_E)}) select scan_id, pos, 'node' as kind from kn where not exists (select 1 from ke where ke.scan_id = kn.scan_id and ke.source = kn.id) and not exists (select 1 from ke where ke.scan_id = kn.scan_id and ke.target = kn.id) union all select scan_id, pos, 'edge' from ke where not exists (select 1 from kn where kn.scan_id = ke.scan_id and kn.id = ke.source) or not exists (select 1 from kn where kn.scan_id = ke.scan_id and kn.id = ke.target)",
    "j10_mentions": _G + "select m.scan_id, m.id, count(*) as n, min(s.id) as first_source from m join src s on s.scan_id = m.scan_id and contains('new ' || m.className || '(get)', s.name) where m.type = 'LOCAL_VARIABLE' and m.initializer is not null group by 1, 2",
    "j11_places": _G + "select scan_id, id, case when id % 3 = 0 then 'c' || (id % 5) when id % 2 = 0 then 'd' || (id % 5) end as file_name, case when id % 3 = 0 or id % 2 = 0 then id % 100 end as line_number from m",
    "j12_parameters": _G + "select distinct u.scan_id, u.id as a, p.id as b from m u join m f on f.scan_id = u.scan_id and f.name = u.name and f.type in ('METHOD', 'CONSTRUCTOR') join e on e.scan_id = f.scan_id and e.source = f.id and e.type = 'DECLARES' join m p on p.scan_id = e.scan_id and p.id = e.target and p.type = 'PARAMETER' where u.type = 'METHOD_CALL'",
    "x12_one_graph": _G + f"select pos, 'node' as kind, type from n where scan_id = 3 and type in {_list(graph.VIEWS['cfg'][0])} union all select pos, 'edge', type from e where scan_id = 3 and type in {_list(graph.VIEWS['cfg'][1])}",
    "x14_cleaning": _G + f"select scan_id, id, 'sanitizer' as kind from m where type = 'METHOD_CALL' and {_CLEANS.format('name')} union all select scan_id, id, 'validator' from m where type = 'METHOD_CALL' and {_CHECKS.format('name')}",
    "k7_documents": _G + "select scan_id, 'graph' as part, null::bigint as pos, '2026-01-01T00:00:00Z' as what, count(*) filter (k = 'n') as a, count(*) filter (k = 'e') as b from (select scan_id, 'n' as k from n union all select scan_id, 'e' from e) group by 1 union all select scan_id, 'node', pos, type, id, null from n union all select scan_id, 'edge', pos, type, source, target from e",
    "d14_rule_taint": _G.rstrip() + f""", blk as (select scan_id, id from m where type = 'METHOD_CALL' and name = 'escapeHtml'),
      lk as (select * from (select scan_id, source as a, target as b from e where type in {_FLOW_TYPES} or type = 'UNRELATED' union select scan_id, target, source from e where type = 'CONTAINS_ASSIGNMENT') l where not exists (select 1 from blk where blk.scan_id = l.scan_id and blk.id = l.b)),
      turn as (select scan_id, id from m where type in ('BINARY_EXPRESSION', 'ASSIGNMENT')),
      hop as (select scan_id, a, 'INPUT' as la, b, 'INPUT' as lb from lk union all select scan_id, a, 'CONCAT', b, 'CONCAT' from lk union all select scan_id, id, 'INPUT', id, 'CONCAT' from turn),
      st0 as (select scan_id, id as source, id from m where type = 'PARAMETER' union select lk.scan_id, m.id, lk.a from m join lk on lk.scan_id = m.scan_id and lk.b = m.id where m.type = 'PARAMETER' and m.id % 2 = 0),
      met(scan_id, source, id, label) as (select scan_id, source, id, 'INPUT' from st0 where not exists (select 1 from blk where blk.scan_id = st0.scan_id and blk.id = st0.id) union select w.scan_id, w.source, hop.b, hop.lb from met w join hop on hop.scan_id = w.scan_id and hop.a = w.id and hop.la = w.label)
      select distinct met.scan_id, source, met.id as sink, label from met join m s on s.scan_id = met.scan_id and s.id = met.id and s.type = 'METHOD_CALL' and (s.name = 'println' or (s.name in ('executeQuery', 'exec') and label = 'CONCAT')) where source <> met.id""",
    "x13_last_nodes": _G + "select scan_id, id, pos, type, name from m",
    "x13_names": _G + "select scan_id, name, count(distinct id) as n, min(id) as first_id from n where type in ('METHOD', 'CONSTRUCTOR') group by 1, 2",
    "proj09_call_flags": _G + f"select name, count(*) as n, count(*) filter (name in {_list(graphs.TAINT_SOURCES)}) as taint_source, count(*) filter (name in {_list(graphs.TAINT_SINKS)}) as taint_sink, count(*) filter (name in {_list(graphs.DANGEROUS)}) as dangerous, count(*) filter (name in {_list(graphs.MEMORY)}) as memory_operation, count(*) filter (name in {_list(graphs.DANGEROUS)}) as flagged from n where type = 'METHOD_CALL' group by 1",
    "proj10_sql_literals": "select coalesce(regexp_matches(code_snippet, 'SELECT|INSERT|UPDATE|DELETE'), false) as holds_sql, count(*) as n from findings group by 1",
    "s8_ingest": _G + "select scan_id::varchar as scan_id, n_nodes, ids, arguments, n_edges from (select scan_id, count(*) as n_nodes, sum(id)::bigint as ids, sum(arguments)::bigint as arguments from n group by 1) join (select scan_id, count(*) as n_edges from e group by 1) using (scan_id)",
    "proj04_graph_language": _G.rstrip() + f", s as (select scan_id, list(distinct type) as types, list(distinct name) as names, list(distinct dataType) as data_types, case scan_id % 3 when 0 then ['java.util.List'] when 1 then ['import os', 'stdio.h'] else [] end as imports from n group by 1), p as (select scan_id, {', '.join(f'{v} as s_{k}' for k, v in _GRAPH_SCORES.items())} from s), b as (select *, greatest({', '.join('s_' + k for k in _GRAPH_SCORES)}) as score from p) select scan_id, case when scan_id % 5 = 0 then 'cpp' when score = 0 then 'unknown' {' '.join(f'when score = s_{k} then {chr(39)}{k}{chr(39)}' for k in _GRAPH_SCORES)} end as language, score::bigint as score from b",
    "g12_adjacency": _G + "select * from adj",
    "g13_data_flow": _G + "select * from df",
    "g14_components": _G.rstrip() + ", walk(scan_id, id, other) as (select scan_id, a, a from df union select w.scan_id, w.id, df.b from walk w join df on df.scan_id = w.scan_id and df.a = w.other) select scan_id, id, min(other) as component from walk group by 1, 2",
    "g15_reached_sinks": _G.rstrip() + _REACH + " select r.scan_id, r.source, r.id as sink from reach r join snk on snk.scan_id = r.scan_id and snk.id = r.id where r.source <> r.id",
    "g16_shortest": _G.rstrip() + _WALK + " select w.scan_id, w.source, w.node as sink, w.steps from walk w join snk on snk.scan_id = w.scan_id and snk.id = w.node where w.source <> w.node",
    "g16_paths": _G.rstrip() + _WALK + " select w.scan_id, w.source, w.node as sink, w.steps, array_to_string(w.path, '>') as path from walk w join snk on snk.scan_id = w.scan_id and snk.id = w.node where w.source <> w.node",
    "g17_taint": _G.rstrip() + _REACH + _WALK + """, fed as (select distinct df.scan_id, df.a from df join m on m.scan_id = df.scan_id and m.id = df.b and m.type = 'STRING_LITERAL')
      select w.scan_id, w.source, w.node as sink, snk.name as sink_name, case when fed.a is not null and snk.arguments = 1 then 'LOW' else 'HIGH' end as severity, w.steps, array_to_string(w.path, '>') as path
      from walk w join reach r on r.scan_id = w.scan_id and r.source = w.source and r.id = w.node join snk on snk.scan_id = w.scan_id and snk.id = w.node left join fed on fed.scan_id = w.scan_id and fed.a = w.node where w.source <> w.node""",
    "g19_weighted_reach": _G.rstrip() + _SPREAD + " select scan_id, source, id, cleaned, checked, round(c, 7) as confidence from heat",
    "x15_weighted_taint": _G.rstrip() + _SPREAD + f""", per as (select scan_id, source, id, c, cleaned, checked from heat qualify row_number() over (partition by scan_id, source, id order by c desc, cleaned, checked) = 1),
      weak as (select scan_id, id, name from m where type = 'METHOD_CALL' and name in {_list(taint.SINK_WEIGHTS)}),
      hit as (select per.scan_id, per.source, per.id as sink, weak.name from per join weak on weak.scan_id = per.scan_id and weak.id = per.id),
      fl as (select scan_id, source as a, target as b from e where type in {_FLOW_TYPES} union select scan_id, target, source from e where type = 'CONTAINS_ASSIGNMENT'),
      way(scan_id, source, node, path, w, cleaned, checked) as (
        select scan_id, source, id, [id], c * {taint.STEP}::double, cleaned, checked from per where source = id and exists (select 1 from hit where hit.scan_id = per.scan_id and hit.source = per.source) and c * {taint.STEP} >= 0.6 - 1e-8
        union all select way.scan_id, way.source, fl.b, list_append(way.path, fl.b), way.w * per.c * {taint.STEP}, way.cleaned or per.cleaned, way.checked or per.checked from way join fl on fl.scan_id = way.scan_id and fl.a = way.node join per on per.scan_id = way.scan_id and per.source = way.source and per.id = fl.b
          where not list_contains(way.path, fl.b) and len(way.path) < {taint.MAX_NODES} and way.w * per.c * {taint.STEP} >= 0.6 - 1e-8),
      done as (select way.*, hit.name as sink_name, row_number() over (partition by way.scan_id, way.source, way.node order by round(w, 9) desc, way.cleaned, way.path) as place from way join hit on hit.scan_id = way.scan_id and hit.source = way.source and hit.sink = way.node where len(way.path) > 1)
      select scan_id, source, node as sink, sink_name, round(w, 7) as confidence, array_to_string(path, '>') as path, cleaned, checked, place from done where place <= {taint.PATHS_PER_PAIR} and round(w, 9) >= 0.6
        and not (cleaned and sink_name in {_list(k for k, v in taint.SINK_CLASSES.items() if v in taint.CLEANED_SINK_CLASSES)}) and not (checked and sink_name in {_list(taint.UNVALIDATED_SINKS)})""",
    "f13_names": _G + f"select name, count(*) as n, {_CLEANS.format('name')} as sanitizes, {_CHECKS.format('name')} as validates from n group by 1",
    "f14_weights": _G + f"""select * from (select scan_id, id, case type when 'METHOD_CALL' then {_WEIGHT(taint.SOURCE_WEIGHTS)} when 'PARAMETER' then case when contains(dataType, 'String') then 0.98 else 0.5 end when 'FIELD' then case when contains(lower(dataType), 'string') or regexp_matches(lower(name), 'input|request|param') then 0.95 end end::double as confidence, 'source' as kind from m
      union all select scan_id, id, case type when 'METHOD_CALL' then {_WEIGHT(taint.SINK_WEIGHTS)} end, 'sink' from m) where confidence is not null""",
    "g18_flow": _G + f"select scan_id, source as a, target as b from e where type in {_FLOW_TYPES} union select scan_id, target, source from e where type = 'CONTAINS_ASSIGNMENT'",
    "g22_line_cfg": _SIG + "select file_id, node, type, label, line_no from cfg",
    "g22_line_cfg_edges": _SIG + "select * from cfge",
    "proj18_line_types": _SIG + "select file_id, type, count(*) as n from cfg group by 1, 2",
    "e3_definitions": _SIG + "select file_id, line_no, ord, name, type from defs",
    "e4_uses": _SIG + "select file_id, name, count(*) as n, min(line_no) as first_line from uses group by 1, 2",
    "g23_line_dfg": _SIG + "select * from dfge",
    "a15_variables": _SIG + "select file_id, name, arg_min_null(case when kind = 'definition' then type end, node) as type, count(*) filter (kind = 'definition') as definitions, count(*) filter (kind = 'use') as uses from dfg group by 1, 2",
    "j8_declarations": _G + "select scan_id, pos, name, last_value(case when type in ('LOCAL_VARIABLE', 'PARAMETER', 'FIELD') then pos end ignore nulls) over (partition by scan_id, name order by pos rows between unbounded preceding and current row) as declared_at from n",
    "j13_sensitive_uses": _SIG + "select * from sens",
    "j14_unreachable": _SIG.rstrip() + ", ends as (select file_id, node from sig where contains(code, 'return') or contains(code, 'throw')) select file_id, node, line_no from sig s where exists (select 1 from ends where ends.file_id = s.file_id and ends.node = s.node - 1)",
    "s17_pseudo_ast": _AST + "select file_id, line_no, ord, type, name, indent from ast",
    "g24_ast_flow": _AST.rstrip() + """, r as (select *, row_number() over w as node, lead(indent) over w as ni, lead(type) over w as nt from ast window w as (partition by file_id order by line_no, ord)),
      c as (select *, last_value(case when type = 'ClassDeclaration' then node end ignore nulls) over (partition by file_id order by line_no, ord rows between unbounded preceding and current row) as cn from r),
      l as (select file_id, node as source, node + 1 as target, case when language <> 'python' then 'sequential' when ni > indent then 'enter_block' when ni < indent then 'exit_block' else 'sequential' end as type from c where language <> 'java' and nt is not null
        union all select file_id, cn, node, 'member' from c where language = 'java' and type <> 'ClassDeclaration' and cn is not null
        union all select * from (select file_id, node, lead(node) over (partition by file_id order by node) as nx, 'sequential' from c where type = 'ClassDeclaration') where nx is not null)
      select file_id, type, source, target from l""",
    "f10_semantics": _AST + "select file_id, line_no, r.rule_id, r.severity, r.confidence from checks",
    "x7_composition": _AST.rstrip() + f""", {RULES_SQL}, pat as (select file_id, rule_id, unnest(ms) as m from (select l.file_id, r.rule_id, regexp_extract_all({TRIM_SQL.format('line')}, pattern) as ms from lines l join usable r on l.language = r.language where regexp_matches({TRIM_SQL.format('line')}, pattern))),
      met as (select file_id, count(*) filter (regexp_matches(line, '\\S')) as code, 1 + sum({' + '.join(f"contains(line, '{w}')::int" for w in report.COMPLEXITY)}) as complexity from lines group by 1)
      select rule_id, count(*) as n, count(distinct file_id) as files from (select file_id, r.rule_id from checks union all select file_id, 'sensitive-data-exposure' from sens union all select file_id, rule_id from pat) group by 1
      union all select '(code lines)', sum(code)::bigint, count(*) from met union all select '(complexity)', sum(complexity)::bigint, count(*) from met""",
    "k8_dot": _G.rstrip() + f""", ke as (select * from e where exists (select 1 from n where n.scan_id = e.scan_id and n.id = e.source) and exists (select 1 from n where n.scan_id = e.scan_id and n.id = e.target)),
      t as (select scan_id, 0 as part, pos as k, '  "' || id || '" [label="' || name || '"];' as t from n union all select scan_id, 1, pos, '  "' || source || '" -> "' || target || '";' from ke)
      select scan_id, md5('digraph G {{' || chr(10) || string_agg(t, chr(10) order by part, k, t) || chr(10) || '}}') as dot from t group by 1""".replace("{{", "{").replace("}}", "}"),
}
