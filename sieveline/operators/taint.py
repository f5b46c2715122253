"""Taint over code graphs: reachability with severities, and weighted propagation (operators G15, G17 to G21; filters 13, 14;
joins 10 to 12; aggregations 17, 18; order 6; compositions X14 to X16), and by a rule's own seeds and labels (D14 to D19).
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.graph import adjacency, components, data_flow, shortest_paths, spread, view
from sieveline.session import cut, discard
from sieveline.sources.graphs import last_by_id

# Names that bring input in and names that must not receive it, plain and weighted.
SOURCES = ["getParameter", "readLine", "getInputStream", "nextLine", "read"]
SINKS = ["executeQuery", "println", "print", "info", "debug", "warn", "error", "log", "severe", "warning"]
SOURCE_WEIGHTS = {"getParameter": 0.98, "getHeader": 0.95, "getCookieValue": 0.95, "readLine": 0.90, "getInputStream": 0.85, "nextLine": 0.90, "read": 0.80, "getProperty": 0.65, "getenv": 0.65, "getAttribute": 0.90, "getPathInfo": 0.95, "getQueryString": 0.98, "getBytes": 0.85}
SINK_WEIGHTS = {"executeQuery": 1.0, "executeUpdate": 1.0, "exec": 1.0, "prepareStatement": 0.95, "createQuery": 0.95, "println": 0.70, "print": 0.70, "info": 0.75, "debug": 0.65, "write": 0.90, "sendRedirect": 0.95, "forward": 0.90, "include": 0.95, "eval": 1.0, "readObject": 0.95, "openConnection": 0.90, "readValue": 0.85, "digest": 0.80}
SANITIZER = r"(?i)^(escape|encode|sanitize|clean|filter|purify|strip|normalize|remove)"
VALIDATOR = r"(?i)isvalid|validate|check|verify|assert|ensure|matches|is[A-Z][a-zA-Z]*$"
SANITIZER_NAMES = ["escapeHtml", "escapeXml", "escapeSql", "encodeForHTML", "encodeForSQL", "sanitize", "clean", "filter", "purify", "strip", "removeSpecialChars", "normalizeInput", "encodeURIComponent", "htmlspecialchars", "addSlashes", "stripTags", "replaceAll"]
VALIDATOR_NAMES = ["isValid", "validate", "check", "verify", "assertValid", "ensure", "matchesPattern", "isNumeric", "isAlpha", "isEmail", "isAlphanumeric", "checkLength", "isEmpty", "isBlank", "restrict"]
SINK_CLASSES = {"executeQuery": "SQL_INJECTION", "executeUpdate": "SQL_INJECTION", "exec": "COMMAND_INJECTION", "prepareStatement": "SQL_INJECTION", "createQuery": "SQL_INJECTION", "println": "LOG_INJECTION", "print": "LOG_INJECTION", "info": "LOG_INJECTION", "debug": "LOG_INJECTION", "write": "FILE_WRITE", "sendRedirect": "OPEN_REDIRECT", "forward": "OPEN_REDIRECT", "include": "PATH_TRAVERSAL", "eval": "CODE_INJECTION", "readObject": "DESERIALIZATION", "openConnection": "SSRF", "readValue": "VULNERABLE_COMPONENT", "digest": "CRYPTO_WEAKNESS"}
UNVALIDATED_SINKS = ["println", "print", "info", "debug", "digest"]
CLEANED_SINK_CLASSES = ["SQL_INJECTION", "COMMAND_INJECTION"]
MODIFIERS = {"toString": 0.95, "valueOf": 0.90, "trim": 0.95, "substring": 0.85, "toLowerCase": 0.95, "toUpperCase": 0.95, "replaceAll": 0.80, "concat": 0.90, "format": 0.85}
SANITIZED, VALIDATED, CONTROLLED, STEP = 0.05, 0.1, 0.95, 0.99
PARAMETER_SURE, PARAMETER_OTHER, FIELD_SURE, CALLEE = 0.98, 0.5, 0.95, 0.95
CONTROL_TYPES = ["CONTAINS_CONTROL_FLOW", "SEQUENTIAL_FLOW", "THEN_BRANCH", "ELSE_BRANCH", "LOOP_BODY", "CATCH_BRANCH"]
MAX_NODES, PATHS_PER_PAIR = 25, 10


def _weights(table: dict, key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def sources(nodes: DataFrame) -> DataFrame:
    """Parameters, and calls of names that bring input in."""
    return last_by_id(nodes).filter((F.col("type") == "PARAMETER") | ((F.col("type") == "METHOD_CALL") & F.col("name").isin(SOURCES)))


def sinks(nodes: DataFrame) -> DataFrame:
    """Calls with arguments of names that must not receive input."""
    return last_by_id(nodes).filter((F.col("type") == "METHOD_CALL") & F.col("name").isin(SINKS) & (F.col("arguments") > 0))


def reached_sinks(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(scan_id, source, sink) of sinks in a source's part of the data flow, itself left out.

    Sources and sinks meet in their components, so members that are neither never stand beside a source.
    """
    part = cut(components(data_flow(nodes, edges) if links is None else links), "parts")
    a = sources(nodes).select("scan_id", "id").join(part, ["scan_id", "id"]).withColumnRenamed("id", "source")
    z = sinks(nodes).select("scan_id", "id").join(part, ["scan_id", "id"]).withColumnRenamed("id", "sink")
    return a.join(z, ["scan_id", "component"]).filter("source <> sink").select("scan_id", "source", "sink")


def taint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tainted sinks with the shortest path from each source and a severity.

    Their severity is HIGH wherever a literal doesn't flow into a call of one argument, which their graphs never show; the
    rule is kept, so graphs that do show it get LOW.
    """
    links = cut(data_flow(nodes, edges), "data-flow")
    both = cut(links.unionByName(adjacency(edges)).distinct(), "links-both")
    pairs = cut(reached_sinks(nodes, edges, links), "pairs")
    goals = pairs.select("scan_id", F.col("sink").alias("id")).distinct()
    starts = pairs.select("scan_id", F.col("source").alias("id")).distinct()
    found = shortest_paths(both, starts, goals).join(pairs, ["scan_id", "source", "sink"], "left_semi")
    last = last_by_id(nodes)
    literals = last.filter(F.col("type") == "STRING_LITERAL").select("scan_id", F.col("id").alias("b"))
    static = links.join(literals, ["scan_id", "b"], "left_semi").select("scan_id", F.col("a").alias("sink")).distinct().withColumn("fed", F.lit(True))
    about = last.select("scan_id", F.col("id").alias("sink"), F.col("name").alias("sink_name"), "arguments")
    rows = found.join(about, ["scan_id", "sink"]).join(static, ["scan_id", "sink"], "left")
    return rows.withColumn("severity", F.when(F.coalesce("fed", F.lit(False)) & (F.col("arguments") == 1), "LOW").otherwise("HIGH")).select("scan_id", "source", "sink", "sink_name", "severity", "path")


def weighted_sources(nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(scan_id, id, confidence) of sources (filter 14): calls by name, parameters and fields by type and name."""
    text = F.coalesce("dataType", F.lit(""))
    asked = F.coalesce("scope", F.lit("")).contains("ServletRequest") | text.contains("String") | text.contains("InputStream")
    name, kind = F.lower(F.coalesce("name", F.lit(""))), F.lower(text)
    field = name.contains("input") | name.contains("request") | name.contains("param") | kind.contains("string") | kind.contains("inputstream")
    score = (
        F.when(F.col("type") == "METHOD_CALL", _weights(SOURCE_WEIGHTS, F.col("name")))
        .when(F.col("type") == "PARAMETER", F.when(asked, PARAMETER_SURE).otherwise(PARAMETER_OTHER))
        .when((F.col("type") == "FIELD") & field, F.lit(FIELD_SURE))
    )
    return last_by_id(nodes).select("scan_id", "id", score.alias("confidence")).filter(F.col("confidence") >= threshold)


def weighted_sinks(nodes: DataFrame) -> DataFrame:
    """(scan_id, id, weight) of sinks (filter 14)."""
    return last_by_id(nodes).filter(F.col("type") == "METHOD_CALL").select("scan_id", "id", _weights(SINK_WEIGHTS, F.col("name")).alias("weight")).filter("weight is not null")


def sanitizes(name: Column) -> Column:
    """Does a name say that a call cleans its input (filter 13)? Listed names are looked up in lower case, so those with capitals never hit."""
    return F.coalesce(F.lower(name).isin(SANITIZER_NAMES) | name.rlike(SANITIZER), F.lit(False))


def validates(name: Column) -> Column:
    """Does a name say that a call checks its input (filter 13)? The test is unanchored, so 'list' and 'exists' count."""
    return F.coalesce(F.lower(name).isin(VALIDATOR_NAMES) | name.rlike(VALIDATOR), F.lit(False))


def cleaning_nodes(nodes: DataFrame) -> DataFrame:
    """(scan_id, id, kind) of the calls that clean or check."""
    calls = last_by_id(nodes).filter(F.col("type") == "METHOD_CALL")
    kinds = F.array_compact(F.array(F.when(sanitizes(F.col("name")), F.lit("sanitizer")), F.when(validates(F.col("name")), F.lit("validator"))))
    return calls.select("scan_id", "id", F.explode(kinds).alias("kind"))


def flow_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, a, b) of the directed flow (G18): data flow, declarations and accesses ahead, assignments back, control flow."""
    ahead = edges.filter(F.col("type").isin("DATA_FLOW", "DECLARES", "ACCESSES", *CONTROL_TYPES)).select("scan_id", F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.filter(F.col("type") == "CONTAINS_ASSIGNMENT").select("scan_id", F.col("target").alias("a"), F.col("source").alias("b"))
    return ahead.unionByName(back).distinct()


def step_factors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, id, factor, sanitizer, validator): what entering a node does to a confidence."""
    control = edges.filter(F.col("type").isin(CONTROL_TYPES)).select("scan_id", F.col("source").alias("id")).distinct().withColumn("control", F.lit(True))
    rows = last_by_id(nodes).join(control, ["scan_id", "id"], "left")
    return rows.select("scan_id", "id", (F.coalesce(_weights(MODIFIERS, F.col("name")), F.lit(1.0)) * F.when(F.coalesce("control", F.lit(False)), F.lit(CONTROLLED)).otherwise(F.lit(1.0))).alias("factor"), sanitizes(F.col("name")).alias("cleans"), validates(F.col("name")).alias("checks"))


def callee_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, a, b) from calls to the parameters their definitions declare (join 12); theirs taints every parameter."""
    last = last_by_id(nodes)
    used = last.filter(F.col("type") == "METHOD_CALL").select("scan_id", F.col("id").alias("a"), "name")
    made = last.filter(F.col("type").isin("METHOD", "CONSTRUCTOR")).select("scan_id", "name", F.col("id").alias("source"))
    params = last.filter(F.col("type") == "PARAMETER").select("scan_id", F.col("id").alias("target"))
    declared = edges.filter(F.col("type") == "DECLARES").select("scan_id", "source", "target").join(params, ["scan_id", "target"], "left_semi")
    return used.join(made, ["scan_id", "name"]).join(declared, ["scan_id", "source"]).select("scan_id", "a", F.col("target").alias("b")).distinct()


def propagate(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(scan_id, source, id, confidence, cleaned, checked): the highest confidence that reaches each node.

    States are (node, cleaned, checked), as a cleaned value stays cleaned. Factors are at most 1, so the largest product
    is a fixed point; a round joins what rose in the last one with the links, and ends when nothing rises.
    """
    factors = cut(step_factors(nodes, edges), "factors")
    flow = flow_links(nodes, edges).join(factors.withColumnRenamed("id", "b"), ["scan_id", "b"])
    call = callee_links(nodes, edges).select("scan_id", "b", "a", F.lit(CALLEE).alias("factor"), F.lit(None).cast("boolean").alias("cleans"), F.lit(None).cast("boolean").alias("checks"))
    links = cut(flow.select("scan_id", "b", "a", "factor", "cleans", "checks").unionByName(call), "weighted-links")
    keys = ["scan_id", "source", "id", "cleaned", "checked"]
    best = cut(weighted_sources(nodes, threshold).select("scan_id", F.col("id").alias("source"), "id", F.lit(False).alias("cleaned"), F.lit(False).alias("checked"), "confidence"), "taint")
    risen = last = best
    while True:
        hop = risen.join(links.withColumnRenamed("a", "id"), ["scan_id", "id"])
        cleaned, checked = F.col("cleaned") | F.coalesce("cleans", F.lit(False)), F.col("checked") | F.coalesce("checks", F.lit(False))
        base = F.when(cleaned, F.lit(SANITIZED)).otherwise(F.lit(1.0))
        lifted = F.when(checked, F.least(F.lit(1.0), base + VALIDATED)).otherwise(base)
        times = F.when(F.col("cleans").isNull(), F.col("factor")).otherwise(lifted * F.col("factor"))
        new = hop.select("scan_id", "source", F.col("b").alias("id"), cleaned.alias("cleaned"), checked.alias("checked"), (F.col("confidence") * times).alias("c")).filter(F.col("c") >= threshold)
        top = new.groupBy(*keys).agg(F.max("c").alias("c"))
        merged = cut(best.join(top, keys, "full_outer").select(*keys, F.greatest("confidence", "c").alias("confidence"), (F.coalesce(F.col("c") > F.col("confidence") + 1e-12, F.col("confidence").isNull())).alias("rose")), "taint")
        discard(last)
        best, risen, last = merged.drop("rose"), merged.filter("rose").drop("rose"), merged
        if risen.isEmpty():
            break
    return best


def simple_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, goals: DataFrame, longest: int = MAX_NODES, within: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """(scan_id, source, sink, path) of all simple paths of at most `longest` nodes over the directed flow.

    Paths go on through goals, which are ends for some pairs and steps for others. within: (scan_id, source, id, c), the nodes
    that a source's paths may use and their confidences. Those are at most 1, so what is below the threshold stays there.
    """
    links = cut(flow_links(nodes, edges), "flow")
    ends = goals.select("scan_id", F.col("id").alias("at")).distinct()
    inside = None if within is None else within.select("scan_id", "source", F.col("id").alias("at"), "c")

    def allowed(paths: DataFrame) -> DataFrame:
        if inside is None:
            return paths
        weighed = paths.join(inside, ["scan_id", "source", "at"]).withColumn("w", F.col("w") * F.col("c") * STEP).drop("c")
        return weighed.filter(F.col("w") >= threshold - 1e-8)  # confidences are rounded to 9 places

    front = allowed(starts.select("scan_id", F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(1.0).alias("w")).distinct())
    found = None
    for _ in range(longest - 1):
        grown = front.join(links, (front.scan_id == links.scan_id) & (front["at"] == links.a) & ~F.array_contains("path", links.b))
        front = cut(allowed(grown.select(front.scan_id, "source", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"), "w")), "paths")
        hits = front.join(ends, ["scan_id", "at"], "left_semi").select("scan_id", "source", F.col("at").alias("sink"), "path")
        found = hits if found is None else found.unionByName(hits)
        if front.isEmpty():
            break
    return found


def path_confidence(weights: Column) -> Column:
    """The product of the nodes' confidences, less one percent for every node (aggregation 18)."""
    return F.round(F.aggregate(weights, F.lit(1.0), lambda a, x: a * x) * F.pow(F.lit(STEP), F.size(weights)), 9)


def best_paths(paths: DataFrame, per_pair: int = PATHS_PER_PAIR) -> DataFrame:
    """The most confident paths of each source and sink, uncleaned ones first (order 6)."""
    order = W.partitionBy("scan_id", "source", "sink").orderBy(F.desc("confidence"), "cleaned", "path")
    return paths.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_pair)


def valid_paths(paths: DataFrame, threshold: float) -> DataFrame:
    """Paths that count (G21), by the name of their sink: confident enough, of 2 to MAX_NODES nodes, to a listed sink; not
    cleaned before a statement or a command; not checked before a sink that needs no check."""
    sink = _weights(SINK_CLASSES, F.col("sink_name"))
    cleaned = F.col("cleaned") & sink.isin(CLEANED_SINK_CLASSES)
    checked = F.col("checked") & F.col("sink_name").isin(UNVALIDATED_SINKS)
    return paths.filter((F.size("path") >= 2) & (F.size("path") <= MAX_NODES) & (F.col("source") != F.col("sink")) & sink.isNotNull() & ~cleaned & ~checked & (F.col("confidence") >= threshold))


def weighted_taint(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5, longest: int = MAX_NODES) -> DataFrame:
    """Propagate, enumerate, weigh and filter (X15): (scan_id, source, sink, sink_name, path, confidence, cleaned, checked, place).

    A node counts with the most confident state that reaches it; a path is cleaned or checked if one of its nodes is.
    """
    reached = cut(propagate(nodes, edges, threshold), "reached")
    goals = weighted_sinks(nodes)
    hit = reached.join(goals.select("scan_id", "id"), ["scan_id", "id"], "left_semi").select("scan_id", "source", F.col("id").alias("sink")).distinct()
    best = F.max(F.struct("confidence", ~F.col("cleaned"), ~F.col("checked"))).alias("s")
    per = cut(reached.groupBy("scan_id", "source", "id").agg(best).select("scan_id", "source", "id", F.col("s.confidence").alias("c"), (~F.col("s.col2")).alias("cleaned"), (~F.col("s.col3")).alias("checked")), "per-node")
    found = simple_paths(nodes, edges, hit.select("scan_id", F.col("source").alias("id")), hit.select("scan_id", F.col("sink").alias("id")), longest, per, threshold)
    found = found.join(hit, ["scan_id", "source", "sink"], "left_semi")
    steps = found.select("*", F.posexplode("path").alias("k", "id")).join(per, ["scan_id", "source", "id"])
    weighed = steps.groupBy("scan_id", "source", "sink", "path").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("w"), F.max("cleaned").alias("cleaned"), F.max("checked").alias("checked"))
    whole = weighed.filter(F.size("w") == F.size("path"))  # a path over a node that taint doesn't reach is none
    named = whole.join(last_by_id(nodes).select("scan_id", F.col("id").alias("sink"), F.col("name").alias("sink_name")), ["scan_id", "sink"])
    scored = named.withColumn("confidence", path_confidence(F.col("w.c"))).drop("w")
    # The best paths of a pair are chosen first and judged then, as the limit belongs to the search.
    return valid_paths(best_paths(scored), threshold)


def analysis_metadata(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Counts of each analysed graph: its nodes and edges, those of its two views, and its tainted paths (aggregation 17)."""
    views = [(nodes, "node_count"), (edges, "edge_count")]
    for name, short in (("dfg", "dfg"), ("cfg", "cfg")):
        n, e = view(nodes, edges, name)
        views += [(n, f"{short}_node_count"), (e, f"{short}_edge_count")]
    parts = [df.select("scan_id", F.lit(name).alias("what")) for df, name in [*views, (paths, "tainted_path_count")]]
    names = [name for _, name in views] + ["tainted_path_count"]
    return reduce(DataFrame.unionByName, parts).groupBy("scan_id").agg(*(F.count_if(F.col("what") == n).alias(n) for n in names))


def labelled_taint(links: DataFrame, seeds: DataFrame, targets: DataFrame, blocked: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(scan_id, source, sink, label): taint by a rule's own sources, sinks, sanitizers, propagators and labels.

    seeds: (scan_id, id, label, requires, by_side_effect). A seed without `requires` starts its label; one with it gives its
    label to what arrives there under the required one. by_side_effect: what flows into the seed gets the label too.
    targets: (scan_id, id, requires), a null one takes any label. blocked: (scan_id, id) that taint can't enter (D16).
    extra: (scan_id, a, b), a propagator's from and to (D17). It is reachability over (node, label) pairs.
    """
    every = links.select("scan_id", "a", "b")
    if extra is not None:
        every = every.unionByName(extra.select("scan_id", "a", "b")).distinct()
    if blocked is not None:
        every = every.join(blocked.select("scan_id", F.col("id").alias("b")).distinct(), ["scan_id", "b"], "left_anti").select("scan_id", "a", "b")
    every = cut(every, "taint-links")
    labels = cut(seeds.select("label").distinct(), "labels")  # a rule's own few words
    state = lambda node, label: F.struct(F.col(node).alias("id"), label.alias("label"))
    flows = every.crossJoin(F.broadcast(labels)).select("scan_id", state("a", F.col("label")).alias("a"), state("b", F.col("label")).alias("b"))
    turns = seeds.filter("requires is not null").select("scan_id", state("id", F.col("requires")).alias("a"), state("id", F.col("label")).alias("b"))
    begun = seeds.filter("requires is null").select("scan_id", F.col("id").alias("source"), "id", "label", "by_side_effect")
    before = begun.filter("by_side_effect").join(every.withColumnRenamed("b", "id"), ["scan_id", "id"]).select("scan_id", "source", F.col("a").alias("id"), "label")
    starts = begun.select("scan_id", "source", "id", "label").unionByName(before)
    if blocked is not None:
        starts = starts.join(blocked.select("scan_id", "id").distinct(), ["scan_id", "id"], "left_anti")
    met = spread(cut(flows.unionByName(turns), "label-links"), starts.select("scan_id", "source", state("id", F.col("label")).alias("at")))
    wanted = targets.select("scan_id", F.col("id").alias("sink"), "requires")
    rows = met.select("scan_id", "source", F.col("at.id").alias("sink"), F.col("at.label").alias("label")).join(wanted, ["scan_id", "sink"])
    return rows.filter("source <> sink and (requires is null or requires = label)").select("scan_id", "source", "sink", "label").distinct()


def mentions(nodes: DataFrame) -> DataFrame:
    """(scan_id, id, source): variables whose initializer holds the name of a source (join 10); a source without a name counts for all.

    Names are few beside variables: distinct ones travel if they are few, and all sources of a name come by equality.
    """
    named = sources(nodes).select("scan_id", F.col("id").alias("source"), F.coalesce("name", F.lit("")).alias("name"))
    held = last_by_id(nodes).filter((F.col("type") == "LOCAL_VARIABLE") & F.col("initializer").isNotNull()).select("scan_id", "id", "initializer")
    names = named.select("scan_id", "name").distinct()
    hits = held.join(names, "scan_id").filter(F.contains("initializer", F.col("name")))
    return hits.select("scan_id", "id", "name").join(named, ["scan_id", "name"]).select("scan_id", "id", "source")


def with_places(nodes: DataFrame, dfg: DataFrame, cfg: DataFrame) -> DataFrame:
    """Nodes with file and line from the control-flow copy, else the data-flow copy (join 11)."""
    a, b = dfg.select("scan_id", "id", F.col("fileName").alias("f1"), F.col("lineNumber").alias("l1")), cfg.select("scan_id", "id", F.col("fileName").alias("f2"), F.col("lineNumber").alias("l2"))
    return nodes.join(a, ["scan_id", "id"], "left").join(b, ["scan_id", "id"], "left").withColumn("fileName", F.coalesce("f2", "f1")).withColumn("lineNumber", F.coalesce("l2", "l1")).drop("f1", "l1", "f2", "l2")
