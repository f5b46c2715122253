"""Code graphs: views, inferred edges, statistics, components and paths (operators G1 to G16; joins 3 to 7 and 15; aggregations 8, 9).

All graphs of a table are worked on together: every key starts with scan_id, so the number of jobs doesn't depend on the
number of graphs. Identifiers needn't be unique and edges may dangle; look-ups use the last node of an identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.session import cut, discard, hot_split_join, remove, scratch_path
from sieveline.sources.graphs import last_by_id

# The node and edge types of each view.
VIEWS = {
    "cfg": (["IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "TRY_CATCH_BLOCK"], ["CONTAINS_CONTROL_FLOW", "CONTAINS_EXCEPTION_HANDLING"]),
    "cfg_wide": (["METHOD", "CONSTRUCTOR", "IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "FOR_EACH_LOOP", "TRY_CATCH_BLOCK", "RETURN_STATEMENT"], ["CONTAINS_CONTROL_FLOW", "CONTAINS_EXCEPTION", "CONTAINS"]),
    "cfg_full": (
        ["METHOD", "CONSTRUCTOR", "METHOD_CALL", "OBJECT_CREATION", "ASSIGNMENT", "BINARY_EXPRESSION", "RETURN_STATEMENT", "IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "FOR_EACH_LOOP", "TRY_CATCH_BLOCK", "TYPE_CATCH_CALL", "LOCAL_VARIABLE", "PARAMETER", "FIELD_ACCESS"],
        ["CONTAINS_CONTROL_FLOW", "CONTAINS_EXCEPTION_HANDLING", "INVOKES", "CONTAINS"],
    ),
    "dfg": (["LOCAL_VARIABLE", "PARAMETER", "FIELD", "ASSIGNMENT", "METHOD_CALL", "FIELD_ACCESS"], ["DATA_FLOW", "DECLARES", "INVOKES", "ACCESSES"]),
    "ast": (["FILE", "CLASS", "METHOD", "METHOD_CALL", "PARAMETER", "LOCAL_VARIABLE", "BINARY_EXPRESSION", "STRING_LITERAL", "FIELD_ACCESS"], ["CONTAINS", "DECLARES", "INVOKES", "CONTAINS_EXPRESSION", "CONTAINS_LITERAL", "ACCESSES"]),
}
CALLS = ["METHOD_CALL", "OBJECT_CREATION", "TYPE_ARRAY_CALL", "TYPE_CATCH_CALL"]
CONTROL = ["IF_STATEMENT", "FOR_LOOP", "WHILE_LOOP", "FOR_EACH_LOOP", "TRY_CATCH_BLOCK"]
LOOPS = ["FOR_LOOP", "WHILE_LOOP", "FOR_EACH_LOOP"]
DEFINITIONS = ["METHOD", "CONSTRUCTOR"]
FORWARD = ["CONTAINS", "INVOKES", "CONTAINS_CONTROL_FLOW", "CONTAINS_EXPRESSION", "DATA_FLOW"]
BACKWARD = ["CONTAINS_EXPRESSION", "INVOKES", "DATA_FLOW"]


def view(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view by types alone (G1, G2, G4, G5, filter 7): pure filters, pushed to the scans."""
    node_types, edge_types = VIEWS[name]
    return nodes.filter(F.col("type").isin(node_types)), edges.filter(F.col("type").isin(edge_types))


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (join 3): two semi-joins."""
    ids = nodes.select("scan_id", "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), ["scan_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["scan_id", "target"], "left_semi")


def full_cfg(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The control-flow view with its inferred edges."""
    kept, linked = view(nodes, edges, "cfg_full")
    inside = closed(kept, linked).select("scan_id", "source", "target", "type")
    extra = [sequential(kept, inside), branches(kept, edges), calls(kept), catches(kept, edges)]
    for e in extra:
        inside = inside.unionByName(e)
    return kept, inside


def sequential(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a method holds, linked in order of identifiers."""
    types = last_by_id(nodes).select("scan_id", "id", "type")
    held = edges.filter(F.col("type").isin("CONTAINS", "CONTAINS_CONTROL_FLOW")).select("scan_id", "source", "target").distinct()
    methods = types.filter(F.col("type").isin(DEFINITIONS)).select("scan_id", F.col("id").alias("source"))
    others = types.filter(~F.col("type").isin(DEFINITIONS)).select("scan_id", F.col("id").alias("target"))
    members = held.join(methods, ["scan_id", "source"], "left_semi").join(others, ["scan_id", "target"], "left_semi")
    order = W.partitionBy("scan_id", "source").orderBy("target")
    return members.select("scan_id", F.col("target").alias("source"), F.lead("target").over(order).alias("target"), F.lit("SEQUENTIAL_FLOW").alias("type")).filter("target is not null")


def branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """THEN_BRANCH or ELSE_BRANCH of conditions and LOOP_BODY of loops (G8, G9, join 6)."""
    heads = nodes.filter(F.col("type").isin("IF_STATEMENT", *LOOPS)).select("scan_id", F.col("id").alias("source"), F.col("type").alias("head"), F.coalesce("hasElse", F.lit(False)).alias("alt"))
    kind = F.when(F.col("head") != "IF_STATEMENT", "LOOP_BODY").when(F.col("alt"), "ELSE_BRANCH").otherwise("THEN_BRANCH")
    return edges.filter(F.col("type") == "CONTAINS_CONTROL_FLOW").select("scan_id", "source", "target").join(heads, ["scan_id", "source"]).select("scan_id", "source", "target", kind.alias("type"))


def calls(nodes: DataFrame) -> DataFrame:
    """CALLS from calls and creations to the definitions of that name (G10, join 4)."""
    used = nodes.filter(F.col("type").isin("METHOD_CALL", "OBJECT_CREATION")).select("scan_id", F.col("id").alias("source"), F.when(F.col("type") == "METHOD_CALL", F.col("name")).otherwise(F.col("className")).alias("name"))
    made = nodes.filter(F.col("type").isin(DEFINITIONS)).select("scan_id", F.col("id").alias("target"), "name").distinct()
    return used.join(made, ["scan_id", "name"]).select("scan_id", "source", "target", F.lit("CALLS").alias("type"))


def catches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CATCH_BRANCH from try blocks to what they declare as catch clauses (G11, join 7)."""
    tries = nodes.filter(F.col("type") == "TRY_CATCH_BLOCK").select("scan_id", F.col("id").alias("source"))
    clauses = last_by_id(nodes).filter(F.col("type") == "TYPE_CATCH_CALL").select("scan_id", F.col("id").alias("target"))
    declared = edges.filter(F.col("type") == "DECLARES").select("scan_id", "source", "target")
    return declared.join(clauses, ["scan_id", "target"], "left_semi").join(tries, ["scan_id", "source"]).select("scan_id", "source", "target", F.lit("CATCH_BRANCH").alias("type"))


def statistics(nodes: DataFrame, edges: DataFrame, initializers: bool = True) -> DataFrame:
    """Counts per graph (aggregations 8 and 9). initializers: declarations with one count as assignments."""
    declared = F.col("type").isin("LOCAL_VARIABLE", "FIELD") & F.col("initializer").isNotNull()
    assigned = F.col("type") == "ASSIGNMENT"
    per = nodes.groupBy("scan_id").agg(F.count("*").alias("total_nodes"), F.count_if(F.col("type").isin(CALLS)).alias("method_calls"), F.count_if(assigned | declared if initializers else assigned).alias("assignments"), F.count_if(F.col("type") == "STRING_LITERAL").alias("string_literals"), F.count_if(F.col("type").isin(CONTROL)).alias("control_flow_nodes"))
    links = edges.groupBy("scan_id").agg(F.count("*").alias("total_edges"))
    return per.join(links, "scan_id", "full_outer").fillna(0)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches (join 15)."""
    ends = edges.select("scan_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, ["scan_id", "id"], "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node (join 15)."""
    ids = nodes.select("scan_id", "id").distinct()
    left, right = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
    half = edges.join(left, ["scan_id", "source"], "left_semi").join(right, ["scan_id", "target"], "left_anti")
    return edges.join(left, ["scan_id", "source"], "left_anti").unionByName(half)


def adjacency(edges: DataFrame) -> DataFrame:
    """(scan_id, a, b): five edge types forward, three of them backward too."""
    ahead = edges.filter(F.col("type").isin(FORWARD)).select("scan_id", F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.filter(F.col("type").isin(BACKWARD)).select("scan_id", F.col("target").alias("a"), F.col("source").alias("b"))
    return ahead.unionByName(back).distinct()


def data_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, a, b), both ways: data flow, and callers with the definitions of what they invoke (G13, join 5)."""
    direct = edges.filter(F.col("type") == "DATA_FLOW").select("scan_id", F.col("source").alias("a"), F.col("target").alias("b"))
    last = last_by_id(nodes)
    called = last.filter(F.col("type") == "METHOD_CALL").select("scan_id", F.col("id").alias("target"), "name")
    made = last.filter(F.col("type") == "METHOD").select("scan_id", "name", F.col("id").alias("b"))
    invoked = edges.filter(F.col("type") == "INVOKES").select("scan_id", F.col("source").alias("a"), "target").join(called, ["scan_id", "target"]).join(made, ["scan_id", "name"]).select("scan_id", "a", "b")
    both = direct.unionByName(invoked)
    return both.unionByName(both.select("scan_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(scan_id, id, component): the smallest identifier of each connected part of links both ways.

    Alternate star contraction: each round links every node's larger neighbours to the smallest one it sees, then its
    smaller ones, until a round changes nothing. The number of rounds grows with the logarithm of the size. A hub's minimum
    is combined before the shuffle, and it goes back to the hub's neighbours by hot_split_join, which leaves the
    neighbours of the heaviest hubs where they are. Each round is cut to the shared folder and replaces the one before;
    rows and a sum of hashes are counted in the same pass that writes it.
    """
    spark = links.sparkSession
    now = cut(links.filter("a <> b").select("scan_id", F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = None
    while True:
        both = now.unionByName(now.select("scan_id", F.col("u").alias("v"), F.col("v").alias("u")))
        low = cut(both.groupBy("scan_id", "v").agg(F.min("u").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "v")), "low")
        large = cut(hot_split_join(both.filter("u > v"), low, ["scan_id", "v"], "n").select("scan_id", F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct(), "large")
        small_low = cut(large.groupBy("scan_id", "v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "low")
        kept = hot_split_join(large, small_low, ["scan_id", "v"], "n")
        stars = kept.select("scan_id", "v", F.col("m").alias("u")).unionByName(kept.select("scan_id", F.col("u").alias("v"), F.col("m").alias("u"))).filter("v <> u").distinct()
        seen = Observation()
        new_now = cut(stars.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("scan_id", "v", "u").cast("decimal(20,0)")), F.lit(0)).alias("h")), "stars")
        for old in (now, low, large, small_low):
            discard(old)
        now, new = new_now, tuple(sorted(seen.get.items()))
        if new == state:
            break
        state = new
    ends = links.select("scan_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.join(now.select("scan_id", F.col("v").alias("id"), F.col("u").alias("component")), ["scan_id", "id"], "left").withColumn("component", F.coalesce("component", "id"))


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(scan_id, source, id) of what each start reaches over links both ways, itself included (G14): one component each."""
    part = components(links)
    mine = starts.select("scan_id", F.col("id").alias("source")).distinct()
    home = mine.join(part.withColumnRenamed("id", "source"), ["scan_id", "source"], "left")
    met = home.join(part, ["scan_id", "component"]).select("scan_id", "source", "id")
    return met.unionByName(mine.select("scan_id", "source", F.col("source").alias("id"))).distinct()


#: Rounds kept in folders of their own before they are put together, so that listing them stays cheap.
ROUNDS_APART = 12


def _kept(df: DataFrame, label: str, folders: list[str]) -> tuple[DataFrame, int]:
    """A round written to a folder of its own, with the number of its rows, counted while they are written."""
    spark, seen = df.sparkSession, Observation()
    path = scratch_path(spark, label)
    df.observe(seen, F.count("*").alias("n")).write.parquet(path)
    if len(folders) >= ROUNDS_APART:
        whole = scratch_path(spark, label)
        spark.read.schema(df.schema).parquet(*folders).write.parquet(whole)
        for old in folders:
            remove(spark, old)
        folders[:] = [whole]
    folders.append(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def spread(links: DataFrame, starts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(scan_id, source, at) of what each start (scan_id, source, at) reaches over directed links, itself included.

    A frontier and an anti-join with everything seen; it ends when nothing is new. Rounds are folders, put together now and
    then and read as one table, so plans don't grow with the rounds. allowed: (scan_id, at) of nodes that may be entered.
    """
    spark, folders = links.sparkSession, []
    shape = starts.select("scan_id", "source", "at").schema
    front, n = _kept(starts.select("scan_id", "source", "at").distinct(), "reach", folders)
    while n:
        nxt = front.join(links.withColumnRenamed("a", "at"), ["scan_id", "at"]).select("scan_id", "source", F.col("b").alias("at")).distinct()
        if allowed is not None:
            nxt = nxt.join(allowed, ["scan_id", "at"], "left_semi")
        front, n = _kept(nxt.join(spark.read.schema(shape).parquet(*folders), ["scan_id", "source", "at"], "left_anti"), "reach", folders)
    return spark.read.schema(shape).parquet(*folders)


def shortest_paths(links: DataFrame, starts: DataFrame, goals: DataFrame, limit: int | None = None) -> DataFrame:
    """(scan_id, source, sink, path) over directed links (G16): fewest steps, then the smallest identifiers on the way.

    The links are first cut down to the nodes that a goal can be reached from, found by walking backwards from the goals.
    A frontier then keeps one path per (source, node); nodes seen before are left out by an anti-join, so it ends by itself.
    Rounds are folders that are read as one table, so plans don't grow with their number.
    limit: paths of at most so many steps; None for all.
    """
    spark, folders = links.sparkSession, []
    ends = goals.select("scan_id", F.col("id").alias("at")).distinct()
    back = spread(links.select("scan_id", F.col("b").alias("a"), F.col("a").alias("b")), ends.select("scan_id", F.lit(0).alias("source"), "at"))
    useful = back.select("scan_id", F.col("at").alias("b"))
    links = cut(links.join(useful, ["scan_id", "b"], "left_semi").select("scan_id", "a", "b"), "useful-links")

    frontier, n = _kept(starts.select("scan_id", F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path")).distinct(), "frontier", folders)
    shape, steps = frontier.schema, 0
    while (limit is None or steps < limit) and n:
        steps += 1
        nxt = frontier.join(links, (frontier.scan_id == links.scan_id) & (frontier["at"] == links.a)).select(frontier.scan_id, "source", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        best = nxt.groupBy("scan_id", "source", "at").agg(F.min("path").alias("path"))
        known = spark.read.schema(shape).parquet(*folders).select("scan_id", "source", "at")
        frontier, n = _kept(best.join(known, ["scan_id", "source", "at"], "left_anti"), "frontier", folders)
    paths = spark.read.schema(shape).parquet(*folders)
    return paths.join(ends, ["scan_id", "at"], "left_semi").filter("source <> at").select("scan_id", "source", F.col("at").alias("sink"), "path")


def as_documents(nodes: DataFrame, edges: DataFrame, **about: Column) -> DataFrame:
    """(scan_id, part, pos, document): graphs as JSON documents for storage or download (sinks 7 and 9).

    A row per node and edge, and one head per graph (part 'graph') with its counts and what `about` adds, such as the time
    of the export. So a graph of any size is written without gathering it in one row; write_graphs() stores the rows.
    """
    rest = lambda df: F.struct(*[c for c in df.columns if c not in ("scan_id", "pos")])
    n = nodes.select("scan_id", F.lit("node").alias("part"), F.col("pos").cast("bigint").alias("pos"), F.to_json(rest(nodes)).alias("document"))
    e = edges.select("scan_id", F.lit("edge").alias("part"), F.col("pos").cast("bigint").alias("pos"), F.to_json(rest(edges)).alias("document"))
    sums = n.unionByName(e).groupBy("scan_id").agg(F.count_if(F.col("part") == "node").alias("totalNodes"), F.count_if(F.col("part") == "edge").alias("totalEdges"))
    head = sums.select("scan_id", F.lit("graph").alias("part"), F.lit(None).cast("bigint").alias("pos"), F.to_json(F.struct(F.col("scan_id").alias("scanId"), "totalNodes", "totalEdges", *(c.alias(k) for k, c in about.items()))).alias("document"))
    return head.unionByName(n).unionByName(e)


#: Folders that stored graphs are spread over, each with whole graphs. Fixed, since what is appended later must meet what is there.
FOLDERS = 64


def _folder(scan_id: Column) -> Column:
    """The folder of a graph, from a checksum that other programs have too."""
    return F.coalesce(F.crc32(scan_id.cast("string").cast("binary")) % FOLDERS, F.lit(0)).cast("int")


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str, **about: Column) -> None:
    """Store graphs as compressed JSON lines in path/part=.../folder=... (sink 7); what is there already stays.

    A folder per graph would make three folders and some files for each, so the number of graphs, not their size, would
    decide how long it takes. Folders hold many graphs, and a graph's rows stand together in one folder per part. Rows
    are brought together by folder; adaptive execution splits what is too large for a task, so a hot graph becomes several files.
    """
    docs = as_documents(nodes, edges, **about).withColumn("folder", _folder(F.col("scan_id")))
    docs.hint("rebalance", F.col("part"), F.col("folder")).write.mode("append").partitionBy("part", "folder").json(path, compression="gzip")


def read_graphs(spark: SparkSession, path: str, key: str = "bigint", scan_id: object = None) -> DataFrame:
    """(scan_id, part, pos, document) as write_graphs() stored them. scan_id: of that graph alone, reading its folders only."""
    rows = spark.read.schema(f"scan_id {key}, pos bigint, document string, part string, folder int").json(path)
    if scan_id is not None:
        wanted = F.lit(scan_id).cast(key)
        rows = rows.filter((F.col("folder") == _folder(wanted)) & (F.col("scan_id") == wanted))
    return rows.select("scan_id", "part", "pos", "document")


def dot(nodes: DataFrame, edges: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, dot): each graph in the DOT language (sink 8), nodes and edges in order of their identifiers."""
    quoted = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    special = F.when(F.col("type").isin("entry", "exit"), F.lit(", style=filled")).otherwise(F.lit(""))
    n = nodes.select(key, F.lit(0).alias("part"), F.col("pos").alias("k"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), quoted(F.col("label")), F.lit('"'), special, F.lit("];")).alias("t"))
    e = edges.select(key, F.lit(1).alias("part"), F.col("pos").alias("k"), F.concat(F.lit('  "'), F.col("source").cast("string"), F.lit('" -> "'), F.col("target").cast("string"), F.lit('";')).alias("t"))
    body = n.unionByName(e).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "k", "t"))).alias("ls"))
    return body.select(key, F.concat(F.lit("digraph G {\n"), F.array_join(F.col("ls.t"), "\n"), F.lit("\n}")).alias("dot"))
