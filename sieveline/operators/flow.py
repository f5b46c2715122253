"""Flow graphs and checks from lines (operators G22 to G25; source 17; functions E3, E4; joins 8, 9, 13, 14; filters 6, 10 to 13;
projection 18; aggregation 15).

Everything works on lines (file_id, language, line_no, line). Windows are partitioned by file, so a partition is never
larger than one file's lines. A node of a file is known by its position there; 0 is the entry, -1 the exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.text import label, trim_all

# Words and patterns that lines are classified by.
CONTROL_WORDS = ["if", "else", "for", "while", "switch", "try", "catch", "finally"]
FUNCTION_PATTERNS = {"javascript": r"function\s+\w+|const\s+\w+\s*=\s*\(|=>\s*\{", "python": r"def\s+\w+\s*\(", "java": r"public|private|protected.*\s+\w+\s*\("}
NOT_VARIABLES = ["if", "else", "for", "while", "function", "def", "class", "import", "return", "true", "false", "null", "undefined"]
DEFINITION_PATTERNS = {"javascript": (r"(?:let|const|var)\s+(\w+)", 1, None), "python": (r"(\w+)\s*=", 1, None), "java": (r"(\w+)\s+(\w+)\s*[=;]", 2, 1)}
SENSITIVE = ["password", "pwd", "secret", "key", "token", "api", "credential"]
EXPOSING = ["console.log", "print", "System.out", "log.info", "logger.info"]
AUTH_WORDS = ["authenticate", "auth", "token", "login", "session", "verify"]
CHECK_WORDS = ["validate", "check", "verify", "security", "sanitize"]
# What the checks on pseudo-AST rows report: rule, severity, confidence.
SEMANTIC = {
    "missing-auth-check": ("high", 0.7),
    "xss-reflection": ("high", 0.8),
    "insecure-cookie": ("medium", 0.9),
    "sql-injection-python": ("critical", 0.9),
    "insecure-deserialization-python": ("high", 0.95),
    "weak-random-python": ("medium", 0.6),
    "insecure-serialization-java": ("high", 0.8),
    "sql-injection-java": ("critical", 0.9),
}
ENTRY, EXIT = 0, -1


def any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def is_function(line: Column, language: Column) -> Column:
    return F.coalesce(*(F.when(language == lang, line.rlike(p)) for lang, p in FUNCTION_PATTERNS.items()), F.lit(False))


def line_type(line: Column, language: Column) -> Column:
    """function, control, assignment, call or statement, by the first test that holds (projection 18)."""
    assigns = line.rlike(r"\w+\s*[=]\s*") & ~F.contains(line, F.lit("==")) & ~F.contains(line, F.lit("!="))
    return F.when(is_function(line, language), "function").when(any_of(line, CONTROL_WORDS), "control").when(assigns, "assignment").when(line.rlike(r"\w+\s*\("), "call").otherwise("statement")


def significant(lines: DataFrame, block_comments: bool = True) -> DataFrame:
    """Trimmed lines without blank and comment lines (filter 6); with block_comments, openings of block comments go too."""
    rows = lines.withColumn("code", trim_all(F.col("line"))).filter("code <> ''")
    return rows.filter(~F.col("code").rlike(r"^(?://|#|/\*)" if block_comments else r"^(?://|#)"))


def cfg_nodes(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Nodes of the line flow (G22): the entry, the significant lines in order, the exit."""
    order = W.partitionBy(file).orderBy("line_no")
    body = significant(lines).select(file, F.row_number().over(order).alias("node"), line_type(F.col("code"), F.col("language")).alias("type"), label(F.col("code")).alias("label"), F.col("line_no").cast("bigint").alias("line_no"), "code")
    ends = lines.groupBy(file).agg(F.max("line_no").cast("bigint").alias("n"))
    end = F.explode(F.array(F.struct(F.lit(ENTRY).alias("node"), F.lit("entry").alias("type"), F.lit("ENTRY").alias("label"), F.lit(1).cast("bigint").alias("line_no")), F.struct(F.lit(EXIT).alias("node"), F.lit("exit").alias("type"), F.lit("EXIT").alias("label"), F.col("n").alias("line_no"))))
    return body.unionByName(ends.select(file, end.alias("e")).select(file, "e.*", F.lit(None).cast("string").alias("code")))


def cfg_edges(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Edges of the line flow (G22): each significant line from the one before, the first from the entry, the last to the exit."""
    body = significant(lines).groupBy(file).agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.col("n").cast("int"))
    return body.select(file, F.col("n"), F.explode(steps).alias("k")).select(file, F.col("k").cast("bigint").alias("source"), F.when(F.col("k") == F.col("n"), F.lit(EXIT)).otherwise(F.col("k") + 1).cast("bigint").alias("target"), F.when(F.col("k") == F.col("n"), "end").otherwise("next").alias("label"))


def definitions(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, line_no, ord, name, type) of what lines define, by language (E3); other languages define nothing."""
    parts = []
    for language, (pattern, name, kind) in DEFINITION_PATTERNS.items():
        found = lines.filter(F.col("language") == language)
        names = F.regexp_extract_all("code", F.lit(pattern), F.lit(name))
        types = F.regexp_extract_all("code", F.lit(pattern), F.lit(kind)) if kind else F.transform(names, lambda _: F.lit(None).cast("string"))
        parts.append(found.select(file, "line_no", F.posexplode(F.arrays_zip(names.alias("name"), types.alias("type"))).alias("ord", "d")).select(file, "line_no", "ord", F.col("d.name").alias("name"), F.col("d.type").alias("type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def uses(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, line_no, ord, name) of the identifiers of lines, each once a line in order of appearance."""
    words = F.array_distinct(F.filter(F.regexp_extract_all("code", F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z_]\w*)"), F.lit(1)), lambda w: ~w.isin(NOT_VARIABLES) & (F.length(w) > 1)))
    return lines.select(file, "line_no", F.posexplode(words).alias("ord", "name"))


def dfg_nodes(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Definition and use nodes (G23), numbered through each file: a line's definitions before its uses."""
    rows = significant(lines, block_comments=False)
    defs = definitions(rows, file).withColumn("kind", F.lit("definition")).withColumn("rank", F.lit(0))
    use = uses(rows, file).withColumn("type", F.lit(None).cast("string")).withColumn("kind", F.lit("use")).withColumn("rank", F.lit(1))
    order = W.partitionBy(file).orderBy("line_no", "rank", "ord")
    return defs.unionByName(use).withColumn("node", F.row_number().over(order)).select(file, "node", "kind", "name", "type", F.col("line_no").cast("bigint").alias("line_no"))


def dfg_edges(nodes: DataFrame, file: str = "file_id") -> DataFrame:
    """From the last definition to each use of a name (G23, join 9): one window instead of an as-of join."""
    before = W.partitionBy(file, "name").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("kind") == "definition", F.col("node")), ignorenulls=True).over(before)
    return nodes.withColumn("source", last).filter("kind = 'use' and source is not null").select(file, "source", F.col("node").alias("target"), "name")


def variables(nodes: DataFrame, file: str = "file_id") -> DataFrame:
    """Definition and use sites of each variable (aggregation 15)."""
    site = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("node"))))
    return nodes.groupBy(file, "name").agg(F.min_by(F.when(F.col("kind") == "definition", F.col("type")), "node").alias("type"), site("definition").alias("definition_sites"), site("use").alias("use_sites"))


def latest_declaration(nodes: DataFrame, key: list[str], name: str = "name", pos: str = "pos", declares: str = "declares") -> DataFrame:
    """Each row with the last row before or at it that declares its name in its scope (join 8)."""
    before = W.partitionBy(*key, name).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return nodes.withColumn("declared_at", F.last(F.when(F.col(declares), F.col(pos)), ignorenulls=True).over(before))


def sensitive_uses(nodes: DataFrame, lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Uses of variables with telling names on lines that print or log (join 13, filter 13)."""
    rows = nodes.filter((F.col("kind") == "use") & any_of(F.lower("name"), SENSITIVE)).select(file, "line_no", "name", "node")
    shown = lines.filter(any_of(F.col("line"), EXPOSING)).select(file, F.col("line_no").cast("bigint").alias("line_no"), trim_all(F.col("line")).alias("code"))
    return rows.join(shown, [file, "line_no"])


def unreachable(nodes: DataFrame, edges: DataFrame, file: str = "file_id") -> DataFrame:
    """Nodes after a return or throw that no edge enters (join 14)."""
    order = W.partitionBy(file).orderBy("node")
    after = nodes.filter(F.col("node") > 0).withColumn("before", F.lag("code").over(order)).filter(any_of(F.coalesce("before", F.lit("")), ["return", "throw"]))
    return after.join(edges.select(file, F.col("target").alias("node")), [file, "node"], "left_anti").drop("before")


def pseudo_ast(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, language, line_no, ord, type, name, indent, code): what the light line parsers make of lines (source 17).

    JavaScript lines may be several things at once, Python lines are one, Java members belong to the last class above.
    """
    rows = lines.withColumn("code", trim_all(F.col("line")))
    has = lambda *w: any_of(F.col("code"), list(w))
    call = F.contains("code", F.lit("(")) & F.contains("code", F.lit(")"))
    keep = [file, "language", "line_no"]
    js = rows.filter(F.col("language").isin("javascript", "typescript"))
    kinds = F.array_compact(F.array(F.when(has("function ", "=> "), F.lit("FunctionDeclaration")), F.when(has("var ", "let ", "const "), F.lit("VariableDeclaration")), F.when(call, F.lit("CallExpression"))))
    js = js.select(*keep, F.posexplode(kinds).alias("ord", "type"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("indent"), "code")
    start = lambda *w: F.col("code").rlike("^(?:" + "|".join(w) + ") ")
    named = lambda word: F.coalesce(F.nullif(F.regexp_extract("code", word + r"\s+(\w+)", 1), F.lit("")), F.lit("unknown"))
    kind = F.when(start("def"), "FunctionDef").when(start("class"), "ClassDef").when(start("import", "from"), "Import").when(has("=") & ~has("=="), "Assign").when(call, "Expr")
    py = rows.filter((F.col("language") == "python") & (F.col("code") != "")).withColumn("type", kind).filter("type is not null")
    py = py.select(*keep, F.lit(0).alias("ord"), "type", F.when(F.col("type") == "FunctionDef", named("def")).when(F.col("type") == "ClassDef", named("class")).alias("name"), (F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))).alias("indent"), "code")
    java = rows.filter((F.col("language") == "java") & (F.col("code") != "") & ~start("package", "import"))
    is_class = has("class ") & has("{")
    above = W.partitionBy(file).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    java = java.withColumn("owner", F.last(F.when(is_class, named("class")), ignorenulls=True).over(above))
    member = has("public ", "private ", "protected ") & F.col("owner").isNotNull()
    method = F.nullif(F.regexp_extract("code", r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+\s+)?(\w+)\s*\(", 1), F.lit(""))
    jkind = F.when(is_class, "ClassDeclaration").when(member & F.contains("code", F.lit("(")), F.when(method.isNotNull(), "MethodDeclaration")).when(member & F.contains("code", F.lit(";")), "FieldDeclaration")
    java = java.withColumn("type", jkind).filter("type is not null").select(*keep, F.lit(0).alias("ord"), "type", F.when(F.col("type") == "ClassDeclaration", named("class")).when(F.col("type") == "MethodDeclaration", method).alias("name"), F.lit(0).alias("indent"), "code")
    return js.unionByName(py).unionByName(java)


def ast_flow(ast: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, source, target, type) between a file's pseudo-AST rows in order (G24, G25): Python by indentation, the others
    in sequence; in Java from each class to what it holds."""
    order = W.partitionBy(file).orderBy("line_no", "ord")
    rows = ast.withColumn("node", F.row_number().over(order)).withColumn("next_indent", F.lead("indent").over(order)).withColumn("next", F.lead("type").over(order))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("class_node", F.last(F.when(F.col("type") == "ClassDeclaration", F.col("node")), ignorenulls=True).over(upto))
    kind = F.when(F.col("next_indent") > F.col("indent"), "enter_block").when(F.col("next_indent") < F.col("indent"), "exit_block").otherwise("sequential")
    chained = rows.filter("language <> 'java' and next is not null").select(file, F.col("node").alias("source"), (F.col("node") + 1).alias("target"), F.when(F.col("language") == "python", kind).otherwise("sequential").alias("type"))
    held = rows.filter("language = 'java' and type <> 'ClassDeclaration' and class_node is not null").select(file, F.col("class_node").alias("source"), F.col("node").alias("target"), F.lit("member").alias("type"))
    classes = rows.filter("type = 'ClassDeclaration'").withColumn("target", F.lead("node").over(order)).filter("target is not null").select(file, F.col("node").alias("source"), "target", F.lit("sequential").alias("type"))
    return chained.unionByName(held).unionByName(classes)


def semantic_matches(ast: DataFrame) -> DataFrame:
    """Pseudo-AST rows with the checks that hold on them (filters 10 to 12): (…, rule_id, severity, confidence)."""
    has = lambda *w: any_of(F.col("code"), list(w))
    low = F.lower("code")
    is_ = lambda t: F.col("type") == t
    checks = {
        "missing-auth-check": is_("CallExpression") & has("app.") & has(".get(", ".post(") & ~any_of(low, AUTH_WORDS),
        "xss-reflection": is_("CallExpression") & has("innerHTML", "document.write"),
        "insecure-cookie": is_("CallExpression") & has("cookie") & ~(has("secure") & has("httpOnly")),
        "sql-injection-python": is_("Expr") & has("cursor.execute") & has("%s"),
        "insecure-deserialization-python": is_("Expr") & has("pickle.load"),
        "weak-random-python": is_("Import") & has("random"),
        "insecure-serialization-java": is_("MethodDeclaration") & (F.col("name") == "readObject") & ~any_of(low, CHECK_WORDS),
        "sql-injection-java": is_("MethodDeclaration") & has("Statement") & has("executeQuery") & ~has("PreparedStatement"),
    }
    said = lambda rule: F.struct(F.lit(rule).alias("rule_id"), F.lit(SEMANTIC[rule][0]).alias("severity"), F.lit(SEMANTIC[rule][1]).cast("double").alias("confidence"))
    found = F.array_compact(F.array(*(F.when(test, said(rule)) for rule, test in checks.items())))
    return ast.select("*", F.explode(found).alias("m")).select("*", "m.*").drop("m")
