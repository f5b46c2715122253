"""Problem 6: deeply nested records as flat tables with parent links, by Dewey labels.

Every node of a document gets the ordinal path from the root as its label: the names of fields and the 0-based positions
in arrays, joined by '/'. A node's parent is its label cut off at the end, its table is its label with the positions
left out, so neither needs a join. A specification names the levels that become tables and the columns of each; what a row
holds besides stays beside them as JSON.

Documents are read as VARIANT values and taken apart by array functions, one explode for all tables, in the JVM. What a
VARIANT can't hold (repeated keys, more than a thousand levels, sizes beyond its bound) and what isn't JSON at first sight is
read once more by a parser without a stack of its own, whatever the depth; both ways give the same rows.

Defined cases: a null, empty or cut payload, and one whose root is no object once unwrapped, has no rows; envelopes and
JSON kept in JSON strings are unwrapped to any depth; null elements have no row but keep their position; a single value
or object where an array may stand is an array of one; of repeated keys the last counts; lone surrogates become U+FFFD;
documents may be of any size and depth. Reports with a null identifier keep null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import load

NODES = "record_id bigint, node_path string, table_name string, ordinal bigint, node string"
ROW = "array<struct<node_path:string,table_name:string,ordinal:bigint,node:variant>>"
#: Envelopes and strings that are unwrapped as VARIANT values; documents wrapped more often take the other way.
UNWRAPPED = 4


@dataclass(frozen=True)
class Level:
    """One table: the array (or lone value) under `name`, whose elements have the tables `below`.

    via: an object on the way to the array that is no level of its own; it may be kept as a JSON string.
    columns: name -> (path, type) of what becomes a column; '$' of a lone value is the value itself.
    """

    name: str
    below: tuple[Level, ...] = field(default=())
    via: tuple[str, ...] = ()
    objects_only: bool = False
    columns: tuple[tuple[str, str, str], ...] = ()


#: The levels of a scan report: vulnerabilities, the three context fields, and what lies below their objects.
SCAN_REPORT = (
    Level(
        "vulnerabilities",
        (
            Level("semgrep", (Level("trace", columns=(("step", "$.step", "string"), ("path", "$.at.path", "string"), ("line", "$.at.line", "bigint"))),), via=("context",), columns=(("check_id", "$.check_id", "string"), ("cwe", "$.extra.metadata.cwe", "string"), ("value", "$", "scalar"))),
            Level("lines", (Level("marks", columns=(("from", "$.from", "bigint"), ("to", "$.to", "bigint"))),), via=("context",), columns=(("no", "$.no", "bigint"), ("text", "$.text", "string"), ("value", "$", "scalar"))),
            Level("batch", (Level("members", columns=(("path", "$.path", "string"), ("ok", "$.ok", "boolean"))),), via=("context",), columns=(("id", "$.id", "string"), ("index", "$.index", "bigint"), ("value", "$", "scalar"))),
        ),
        objects_only=True,
        columns=(("rule_id", "$.rule_id", "string"), ("severity", "$.severity", "string"), ("location", "$.location", "string"), ("cwe_id", "$.cwe_id", "string"), ("file_path", "$.context.file_path", "string")),
    ),
)

_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """JSON of any depth, read with a list of open arrays and objects instead of calls; ValueError if it isn't JSON."""
    at = _BLANK.match(text, 0).end()
    opened: list[tuple[list | dict, str | None]] = []
    while True:
        c = text[at : at + 1]
        key, value, complete = None, None, True
        if opened and isinstance(opened[-1][0], dict) and c != "}":
            if c != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at = _BLANK.match(text, at + 1).end()
            c = text[at : at + 1]
        if c in ("[", "{") and c:
            opened.append(([] if c == "[" else {}, key))
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                continue
            complete = False
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            value = _WORDS[m[0]] if m[1] is None else (float(m[0]) if re.search("[.eE]", m[0]) else int(m[0]))
            at = m.end()
        else:
            raise ValueError("no value")
        while True:  # put the value where it belongs, and close what ends behind it
            if complete:
                at = _BLANK.match(text, at).end()
                if not opened:
                    if at != len(text):
                        raise ValueError("more behind the value")
                    return value
                held = opened[-1][0]
                if isinstance(held, list):
                    held.append(value)
                else:
                    held[key] = value
                if text[at : at + 1] == ",":
                    at = _BLANK.match(text, at + 1).end()
                    if text[at : at + 1] in ("]", "}"):
                        raise ValueError("nothing behind a comma")
                    break
            if text[at : at + 1] != ("]" if isinstance(opened[-1][0], list) else "}"):
                raise ValueError("not closed")
            value, key = opened.pop()
            at, complete = at + 1, True


def write_deep(value) -> str:
    """A value of any depth as JSON text."""
    out: list[str] = []
    todo: list = [(False, value)]
    while todo:
        raw, x = todo.pop()
        if raw:
            out.append(x)
        elif isinstance(x, (dict, list)):
            pairs = list(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
            todo.append((True, "}" if isinstance(x, dict) else "]"))
            for k in range(len(pairs) - 1, -1, -1):
                key, v = pairs[k]
                todo.append((False, v))
                todo.append((True, ("," if k else "") + (json.dumps(key, ensure_ascii=False) + ":" if isinstance(x, dict) else "")))
            out.append("{" if isinstance(x, dict) else "[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _parse(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return parse_deep(text)
    except ValueError:
        return None


def unwrap(value, envelope: str, inside: str):
    """The report itself: out of JSON strings and out of objects that hold it under `envelope`."""
    while True:
        if isinstance(value, str):
            value = _parse(value)
        elif isinstance(value, dict) and inside not in value and isinstance(value.get(envelope), (dict, str)):
            value = value[envelope]
        else:
            return value if isinstance(value, dict) else None


def _plain(value) -> str:
    try:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        text = write_deep(value)
    return text.encode("utf-8", "replace").decode("utf-8")


def _without(node: dict, below: tuple[Level, ...]) -> dict:
    """The node's own fields: those that are levels left out, also inside the objects on the way to them."""
    own = {k: v for k, v in node.items() if not any(x.name == k and not x.via for x in below)}
    for step in {x.via[0] for x in below if x.via}:
        held = _parse(own[step]) if isinstance(own.get(step), str) else own.get(step)
        if isinstance(held, dict):
            own[step] = _without(held, tuple(Level(x.name, x.below, x.via[1:]) for x in below if x.via and x.via[0] == step))
    return own


def walk(root: dict, levels: tuple[Level, ...]) -> Iterator[tuple[str, str, int, str]]:
    """(label, table, ordinal, node without its own tables) of every flat row of a document, parents first."""
    todo = [(root, "", "", levels)]
    while todo:
        node, label, table, below = todo.pop()
        for level in below:
            held = node
            for step in level.via:
                held = held.get(step) if isinstance(held, dict) else None
                if isinstance(held, str):
                    held = _parse(held)
            held = held.get(level.name) if isinstance(held, dict) else None
            if held is None:
                continue
            name = f"{table}/{level.name}" if table else level.name
            for i, element in enumerate(held if isinstance(held, list) else [held]):
                if element is None or (level.objects_only and not isinstance(element, dict)):
                    continue
                at = f"{label}/{level.name}/{i}" if label else f"{level.name}/{i}"
                own = element
                if isinstance(element, dict):
                    own = _without(element, level.below)
                    todo.append((element, at, name, level.below))
                yield at, name, i, _plain(own)


def _read_again(levels: tuple[Level, ...], envelope: str):
    """The rows of documents that aren't taken apart as VARIANT values."""
    first = levels[0].name
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["record_id", "node_path", "table_name", "ordinal", "node"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in types]
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = unwrap(text, envelope, first) if text else None
                if root is None:
                    continue
                for row in walk(root, levels):
                    for col, x in zip(cols, (rid, *row), strict=True):
                        col.append(x)
                    if len(cols[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                        cols = [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows


def _whole(text: str) -> str:
    """A text as VARIANT if all of it is one JSON value, else null: what follows a value would go unnoticed on its own."""
    return f"transform(array(try_variant_get(try_parse_json(concat('[', {text}, ',\"#end\"]')), '$', 'array<variant>')), a -> if(size(a) = 2 and try_variant_get(a[1], '$', 'string') = '#end', a[0], null))[0]"


def _is_object(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>') is not null"


def _given(v: str) -> str:
    return f"({v} is not null and not is_variant_null({v}))"


def _flat(level: Level, held: str, label: str, table: str, depth: int) -> str:
    """An array of the rows of a level and of those below it. held: the VARIANT under the level's name; label: its prefix."""
    e, i, name = f"e{depth}", f"i{depth}", f"{table}/{level.name}" if table else level.name
    at = f"concat({label}, '{level.name}/', {i})"
    rows = [f"array(struct({at} as node_path, '{name}' as table_name, cast({i} as bigint) as ordinal, {e} as node))"]
    for step in dict.fromkeys(x.via for x in level.below):
        inside = [x for x in level.below if x.via == step]
        o = f"o{depth}"
        below = [_flat(x, f"try_variant_get({o}, '$.{x.name}', 'variant')", f"concat({at}, '/')", name, depth + 1) for x in inside]
        joined = f"concat({', '.join(below)})" if len(below) > 1 else below[0]
        if step:
            v = f"try_variant_get({e}, '$.{step[0]}', 'variant')"
            holder = f"if({_is_object(v)}, {v}, if(try_variant_get({v}, '$', 'array<variant>') is null, {_whole(f"try_variant_get({v}, '$', 'string')")}, null))"
        else:
            holder = e
        rows.append(f"flatten(transform(array({holder}), {o} -> {joined}))")
    here = f"concat({', '.join(rows)})" if len(rows) > 1 else rows[0]
    test = f"{_given(e)}" + (f" and {_is_object(e)}" if level.objects_only else "")
    items = f"coalesce(try_variant_get({held}, '$', 'array<variant>'), if({_given(held)}, array({held}), array()))"
    return f"flatten(transform({items}, ({e}, {i}) -> if({test}, {here}, cast(array() as {ROW}))))"


def _own(levels: tuple[Level, ...]) -> str:
    """A row's own JSON by its table: its fields without those that are levels, also inside the object on the way to them."""
    cases = []

    def visit(level: Level, table: str) -> None:
        name = f"{table}/{level.name}" if table else level.name
        direct = [x.name for x in level.below if not x.via]
        fields = "try_variant_get(node, '$', 'map<string,variant>')"
        if direct:
            fields = f"map_filter({fields}, (k, x) -> k not in ({', '.join(f"'{d}'" for d in direct)}))"
        for step in {x.via[0] for x in level.below if x.via}:
            gone = ", ".join(f"'{x.name}'" for x in level.below if x.via and x.via[0] == step)
            text = _whole("try_variant_get(x, '$', 'string')")
            held = f"coalesce(try_variant_get(x, '$', 'map<string,variant>'), try_variant_get({text}, '$', 'map<string,variant>'))"
            fields = f"transform_values({fields}, (k, x) -> if(k = '{step}' and {held} is not null, to_variant_object(map_filter({held}, (k2, x2) -> k2 not in ({gone}))), x))"
        if direct or any(x.via for x in level.below):
            cases.append(f"when table_name = '{name}' and {_is_object('node')} then to_json({fields})")
        for x in level.below:
            visit(x, name)

    for level in levels:
        visit(level, "")
    return f"case {' '.join(cases)} else to_json(node) end" if cases else "to_json(node)"


def shred(df: DataFrame, record_id: str, payload: str, levels: tuple[Level, ...], envelope: str = "report", bodies: bool = True) -> DataFrame:
    """All flat rows of all documents: record_id, its Dewey label, its table, its ordinal and its own JSON (null without bodies)."""
    first = levels[0].name
    rows = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).alias("_p")).filter("_p <> ''")
    has = f"try_variant_get(v, '$.{first}', 'variant') is not null"
    enclosed = f"try_variant_get(v, '$.{envelope}', 'variant')"
    root = f"array({_whole('_p')})"
    for _ in range(UNWRAPPED):
        root = f"transform({root}, v -> case when {has} then v when {enclosed} is not null then {enclosed} when {_is_object('v')} then v else {_whole("try_variant_get(v, '$', 'string')")} end)"
    odd = []
    for step in {x.via[0] for level in levels for x in level.below if x.via}:
        kept = f"try_variant_get(e, '$.{step}', 'variant')"
        items = f"coalesce(try_variant_get(v, '$.{first}', 'array<variant>'), array(try_variant_get(v, '$.{first}', 'variant')))"
        odd.append(f"exists({items}, e -> {_given(kept)} and not {_is_object(kept)} and try_variant_get({kept}, '$', 'array<variant>') is null and {_whole(f"try_variant_get({kept}, '$', 'string')")} is null)")
    # 0: taken apart here; 1: nothing to take apart; 2: read again.
    state = f"case when {has} then {'if(' + ' or '.join(odd) + ', 2, 0)' if odd else '0'} when {_is_object('v')} and {enclosed} is null then 1 else 2 end"
    # An explode, because what it gives is neither computed twice nor moved into a filter.
    rows = rows.select("record_id", "_p", F.expr(f"inline(transform({root}, v -> struct(v as _v, {state} as _state)))"))
    flat = "concat(" + ", ".join(_flat(x, f"try_variant_get(_v, '$.{x.name}', 'variant')", "''", "", 0) for x in levels) + ")"
    parts = rows.filter("_state = 0").select("record_id", F.expr(f"inline({flat})"))
    near = parts.select("record_id", "node_path", "table_name", "ordinal", F.expr(_own(levels) if bodies else "cast(null as string)").alias("node"))
    return near.unionByName(rows.filter("_state = 2").select("record_id", "_p").mapInArrow(_read_again(levels, envelope), NODES))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Each row with the label of its parent (null at the top) and the number of levels above it."""
    depth = F.size(F.split("node_path", "/")) / 2
    parent = F.nullif(F.regexp_replace("node_path", r"(?:^|/)[^/]+/\d+$", ""), F.lit(""))
    return nodes.withColumn("parent_path", parent).withColumn("depth", depth.cast("int"))


def find_level(levels: tuple[Level, ...], name: str) -> Level:
    """The level of a table's name."""
    held, out = levels, None
    for part in name.split("/"):
        out = next(x for x in held if x.name == part)
        held = out.below
    return out


def table(nodes: DataFrame, name: str, levels: tuple[Level, ...] = SCAN_REPORT) -> DataFrame:
    """One flat table, by its schema path: keys, parent, and the columns of its level with their types."""
    v = "try_parse_json(node)"
    pick = lambda path, kind: F.expr(f"if({_is_object(v)}, null, try_variant_get({v}, '$', 'string'))" if kind == "scalar" else f"try_variant_get({v}, '{path}', '{kind}')")
    rows = with_parents(nodes.filter(F.col("table_name") == name))
    return rows.select("record_id", "node_path", "parent_path", "ordinal", *(pick(path, kind).alias(c) for c, path, kind in find_level(levels, name).columns), "node")


def table_names(levels: tuple[Level, ...] = SCAN_REPORT, above: str = "") -> list[str]:
    """The schema paths of all tables, parents first."""
    out = []
    for x in levels:
        name = f"{above}/{x.name}" if above else x.name
        out += [name, *table_names(x.below, name)]
    return out


def write_tables(nodes: DataFrame, path: str, levels: tuple[Level, ...] = SCAN_REPORT) -> None:
    """Each flat table in a folder of its own, named by its schema path with '.' for '/'."""
    for name in table_names(levels):
        table(nodes, name, levels).write.mode("overwrite").parquet(f"{path}/{name.replace('/', '.')}")


def _nodes(spark: SparkSession, sf_dir: str, bodies: bool = True) -> DataFrame:
    return shred(load(spark, sf_dir, "scan_reports"), "report_id", "payload", SCAN_REPORT, bodies=bodies)


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flat row with its table, its parent and its own fields."""
    return with_parents(_nodes(spark, sf_dir)).withColumnRenamed("record_id", "report_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, bodies=False).select(F.col("record_id").alias("report_id"), "node_path")


def _one(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(_nodes(spark, sf_dir), name).withColumnRenamed("record_id", "report_id").drop("node")

    return run


QUERIES = {"p6_found": p6_found, "p6_tables": p6_tables} | {f"p6_{name.rsplit('/', 1)[-1]}": _one(name) for name in table_names()}

_STEP = """select report_id, case when json_type(j) = 'OBJECT' and not json_exists(j, '$.vulnerabilities') and json_type(j -> '$.report') in ('OBJECT', 'VARCHAR') then j -> '$.report' when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then (j ->> '$')::json end else j end as j from """
_ITEMS = "unnest(case when json_type({0}) = 'ARRAY' then from_json({0}, '[\"json\"]') when {0} is null or json_type({0}) = 'NULL' then [] else [{0}] end)"
_INDEX = "unnest(generate_series(0, case when json_type({0}) = 'ARRAY' then json_array_length({0})::bigint - 1 when {0} is null or json_type({0}) = 'NULL' then -1 else 0 end))"


def _sql_level(source: str, held: str) -> str:
    return f"select report_id, node_path, {_ITEMS.format(held)} as e, {_INDEX.format(held)} as i from {source}"


_SQL = (
    "with u0 as (select report_id, case when json_valid(payload) then payload::json end as j from scan_reports where payload <> ''), "
    + ", ".join(f"u{k + 1} as ({_STEP}u{k})" for k in range(6))
    + ", top as (select report_id, '' as node_path, j -> '$.vulnerabilities' as h from u6 where json_type(j) = 'OBJECT')"
    + f", v as (select report_id, 'vulnerabilities/' || i as node_path, 'vulnerabilities' as table_name, null as parent_path, i as ordinal, e from ({_sql_level('top', 'h')}) where json_type(e) = 'OBJECT')"
    + ", c as (select report_id, node_path, case when json_type(c) = 'VARCHAR' then case when json_valid(c ->> '$') then (c ->> '$')::json end else c end as c from (select *, e -> '$.context' as c from v))"
    + "".join(
        f", {f} as (select report_id, node_path || '/{f}/' || i as node_path, 'vulnerabilities/{f}' as table_name, node_path as parent_path, i as ordinal, e from ({_sql_level(f"(select report_id, node_path, c -> '$.{f}' as h from c)", 'h')}) where json_type(e) <> 'NULL')"
        f", {g} as (select report_id, node_path || '/{g}/' || i as node_path, 'vulnerabilities/{f}/{g}' as table_name, node_path as parent_path, i as ordinal, e from ({_sql_level(f"(select report_id, node_path, e -> '$.{g}' as h from {f})", 'h')}) where json_type(e) <> 'NULL')"
        for f, g in (("semgrep", "trace"), ("lines", "marks"), ("batch", "members"))
    )
)


def _sql_table(name: str) -> str:
    level = find_level(SCAN_REPORT, name)
    # A column inside an object kept as a JSON string isn't one: it is read from what is an object.
    base = "(select * replace (case when json_type(e -> '$.context') = 'VARCHAR' and json_valid(e ->> '$.context') then json_merge_patch(json_merge_patch(e, '{\"context\": null}'), json_object('context', (e ->> '$.context')::json)) else e end as e) from v)" if name == "vulnerabilities" else name.rsplit("/", 1)[-1]
    columns = [f"case when json_type(e) not in ('OBJECT') then e ->> '$' end as \"{c}\"" if kind == "scalar" else f"try_cast(e ->> '{path}' as {kind if kind != 'string' else 'varchar'}) as \"{c}\"" for c, path, kind in level.columns]
    return f"{_SQL} select report_id, node_path, parent_path, ordinal, {', '.join(columns)} from {base}"


SQL = {"p6_found": _SQL + " " + " union all ".join(f"select report_id, node_path from {x}" for x in ("v", "semgrep", "trace", "lines", "marks", "batch", "members"))}
SQL |= {f"p6_{name.rsplit('/', 1)[-1]}": _sql_table(name) for name in table_names()}
