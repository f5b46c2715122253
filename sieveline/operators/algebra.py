"""The pattern algebra over text ranges (operators D1 to D13 and D20 to D24).

A leaf gives ranges (file_id, start, stop, text and the bindings of its groups); the others combine ranges. Starts and
stops count code points from 0, a range is [start, stop).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.match import spans

RANGE = ("file_id", "start", "stop")


# What a rule's options change in its patterns.
OPTIONS = {"generic_caseless": "i", "generic_multiline": "s"}


def leaf(files: DataFrame, pattern: str, content: str = "content", key: str = "file_id", options: dict[str, bool] | None = None) -> DataFrame:
    """All matches of a regular expression in whole files (D2), with '.' inside lines and anchors at lines unless options say so."""
    flags = "m" + "".join(f for k, f in OPTIONS.items() if (options or {}).get(k))
    found = files.filter(F.col(content).rlike(f"(?{flags}){pattern}")).withColumn("_p", F.lit(f"(?{flags}){pattern}"))
    hits = found.select(F.col(key).alias("file_id"), F.explode(spans(content, "_p")).alias("m"))
    return hits.select("file_id", (F.col("m.column_no") - 1).alias("start"), (F.col("m.column_no") - 1 + F.length("m.matched")).alias("stop"), F.col("m.matched").alias("text"))


def bind(ranges: DataFrame, pattern: str, name: str, group: int = 1) -> DataFrame:
    """A metavariable: a group of the pattern inside each range's text."""
    return ranges.withColumn(name, F.nullif(F.regexp_extract("text", pattern, group), F.lit("")))


def all_of(left: DataFrame, right: DataFrame, *bindings: str) -> DataFrame:
    """Ranges of both that agree in place and in shared bindings (D3)."""
    return left.join(right.select(*RANGE, *bindings).distinct(), [*RANGE, *bindings], "left_semi")


def any_of(*ranges: DataFrame) -> DataFrame:
    """Ranges of any (D4), each once."""
    out = ranges[0].select(*RANGE, "text")
    for r in ranges[1:]:
        out = out.unionByName(r.select(*RANGE, "text"))
    return out.distinct()


def none_of(ranges: DataFrame, denied: DataFrame) -> DataFrame:
    """Ranges that aren't among the denied ones."""
    return ranges.join(denied.select(*RANGE), list(RANGE), "left_anti")


#: Characters of a file that one window looks at.
BLOCK = 1 << 14


def _farthest(ranges: DataFrame, outer: DataFrame, at: str, inclusive: bool) -> DataFrame:
    """The ranges with `_far`: how far an outer range reaches that starts before (or at) the place `at` of theirs.

    Both sides are laid in one order of places and a running maximum of stops is read off, so ranges that lie in many outer
    ones cost no more than others. Windows hold one block of one file each; the maxima of all blocks before come from a
    window over a file's blocks, of which there are few.
    """
    mine = ranges.select("file_id", F.expr(at).alias("_at"), F.lit(1 if inclusive else -1).alias("_side"), F.lit(None).cast("bigint").alias("_stop"), F.struct("*").alias("_row"))
    theirs = outer.select("file_id", F.col("start").alias("_at"), F.lit(0).alias("_side"), F.col("stop").cast("bigint").alias("_stop"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = mine.unionByName(theirs).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    blocks = both.groupBy("file_id", "_block").agg(F.max("_stop").alias("_most"))
    earlier = W.partitionBy("file_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("file_id", "_block", F.max("_most").over(earlier).alias("_carried"))
    upto = W.partitionBy("file_id", "_block").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("_own", F.max("_stop").over(upto)).filter("_row is not null")
    return seen.join(carried, ["file_id", "_block"]).select("_row.*", F.greatest("_own", "_carried").alias("_far"))


def not_matching(ranges: DataFrame, denied: DataFrame) -> DataFrame:
    """Ranges no denied one overlaps."""
    return _farthest(ranges, denied, "stop", False).filter(F.coalesce(F.col("_far") <= F.col("start"), F.lit(True))).drop("_far")


def inside(ranges: DataFrame, outer: DataFrame) -> DataFrame:
    """Ranges inside one of the outer ones."""
    return _farthest(ranges, outer, "start", True).filter(F.col("_far") >= F.col("stop")).drop("_far")


def not_inside(ranges: DataFrame, outer: DataFrame) -> DataFrame:
    """Ranges inside none of the outer ones."""
    return _farthest(ranges, outer, "start", True).filter(F.coalesce(F.col("_far") < F.col("stop"), F.lit(True))).drop("_far")


def where_matches(ranges: DataFrame, name: str, pattern: str) -> DataFrame:
    """Bindings that begin with a match."""
    return ranges.filter(F.col(name).rlike(f"^(?:{pattern})"))


def where_compares(ranges: DataFrame, name: str, condition: str) -> DataFrame:
    """Bindings whose number satisfies a condition on `value` (D11); what is no number doesn't."""
    return ranges.withColumn("value", F.expr(f"try_cast({name} as double)")).filter(condition).drop("value")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text in bits per character (D12), in array functions."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars))
    return F.abs(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def focus(ranges: DataFrame, name: str) -> DataFrame:
    """The range of a binding inside its range."""
    at = F.instr(F.col("text"), F.col(name)) - 1
    return ranges.filter(F.col(name).isNotNull()).withColumn("start", F.col("start") + at).withColumn("stop", F.col("start") + F.length(name)).withColumn("text", F.col(name))


def glob(pattern: str) -> str:
    """A path pattern with * and ** as a regular expression."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    marks = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(marks.get(p, re.escape(p)) for p in parts) + "$"


def for_paths(files: DataFrame, include: list[str] = (), exclude: list[str] = (), path: str = "path") -> DataFrame:
    """Files a rule's path lists admit."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    if include:
        files = files.filter(p.rlike("|".join(map(glob, include))))
    return files.filter(~p.rlike("|".join(map(glob, exclude)))) if exclude else files


#: What a rewritten match is marked with while the first ones are told from the rest; a noncharacter, so no text holds it.
MARK = "\ufdd0"


def fix(text: Column, pattern: str, replacement: str, count: int | None = None) -> Column:
    """The text rewritten: all matches, or the first `count`.

    One rewriting with marks, one list of the matches as they were: gaps and rewritten matches alternate, and after the
    first `count` the matches come back as they were. Linear in the text whatever the count.
    """
    if count is None:
        return F.regexp_replace(text, pattern, replacement)
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}{replacement}{MARK}"), MARK, -1)
    were = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    back = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i >= 2 * count), F.get(were, ((i - 1) / 2).cast("int"))).otherwise(x))
    return F.array_join(back, "")


def fix_template(ranges: DataFrame, template: str, names: list[str]) -> DataFrame:
    """Ranges with `fixed`: the template with $NAME replaced by the binding of that name."""
    out = F.lit(template)
    for name in sorted(names, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${name}"), F.coalesce(F.col(name), F.lit("")))
    return ranges.withColumn("fixed", out)


def apply_fixes(files: DataFrame, fixes: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """(file_id, fixed content): files with each range (file_id, start, stop, fixed) replaced; of overlapping ones the first counts."""
    order = W.partitionBy("file_id").orderBy("start", F.desc("stop"))
    apart = fixes.select("file_id", "start", "stop", "fixed").distinct().withColumn("_seen", F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))).filter("_seen is null or start >= _seen")
    per = apart.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "fixed"))).alias("fs"))
    text, size = F.col(content), F.length(content)
    rest = lambda k: F.coalesce(F.get(F.col("fs.start"), k), size)
    pieces = F.transform("fs", lambda f, i: F.concat(f["fixed"], F.substring(text, f["stop"] + 1, rest(i + 1) - f["stop"])))
    whole = F.concat(F.substring(text, F.lit(1), rest(F.lit(0))), F.array_join(pieces, ""))
    return files.join(per, files[key] == per["file_id"]).select(files[key].alias("file_id"), whole.alias("fixed"))


# What a metavariable may stand for, and what three dots may: text with brackets closed in it, up to three deep.
_NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|\"[^\"\n]*\"|'[^'\n]*'|\d[\w.]*"
_FLAT = r"[^(){}\[\];]*"
_ONE = rf"(?:{_FLAT}\({_FLAT}\))*{_FLAT}"
_DOTS = rf"(?:{_FLAT}\({_ONE}\))*{_FLAT}"
_PIECES = re.compile(r"\.\.\.|\$[A-Z_][A-Z0-9_]*|\"[^\"]*\"|\w+|\s+|[^\w\s]")


def template(pattern: str) -> tuple[str, list[str]]:
    """A code template as a regular expression and the names of its groups.

    $X stands for a name, a text or a number and is the same everywhere it occurs; ... for anything with closed brackets;
    a text "..." for any text; white space may stand between all other pieces. It reads tokens, not syntax trees.
    """
    out, names = [], []
    for piece in _PIECES.findall(pattern.strip()):
        if piece.isspace():
            continue
        if piece == "...":
            out.append(_DOTS)
        elif piece == '"..."':
            out.append(r'"[^"\n]*"')
        elif piece[0] == "$" and len(piece) > 1:
            if piece[1:] in names:
                out.append(f"\\{names.index(piece[1:]) + 1}")
            else:
                names.append(piece[1:])
                out.append(f"({_NAME})")
        else:
            word = re.escape(piece)
            out.append(rf"\b{word}\b" if piece[0].isalnum() or piece[0] == "_" else word)
    return r"\s*".join(out), names


def match_template(files: DataFrame, pattern: str, content: str = "content", key: str = "file_id") -> DataFrame:
    """Ranges of a template in whole files with its metavariables bound."""
    regex, names = template(pattern)
    found = leaf(files, regex, content, key)
    for k, name in enumerate(names, 1):
        found = bind(found, regex, name, k)
    return found


def where_template(ranges: DataFrame, name: str, pattern: str, negated: bool = False) -> DataFrame:
    """Ranges whose binding holds a match of a template of its own (D10), with the bindings that gives."""
    regex, names = template(pattern)
    hit = F.coalesce(F.col(name).rlike(regex), F.lit(False))
    if negated:
        return ranges.filter(~hit)
    out = ranges.filter(hit)
    for k, inner in enumerate(names, 1):
        if inner not in ranges.columns:
            out = out.withColumn(inner, F.regexp_extract(name, regex, k))
    return out


def for_language(files: DataFrame, languages: list[str]) -> DataFrame:
    """Files of a rule's languages."""
    return files.filter(F.lower("language").isin([x.lower() for x in languages]))
