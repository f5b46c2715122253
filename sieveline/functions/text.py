"""Scalar expressions over text, paths and places (projections 11, 12, 16, 19 to 23; functions E2, E5, E9, E11, E12)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_SHAPE = r"^[a-f0-9\-]{36}$"
ENDPOINT_SHAPE = r"^https?://[a-zA-Z0-9.:\-/?=&]+$"


def trim_all(text: Column, unicode: bool = False) -> Column:
    """Without any white space at the ends; Spark's trim would leave tabs and line ends."""
    return F.regexp_replace(text, (r"(?U)" if unicode else "") + r"^\s+|\s+$", "")


def occurrences(text: Column, part: str | Column) -> Column:
    """Non-overlapping occurrences of a part."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(part) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def basename(path: Column) -> Column:
    """What follows the last separator of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-case ending with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def location(path: Column, line: Column, column: Column) -> Column:
    """file:line:column of a finding (projection 11)."""
    return F.concat_ws(":", basename(path), line.cast("string"), column.cast("string"))


def fingerprint(rule_id: Column, place: Column) -> Column:
    """The md5 of rule and place (projection 12, E9). Two files of one name in different folders share it."""
    return F.md5(F.concat_ws(":", rule_id, place))


def absolute(path: Column, folder: str) -> Column:
    """A relative path below a folder, without '.' and '..' steps and doubled separators (projection 16)."""
    joined = F.when(path.rlike(r"^(?:/|[A-Za-z]:)"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    plain = F.regexp_replace(F.regexp_replace(joined, r"/(?:\./)+", "/"), r"/{2,}", "/")
    # Steps up take away what stands before them; above the root there is nothing to take.
    step = lambda way, x: F.when(x != "..", F.array_append(way, x)).otherwise(F.slice(way, 1, F.greatest(F.size(way) - 1, F.lit(1))))
    climbed = F.array_join(F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(plain.rlike(r"/\.\.(?:/|$)"), F.when(climbed == "", F.lit("/")).otherwise(climbed)).otherwise(plain)


def label(text: Column, width: int = 30) -> Column:
    """The first characters, with three dots when more follow (projection 19)."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def duration_text(start_ms: Column, end_ms: Column) -> Column:
    """Whole seconds as 'Ns', 'N/A' while either end is missing (projection 20)."""
    return F.when(start_ms.isNull() | end_ms.isNull(), F.lit("N/A")).otherwise(F.concat(F.floor((end_ms - start_ms) / 1000).cast("string"), F.lit("s")))


def rfc3339(instant: Column, fraction: bool = False) -> Column:
    """An instant as text with its offset, the seconds' fraction without closing zeros if asked for."""
    if not fraction:
        return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ssXXX")
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.regexp_replace(F.regexp_replace(whole, r"(\.\d*?)0+(Z|[+-]\d\d:\d\d)$", "$1$2"), r"\.(Z|[+-])", "$1")


def fresh_id() -> Column:
    """A random identifier of the shape valid_id() tests (projection 24); every evaluation draws a new one."""
    return F.expr("uuid()")


def progress(done: Column, total: Column) -> Column:
    """Percent, halves rounded up, 0 of nothing (projection 21)."""
    return F.when(total > 0, F.floor(done * 100.0 / total + 0.5)).otherwise(F.lit(0)).cast("int")


def category_key(category: Column) -> Column:
    """What stands before ' - ' in a category (projection 22)."""
    return F.element_at(F.split(category, " - "), 1)


def category_name(category: Column) -> Column:
    """What stands behind the first ' - ' in a category, null without one (projection 22)."""
    return F.try_element_at(F.split(category, " - "), F.lit(2))


def valid_id(value: Column) -> Column:
    """Has an identifier the shape of a UUID (projection 23)?"""
    return F.coalesce(value.rlike(UUID_SHAPE), F.lit(False))


def valid_endpoint(value: Column) -> Column:
    """Has an address the shape of a plain HTTP one (projection 23)?"""
    return F.coalesce(value.rlike(ENDPOINT_SHAPE), F.lit(False))


def valid_output(path: Column) -> Column:
    """Is a path a JSON file's that doesn't climb (projection 23)?"""
    return F.coalesce(path.endswith(".json") & ~F.contains(path, F.lit("..")), F.lit(False))


# What an escape letter takes as its argument, if anything.
_ARGUMENTS = {
    "p": re.compile(r"\{[^}]*\}|."), "P": re.compile(r"\{[^}]*\}|."), "x": re.compile(r"\{[^}]*\}|[0-9a-fA-F]{2}"), "u": re.compile(r"[0-9a-fA-F]{4}"), "N": re.compile(r"\{[^}]*\}"),
    "0": re.compile(r"[0-7]{1,3}"), "c": re.compile(r".", re.S), "k": re.compile(r"<[^>]*>"), "g": re.compile(r"\{[^}]*\}|<[^>]*>"), "b": re.compile(r"\{g\}"),
}
_QUANTIFIER = re.compile(r"(?:\*|\?|\+|\{\d+(?:,\d*)?\})[?+]?")
_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.S)


def required_literal(pattern: str) -> str | None:
    """A lower-case text every match of a pattern holds, if a plain reading of the pattern shows one of 3 letters or more.

    Read are literal characters outside groups and classes; escapes go with their arguments and quantifiers with their
    bounds, and what a quantifier repeats or lets out is none. Alternatives, quoted stretches, flags that change letters
    or spacing, nested classes and anything unreadable give None: there is no safe text then.
    """
    if "|" in pattern or "\\Q" in pattern or "&&" in pattern or re.search(r"\(\?[a-zA-Z-]*[xuU]", pattern):
        return None
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, lit, step = pattern[i], None, 1
        if c == "\\":
            letter = pattern[i + 1 : i + 2]
            step = 2
            if letter.isalnum():
                held = _ARGUMENTS[letter].match(pattern, i + 2) if letter in _ARGUMENTS else None
                step += len(held[0]) if held else 0
                if letter.isdigit() and letter != "0":  # a back-reference of any length
                    step += len(re.match(r"\d*", pattern[i + 2 :])[0])
            else:
                lit = letter
        elif c == "[":
            held = _CLASS.match(pattern, i)
            if not held or "[" in held[0][1:]:
                return None
            step = len(held[0])
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c in "{}":
            return None  # a brace that is no quantifier's; those are read below
        elif c not in ".^$*+?":
            lit = c
        i += step
        quantifier = _QUANTIFIER.match(pattern, i)
        i += len(quantifier[0]) if quantifier else 0
        if lit is not None and not depth and (not quantifier or quantifier[0][0] == "+"):
            run += lit
        if quantifier or lit is None or depth:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len, default="")
    return best.lower() if len(best) >= 3 and best.isascii() else None
