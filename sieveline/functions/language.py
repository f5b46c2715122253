"""Language detection by name, by content and by graph (projections 1 to 5; compositions X6)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import extension, occurrences

# The endings, keywords, imports, node types and data types of each language, in the order ties resolve.
EXTENSIONS = {"java": [".java"], "cpp": [".cpp", ".cc", ".cxx", ".c++", ".hpp", ".h", ".c"], "python": [".py", ".py3", ".pyw"], "javascript": [".js", ".jsx", ".ts", ".tsx", ".mjs"], "csharp": [".cs"]}
KEYWORDS = {
    "java": ["public", "private", "protected", "class", "interface", "package", "import"],
    "cpp": ["std::", "#include", "#define", "namespace", "using"],
    "python": ["def", "class", "import", "from", "__init__", "if __name__"],
    "javascript": ["function", "var", "let", "const", "class", "import", "require"],
    "csharp": ["using", "namespace", "class", "public", "private", "static"],
}
IMPORTS = {"java": ["java.", "javax.", "org.springframework"], "cpp": ["iostream", "vector", "string", "algorithm"], "python": ["os", "sys", "json", "requests", "flask", "django"], "javascript": ["require", "express", "react", "lodash", "axios"], "csharp": ["System", "Microsoft", "Newtonsoft"]}
NODE_TYPES = {"java": ["PACKAGE", "CLASS", "INTERFACE", "METHOD"], "cpp": ["FUNCTION", "STRUCT", "CLASS", "NAMESPACE"], "python": ["FUNCTION_DEF", "CLASS_DEF", "IMPORT"], "javascript": ["FUNCTION_DECLARATION", "CLASS_DECLARATION", "IMPORT_DECLARATION"], "csharp": ["CLASS", "METHOD", "NAMESPACE"]}
DATA_TYPES = {"java": ["String", "Integer", "List", "Map", "Set"], "cpp": ["int", "char", "double", "float", "bool", "void"], "python": ["str", "int", "list", "dict", "set"], "javascript": ["string", "number", "boolean", "object", "array"], "csharp": ["string", "int", "bool", "double", "var"]}
WEB_EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby"}
CONTENT_WINDOW = 1024
DEFAULT_EXTENSION = ".txt"


def _look_up(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))[key]


def known_extensions() -> list[str]:
    return [e for exts in EXTENSIONS.values() for e in exts]


def by_extension(path: Column) -> Column:
    """The language an ending belongs to, null for others (projection 1)."""
    return _look_up({e: lang for lang, exts in EXTENSIONS.items() for e in exts}, extension(path))


def web_by_extension(path: Column) -> Column:
    """The upload form's languages; 'unknown' for others, names without a dot included (projection 2)."""
    return F.coalesce(_look_up(WEB_EXTENSIONS, extension(path)), F.lit("unknown"))


def extension_for(language: Column) -> Column:
    """A language's first ending, '.txt' for unknown ones (projection 5)."""
    return F.coalesce(_look_up({lang: exts[0] for lang, exts in EXTENSIONS.items()}, language), F.lit(DEFAULT_EXTENSION))


def keyword_scores(content: Column) -> dict[str, Column]:
    """How often a language's keywords stand in the first characters, by language."""
    head = F.lower(F.substring(content, 1, CONTENT_WINDOW))
    return {lang: sum((occurrences(head, w) for w in words), F.lit(0)) for lang, words in KEYWORDS.items()}


def by_content(content: Column, none: str = "unknown") -> Column:
    """The language with most keywords; ties go to the first in order, no keyword at all is `none` (projection 3)."""
    scores = keyword_scores(F.coalesce(content, F.lit("")))
    best = F.greatest(*scores.values())
    return F.when(best == 0, F.lit(none)).otherwise(F.coalesce(*(F.when(s == best, F.lit(lang)) for lang, s in scores.items())))


def detect(path: Column, content: Column) -> Column:
    """By ending, else by content; without content 'unknown' (X6)."""
    return F.coalesce(by_extension(path), by_content(content))


def by_graph(graphs: DataFrame) -> DataFrame:
    """(scan_id, language, score) of graphs (scan_id, language, types, names, imports, data_types as sets), projection 4.

    A language the graph states wins. Else a shared node type counts 3, an import that an import name is part of 2, a
    name among the keywords 2, a data type 1; ties go to the first in order, no point at all is 'unknown'.
    """
    words = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    point = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    scores = {}
    for lang in KEYWORDS:
        hit = F.lit(False)
        for part in IMPORTS[lang]:
            hit = hit | F.array_contains(F.transform("imports", _has(part)), True)
        scores[lang] = point(F.arrays_overlap("types", words(NODE_TYPES[lang])), 3) + point(hit, 2) + point(F.arrays_overlap("names", words(KEYWORDS[lang])), 2) + point(F.arrays_overlap("data_types", words(DATA_TYPES[lang])), 1)
    best = F.greatest(*scores.values())
    found = F.when(best == 0, F.lit("unknown")).otherwise(F.coalesce(*(F.when(s == best, F.lit(lang)) for lang, s in scores.items())))
    return graphs.select("scan_id", F.coalesce(F.lower("language"), found).alias("language"), best.alias("score"))


def _has(part: str):
    return lambda x: F.contains(x, F.lit(part))
