"""Problem 4: files nobody wrote by hand - generated, minified, vendored, or data kept as code.

Re-Pair grammars over token sequences give the candidates, an exact check confirms them:

* comment lines: one grammar over all distinct comment shapes of the corpus, inferred to its end. Rules that several files
  use speak for generation (banners), rules that several repositories share for vendoring, where they cover most of a line;
* code lines: one grammar over the sequences of code lines. A stretch of many tokens that repositories share is vendored;
* long code lines: a grammar of each line's own tokens. High rule reuse among terse names speaks for minification;
* long literals: a grammar of their characters. What no rule makes shorter speaks for a data blob;
* the path speaks for itself.

Defined cases: rows without file_path name no file; null and empty snippets say nothing; a path is judged as written,
with its folders and its snippets together; repeated rows change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut, discard, hot_split_join, load

#: From what size on a line, a literal and a table of numbers are told from ordinary ones: a line of 60 characters holds some
#: 24 tokens of terse code; the longest checksum written out, SHA-512 in hexadecimal, has 128 characters.
LONG_LINE, LONG_LITERAL, LONG_ARRAY = 60, 130, 40
#: The part of a banner that rules of several files must cover, and the tokens of a stretch of code that repositories share.
REUSED, SHARED_TOKENS = 0.5, 60
JOINT = "\x01"

# Folders and endings that tools and package managers use.
GENERATED_PATH = (
    r"(?:^|/)(?:generated|__generated__|auto-?_?gen(?:erated)?|generated-(?:sources|src|test-sources)|gen|gen-src|codegen|obj/(?:debug|release)|dist)/"
    r"|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw|\.validate)?\.(?:go|cc|h|c|cpp|swift|dart)$|\.(?:g|g\.i|gen|generated|designer|auto|freezed)\.\w+$|[-_.]generated\.\w+$|(?:^|/)zz_generated"
    r"|\.min\.\w+$|[-_]min\.(?:m?js|cjs|css)$|\.(?:bundle|chunk|packed)\.(?:[0-9a-f]{6,}\.)?(?:m?js|cjs|css)$"
)
VENDORED_PATH = (
    r"(?:^|/)(?:vendor|vendored|vendors|third[-_]?party|3rd[-_]?party|node_modules|bower_components|jspm_packages|pods|carthage|site-packages|dist-packages|\.?venv|virtualenv|externals?|deps|_deps|godeps|\.cargo|\.m2)/"
    r"|/[a-z][\w.+-]*-v?\d+\.\d+(?:\.\d+)*/"
)
GENERATED_TEXT = (
    r"(?i)(?:code|file|source|class|module|sources?)\s+(?:is|was|are|were|has been|have been)?\s*(?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written|emitted)\s+(?:by|from|with|using)\b"
    r"|^\W*(?:auto|machine)[- ]?(?:generated|written|created|produced)\b|<auto-?generated|@generated\b|^\W*generated\s+(?:by|from|with|using|on|code|file)\b|automatically\s+(?:generated|produced|created|written)"
    r"|auto-?generated\s+(?:by|from|with|file|code)|^\W*do not edit(?:\s+(?:by hand|manually|this file|directly))?\W*$|sourcemappingurl="
    r"|(?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt)|(?:généré|produit|créé)\s+(?:automatiquement|par)|(?:generado|creado)\s+autom[aá]ticamente|gerado\s+automaticamente|generato\s+automaticamente"
    r"|自動生成|自动生成|自動產生|자동\s*생성|сгенерирован|создан автоматически|สร้างโดยอัตโนมัติ|स्वतः\s*(?:निर्मित|जनित)|أُنشئ تلقائي|تم إنشاؤه تلقائي"
)
VENDORED_TEXT = (
    r"(?i)^\W*!?\s*[\w@/.+-]+\s+v?\d[\w.]*\s*\|\s*(?:\(c\)|©|copyright|https?:)|@license\b|@preserve\b|third[- ]party\s+(?:copy|code|library|source|module)|(?:copied|taken|imported|vendored|bundled)\s+(?:unchanged|verbatim|unmodified|as[- ]is)?\s*from\s+(?:upstream|https?:|the upstream)"
    r"|^\W*vendored\b\s*(?::|from|copy|by)|part of (?:the )?[\w.+-]+ project\W+\s*(?:local|bundled|vendored) copy|report bugs upstream|bundled\s+(?:copy|third)"
)
DENIED = r"(?i)nothing (?:here )?is generated|not (?:auto)?generated|rewritten from scratch"
COMMENT_LINE = r"^\s*(?://|#|/\*|\*|--|;|<!--|%|@Generated\b|'''|\"\"\"|\[(?:assembly: )?(?:System\.CodeDom\.Compiler\.)?GeneratedCode)"
WORKSPACE = r"^(?:[a-z]:)?(?:\./|/?(?:srv/scan|home/ci/work|build|home/[^/]+(?:/work)?|workspace|src|tmp|var/lib/[^/]+)/)?"


def symbols_left(seq: Sequence[Hashable]) -> tuple[list[int], dict[int, tuple[int, int]], int]:
    """Re-Pair of one sequence: (what is left of it, its rules, how often rules are used).

    All pairs that are counted at least as often as both their neighbours are replaced at once, until no pair is left that
    stands twice: a sort per round and rounds that grow with the logarithm of the longest phrase, in arrays of the
    sequence's own size, so a literal of many megabytes is read whole in bounded memory.
    """
    if isinstance(seq, str):
        seq = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
    else:
        code: dict[Hashable, int] = {}
        seq = np.fromiter((code.setdefault(s, len(code)) for s in seq), np.int64)
    first = np.unique(seq, return_index=True)[1]
    named = np.empty(len(first), np.int64)
    named[np.argsort(first, kind="stable")] = np.arange(len(first))  # symbols are numbered as they are met
    now = named[np.unique(seq, return_inverse=True)[1]] if len(seq) else np.zeros(0, np.int64)
    fresh, rules, used = len(first), {}, 0
    while len(now) > 1:
        pairs, which, counts = np.unique(now[:-1] * fresh + now[1:], return_inverse=True, return_counts=True)
        n = counts[which]
        around = np.concatenate([[0], n, [0]])
        best = (n > 1) & (n >= around[:-2]) & (n >= around[2:])
        # Of candidates side by side every other one, from the left.
        at = np.arange(len(best))
        run = at - np.maximum.accumulate(np.where(best, -1, at))
        picked = np.flatnonzero(best & (run % 2 == 1))
        kept, back, times = np.unique(which[picked], return_inverse=True, return_counts=True)
        picked = picked[times[back] > 1]
        if not len(picked):
            break
        made, back = np.unique(which[picked], return_inverse=True)
        for k, pair in enumerate(pairs[made].tolist()):
            rules[fresh + k] = divmod(pair, fresh)
        now = now.copy()
        now[picked] = fresh + back
        gone = np.ones(len(now), bool)
        gone[picked + 1] = False
        now, fresh, used = now[gone], fresh + len(made), used + len(picked)
    return now.tolist(), rules, used


def reuse(tokens: Sequence[Hashable]) -> float:
    """The part of a token sequence that its own grammar saves."""
    left, rules, _ = symbols_left(tokens)
    return 1 - (len(left) + 2 * len(rules)) / len(tokens) if len(tokens) else 0.0


def incompressible(symbols: Sequence[Hashable]) -> float:
    """Bits of the grammar against bits of the sequence; near or above 1 where rules save nothing."""
    kinds = len(set(symbols))
    if kinds < 2:
        return 0.0
    left, rules, _ = symbols_left(symbols)
    return (len(left) + 2 * len(rules)) * math.log2(kinds + len(rules)) / (len(symbols) * math.log2(kinds))


TOKENS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
LITERALS = re.compile(r"\"((?:\\.|[^\"\\\n]){%d,})\"|'((?:\\.|[^'\\\n]){%d,})'|`([^`]{%d,})`" % ((LONG_LITERAL,) * 3))
NUMBERS = re.compile(r"[\[{(]\s*((?:-?(?:0[xX][0-9a-fA-F]+|\d+)[uUlL]*\s*,\s*){%d,}-?(?:0[xX][0-9a-fA-F]+|\d+)?[uUlL]*)" % (LONG_ARRAY - 1))
KEYWORDS = frozenset("if else for while do return function var let const new in of this null true false void throw try catch switch case break continue typeof delete class import export default".split())


def is_minified(line: str) -> bool:
    """Many statements, hardly a space, names of a letter or two, and a grammar that uses its rules again and again."""
    bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', line.strip())
    if len(bare) < LONG_LINE or bare.count(" ") > 0.12 * len(bare):
        return False
    tokens = TOKENS.findall(bare)
    names = [t for t in tokens if (t[0].isalpha() or t[0] in "_$") and t not in KEYWORDS]
    marks = sum(t in ";{},()" for t in tokens)
    if len(tokens) < 24 or len(names) < 8 or marks < 6:
        return False
    short = sum(len(t) <= 2 for t in names) / len(names)
    shape = ["i" if (t[0].isalpha() or t[0] in "_$") and t not in KEYWORDS else "0" if t[0].isdigit() else "s" if t[0] in "\"'" else t for t in tokens]
    return short >= 0.6 and reuse(shape) >= 0.05


def is_blob(text: str) -> bool:
    """A long literal of the base64 or hex alphabet, or a long table of numbers, that no grammar makes shorter."""
    for m in LITERALS.finditer(text):
        body = (m[1] or m[2] or m[3]).replace("\\n", "")
        if "-----BEGIN" in body or re.match(r"(?:Bearer\s+)?eyJ[\w-]+\.", body):
            continue
        body = re.sub(r"^data:[\w/+.;=-]*,", "", body)
        packed = re.fullmatch(r"(?:\\x[0-9a-fA-F]{2})+|[A-Za-z0-9+/_=-]+", body)
        if packed and len(body) >= LONG_LITERAL and incompressible(body) >= 0.85 and re.search(r"\d", body):
            return True
    return any(len(n) >= LONG_ARRAY and incompressible("".join(f"{v & 0xFFFFFFFF:x}".zfill(2) for v in n)) >= 0.8 for n in ([int(x, 0) for x in re.findall(r"0[xX][0-9a-fA-F]+|[1-9]\d*|\b0\b", m[1])] for m in NUMBERS.finditer(text)))


def _long_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[tuple[str, str], None] = {}
        for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for line in {text, *text.split("\n")}:
                if len(line) >= LONG_LINE and is_minified(line):
                    rows[path, "minified"] = None
            if is_blob(text):
                rows[path, "blob"] = None
        paths, signs = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(signs, pa.string())], names=["file_path", "sign"])


def normal_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\+", "/"))


def repository(path: Column) -> Column:
    """The folder below the workspace a path starts with."""
    return F.regexp_extract(F.regexp_replace(normal_path(path), WORKSPACE, ""), r"^([^/]+)/", 1)


def corpus_grammar(seqs: DataFrame) -> DataFrame:
    """(key, toks, rules): the Re-Pair grammar of all sequences (key, toks, weight) together, inferred to its end.

    A round counts adjacent symbols over the corpus, a sequence as often as its weight says, and replaces everywhere at once
    the pairs counted more than once and at least as often as both their neighbours. It ends when no sequence gets shorter.
    toks are what is left of a sequence, a rule being written as its phrase; rules are all phrases met on the way.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, toks, rules, weights, counts = (c.to_pylist() for c in batch.columns)
            for k, (t, c) in enumerate(zip(toks, counts, strict=True)):
                n = [0] * len(t)
                for x in c:
                    if x["pos"] is not None:
                        n[x["pos"]] = x["n"]
                out, got, i = [], list(rules[k]), 0
                while i < len(t):
                    if i + 1 < len(t) and n[i] > 1 and n[i] >= n[i + 1] and (n[i] >= n[i - 1] if i else True):
                        out.append(t[i] + JOINT + t[i + 1])
                        got.append(out[-1])
                        i += 2
                    else:
                        out.append(t[i])
                        i += 1
                toks[k], rules[k] = out, list(dict.fromkeys(got))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(toks, pa.list_(pa.string())), pa.array(rules, pa.list_(pa.string())), pa.array(weights, pa.int64())], names=["key", "toks", "rules", "weight"])

    def measured(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = cut(df.observe(seen, F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("n")), "grammar")
        return out, seen.get["n"]

    now, size = measured(seqs.select("key", "toks", F.array().cast("array<string>").alias("rules"), F.col("weight").cast("bigint").alias("weight")))
    while True:
        steps = F.expr("case when size(toks) > 1 then transform(sequence(1, size(toks) - 1), i -> struct(i - 1 as pos, toks[i - 1] as a, toks[i] as b)) end")
        pairs = now.select("key", "weight", F.explode(steps).alias("p")).select("key", "weight", "p.pos", "p.a", "p.b")
        counts = cut(pairs.groupBy("a", "b").agg(F.sum("weight").alias("n"), F.count("*").alias("uses")).filter("n > 1"), "pair-counts")
        told = hot_split_join(pairs, counts, ["a", "b"], "uses").groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("c"))
        none = F.array().cast("array<struct<pos:int,n:bigint>>")
        joined = now.join(told, "key", "left").select("key", "toks", "rules", "weight", F.coalesce("c", none).alias("c"))
        new, left = measured(joined.mapInArrow(rewrite, "key string, toks array<string>, rules array<string>, weight bigint"))
        discard(now)
        discard(counts)
        now = new
        if left == size:
            return now.select("key", "toks", "rules")
        size = left


def coverage(made: DataFrame, known: DataFrame) -> DataFrame:
    """(key, by_files, by_repos, longest): which parts of a sequence's tokens lie in rules that several files, and several
    repositories, use, and the most tokens such a shared rule holds. known: key with the ends p0, p1 of its files' and r0, r1
    of its repositories' order, which tell whether there are several without counting them."""
    uses = made.select("key", F.explode("rules").alias("rule"))
    spread = uses.join(known, "key").groupBy("rule").agg((F.min("p0") < F.max("p1")).alias("reused"), (F.min("r0") < F.max("r1")).alias("shared"), F.count("*").alias("uses"))
    size = lambda c: F.aggregate(F.split(c, JOINT), F.lit(0), lambda n, s: n + F.coalesce(F.try_to_number(F.regexp_extract(s, "\x02(\\d+)$", 1), F.lit("999999")).cast("int"), F.lit(1)))
    parts = made.select("key", F.explode("toks").alias("rule")).withColumn("size", size(F.col("rule")))
    rules = hot_split_join(parts.filter(F.contains("rule", F.lit(JOINT))), cut(spread, "rules"), ["rule"], "uses")
    whole = parts.groupBy("key").agg(F.sum("size").alias("tokens"))
    told = rules.groupBy("key").agg(F.sum(F.when(F.col("reused"), F.col("size")).otherwise(0)).alias("f"), F.sum(F.when(F.col("shared"), F.col("size")).otherwise(0)).alias("r"), F.max(F.when(F.col("shared"), F.col("size")).otherwise(0)).alias("longest"))
    return whole.join(told, "key").select("key", (F.col("f") / F.col("tokens")).alias("by_files"), (F.col("r") / F.col("tokens")).alias("by_repos"), F.col("longest").cast("int").alias("longest"))


def comment_lines(lines: DataFrame) -> DataFrame:
    """Distinct (file_path, key): the shapes of comment lines, numbers left out."""
    comment = F.when(F.col("line").rlike(COMMENT_LINE), F.col("line")).otherwise(F.nullif(F.regexp_extract("line", r"\s((?://|#|/\*)\s.*)$", 1), F.lit("")))
    shape = F.translate(F.regexp_replace(F.lower(F.trim(comment)), r"\p{N}+", "0"), JOINT, " ")
    return lines.select("file_path", shape.alias("key")).filter("key is not null").distinct()


def spread_of(held: DataFrame) -> DataFrame:
    """(key, files, p0, p1, r0, r1) of distinct (file_path, key)."""
    repo = repository(F.col("file_path"))
    return held.groupBy("key").agg(F.count("*").alias("files"), F.min("file_path").alias("p0"), F.max("file_path").alias("p1"), F.min(repo).alias("r0"), F.max(repo).alias("r1"))


def comment_signs(lines: DataFrame, reused: float = REUSED, phrases: bool = True) -> DataFrame:
    """(file_path, sign) of the files whose comment lines (file_path, line) are banners of tools or libraries.

    A shape is a candidate when rules that several files (several repositories) use cover the part `reused` of it; the exact
    check of its wording follows. phrases=False leaves the check out, to measure what it adds.
    """
    held = cut(comment_lines(lines), "comments")
    known = cut(spread_of(held), "shapes")
    seqs = known.select("key", F.expr(r"regexp_extract_all(key, '[\\p{L}\\p{M}]+|[^\\s\\p{L}\\p{M}]', 0)").alias("toks"), F.col("files").alias("weight"))
    told = coverage(corpus_grammar(seqs), known)
    says = lambda words: F.col("key").rlike(words) & ~F.col("key").rlike(DENIED) if phrases else F.lit(True)
    sign = F.when((F.col("by_files") >= reused) & says(GENERATED_TEXT), "generated").when((F.col("by_repos") >= reused) & says(VENDORED_TEXT), "vendored")
    banners = told.withColumn("sign", sign).filter("sign is not null").join(known.select("key", "files"), "key").select("key", "sign", "files")
    return hot_split_join(held, cut(banners, "banners"), ["key"], "files").select("file_path", "sign")


def shared_code(rows: DataFrame, least: int = SHARED_TOKENS) -> DataFrame:
    """(file_path, sign) of files with a stretch of code lines, of `least` tokens or more, that several repositories have.

    The sequences are a snippet's code lines, each a symbol that knows how many tokens it holds; comment and blank lines are
    left out. Rules of the corpus grammar over them are stretches of adjacent lines.
    """
    bare = F.filter(F.transform(F.split("code", r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), lambda x: (x != "") & ~x.rlike(COMMENT_LINE))
    symbols = F.transform(bare, lambda x: F.concat(F.md5(x), F.lit("\x02"), F.size(F.regexp_extract_all(x, F.lit(r"\w+|[^\s\w]"), F.lit(0))).cast("string")))
    each = rows.filter(F.contains("code", F.lit("\n")) | F.contains("code", F.lit("\r"))).select("file_path", symbols.alias("toks")).filter("size(toks) > 1")
    held = cut(each.select("file_path", F.md5(F.array_join("toks", ",")).alias("key"), "toks").distinct(), "code-lines")
    known = cut(spread_of(held.select("file_path", "key")), "code-shapes")
    seqs = held.groupBy("key").agg(F.first("toks").alias("toks"), F.count("*").alias("weight"))
    told = coverage(corpus_grammar(seqs), known).filter(F.col("longest") >= least).join(known.select("key", "files"), "key").select("key", "files")
    return hot_split_join(held.select("file_path", "key"), cut(told, "shared-code"), ["key"], "files").select("file_path", F.lit("vendored").alias("sign"))


def path_signs(paths: DataFrame) -> DataFrame:
    """(file_path, sign) of the paths that tools and package managers write."""
    p = normal_path(F.col("file_path"))
    inside = F.regexp_replace(p, WORKSPACE, "")
    return paths.select("file_path", F.when(inside.rlike(VENDORED_PATH), "vendored").when(inside.rlike(GENERATED_PATH), "generated").alias("sign")).filter("sign is not null")


def machine_made(df: DataFrame, path: str, snippet: str, phrases: bool = True) -> DataFrame:
    """(file_path, signs): every distinct path that shows a sign, with the signs it shows."""
    rows = df.select(F.expr(path).alias("file_path"), F.expr(snippet).alias("code")).filter("file_path is not null")
    lines = rows.filter("code <> ''").select("file_path", F.explode(F.split("code", r"\r\n|\r|\n")).alias("line"))
    code = rows.filter(F.length("code") >= LONG_LINE).mapInArrow(_long_code, "file_path string, sign string")
    signs = path_signs(rows.select("file_path").distinct()).unionByName(comment_signs(lines, phrases=phrases)).unionByName(shared_code(rows)).unionByName(code)
    return signs.groupBy("file_path").agg(F.sort_array(F.collect_set("sign")).alias("signs"))


def p4_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_made(load(spark, sf_dir, "findings"), "context.file_path", "code_snippet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_signs(spark, sf_dir).select("file_path")


QUERIES = {"p4_signs": p4_signs, "p4_found": p4_found}
