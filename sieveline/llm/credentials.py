"""Problem 3: credentials in source code, where they are and the code without them.

Token formats, key armour, connection strings, names that are given a value, schemes, login calls and options are grammars
of one deterministic automaton (llm/automaton.py). It reads each batch of texts once, in overlapping chunks whose states are
checked against each other; where a grammar is accepted its marks give the value's absolute span. Spans that start at one
name are one case, an inner span gives way to the one around it, and redaction splices a plain word over each span, inside
its quotes. A name counts by the words it ends in, which is part of the grammar, so an identifier is read once however long.

What the automaton accepts is confirmed by looking at the value alone: look-ups, masks and placeholders are none. A value is
a placeholder when it is made of plain words and one of them says so, a prompt or a field's name when it reads like one; a
value with a drawn part (letters and digits mixed, or letters whose case changes as in a drawn string) is neither.

Defined cases: null and empty texts hold nothing and stay as they are; a text of any length is read to its end; a row
delivered twice has its credentials twice, under its own identifiers; a value joined from pieces is one span from its
first piece to its last; a private key is one span from its BEGIN line to its END line, or to the end of its text.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.automaton import CHUNK, OVERLAP, Automaton, Hit
from sieveline.session import load

__all__ = ["CHUNK", "OVERLAP", "find", "redact", "spans", "splice"]
PLACEHOLDER = "REDACTED"

# The words credentials are named by. Those of the first list also count glued to other letters.
GLUED = ["password", "passwd", "passphrase", "passwort", "kennwort", "secret", "token", "pwd"]
APART = ["pass", "pw", "senha", "wachtwoord", "contrasena", "contraseña", "secrets", "credential", "credentials", "пароль"]
UNCASED = ["密码", "密碼", "パスワード"]
KEY_GLUED = ["api", "signing", "secret", "private", "access", "encryption", "auth", "account", "master", "client"]
KEY_OF = [*KEY_GLUED, "storage", "webhook", "service", "deploy", "session", "shared", "crypto", "aes", "hmac", "jwt", "decryption", "subscription"]
PHRASES = [("de", "passe"), ("clave", "secreta"), ("de", "acceso")]
# Formats of tokens: how they look, and the least length of what varies in them.
TOKENS = [
    (r"gh[pousr]_[A-Za-z0-9]+", 24), (r"github_pat_\w+", 31), (r"glpat-[\w-]+", 22), (r"[srp]k_(?:live|test)_[A-Za-z0-9]+", 24), (r"xox[bparse]-[\w-]+", 21), (r"(?:AKIA|ASIA)[A-Z0-9]{16}", 20), (r"AIza[\w-]+", 34), (r"eyJ[\w-]{6,}\.[\w-]{6,}(?:\.[\w-]*)?", 17),
    (r"npm_[A-Za-z0-9]+", 34), (r"SG\.[\w-]{16,}\.[\w-]{16,}", 36), (r"hf_[A-Za-z]+", 33), (r"pypi-[\w-]+", 55), (r"dop_v1_[a-f0-9]+", 47), (r"shpat_[a-f0-9]+", 34), (r"zk\.[A-Za-z0-9]{4,}\.[\w-]{16,}", 24), (r"ya29\.[\w-]+", 25), (r"sk-[A-Za-z0-9_-]+", 35),
]


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else re.escape(c) for c in word)


def _either(parts: Sequence[str]) -> str:
    """Alternatives with shared beginnings read once."""
    tree: dict[str, dict] = {}
    for part in parts:
        at = tree
        for c in part:
            at = at.setdefault(c, {})
        at[""] = {}

    def text(node: dict[str, dict]) -> str:
        branches = [re.escape(c) + text(below) for c, below in node.items() if c]
        if not branches:
            return ""
        whole = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{whole}?" if "" in node else whole

    return text(tree)


def _name() -> str:
    """An identifier that names a credential itself, not something about one: by its last word, in camel, snake or upper case."""
    ident, joint, loose = r"[\w$-]*", r"[_$-]+", r"[_$-]*"
    cap, up = str.capitalize, str.upper
    lower, upper = rf"(?:{ident}[\d_$-])?", rf"(?:{ident}(?:[^\WA-Z]|[$-]))?"
    ends = [ident + _either([f(w) for w in GLUED for f in (str, cap, up)] + [f(k + "key") for k in KEY_GLUED for f in (str, cap, up)] + [k + "Key" for k in KEY_GLUED])]
    ends += [lower + _either(APART + UNCASED), ident + _either([cap(w) for w in APART]), upper + _either([up(w) for w in APART])]
    for firsts, last in [(KEY_OF, "key"), *(([a], b) for a, b in PHRASES)]:
        small, caps, ups = _either(firsts), _either([cap(k) for k in firsts]), _either([up(k) for k in firsts])
        ends += [rf"{lower}{small}(?:{joint}{last}|{loose}{cap(last)}|{joint}{up(last)})", rf"{ident}{caps}(?:{joint}{last}|{loose}{cap(last)}|{loose}{up(last)})", rf"{upper}{ups}(?:{joint}{last}|{loose}{cap(last)}|{joint}{up(last)})"]
    ends.append(rf"{loose}(?:clave|Clave|CLAVE)")
    return rf"(?:{'|'.join(ends)}){loose}(?:\d+{loose})*"


def _quoted(before: str, after: str = "", marks: str = "\"'`") -> str:
    """A value in any of the quotes, with what stands before and behind the quotes."""
    return before + "(?:" + "|".join(rf"{q}((?:\\.|[^{q}\\\n])*){q}" for q in marks) + ")" + after


_EDGE = r"[^\w$-]"
_TO_LINE_END = r"[ \t]*(?:[\n\r\x03]|#|//)"
_PREFIX = r"[fFrRbBuU@$]{0,2}"
#: What follows a name, by kind; of those that begin at one name the first that holds decides.
AFTER_NAME = {
    "assigned": _quoted(r"[\"'`\]]{0,2}\s*(?::\s*[\w.\[\]<>|?]+\s*=|:=|=>|[=!]==?|=|:)\s*" + _PREFIX),
    "argument": _quoted(r"\s*\(\s*" + _PREFIX, r"\s*[,)+]"),
    "compared": _quoted(r"(?:\(\))?\.(?:equals|equalsIgnoreCase|Equals|compareTo|contentEquals|eq)\s*\(\s*" + _PREFIX),
    "element": r"(?:\s[^<>\n]*)?>\s*([^<>\s](?:[^<>\n]*[^<>\s])?)\s*</",
    "attribute": _quoted(r"[\"']\s+value\s*=\s*", marks="\"'"),
    "remark": r"(?:\s+(?:is|was|ist|est|es)\s*[:=]?\s|\s*[:=])\s*[\"'`]?([^\s\"'`\x03]+)[\s\"'`\x03]",
    "environment": r"[ \t]+([^\s\"'=\x03]+)[ \t]*[\n\r\x03]",
    "member": r"[\"']?:[ \t]+([^\s\"'`<>(){}\[\],;\x03]+)" + _TO_LINE_END,
    "plain": r"[\"']?=([^\s\"'`<>(){}\[\],;\x03]+)" + _TO_LINE_END,
}
RANK = {kind: k for k, kind in enumerate(AFTER_NAME)}
_COMMENT = r"(?:[\n\x02][ \t]*(?://|#|/\*|\*|--|;|<!--|%)|\s(?://|#|/\*|--)\s)[^\n]*"
CONTEXTS = {
    "comment": _COMMENT,
    "command": rf"(?:{'|'.join(map(_any_case, ('mysql', 'mariadb')))})\w*[^\w\n|;][^\n|;]*|(?:{'|'.join(map(_any_case, ('mysqladmin', 'sshpass', 'smbclient', 'ldapsearch')))})[^\w\n|;][^\n|;]*",
    "environment": r"[\n\x02][ \t]*(?:ENV|ARG|setenv|set)[ \t]+",
    "exported": r"[^\w](?:export|set|env|declare)[ \t]+(?:-\w+[ \t]+)?",
    "blank": r"[\n\x02][ \t]*",
    "defined": r"[^\w]def ",
}
#: Keys of connection strings made of key=value pairs, as they are written there.
_PAIR_KEYS = "|".join(map(_any_case, ("password", "pwd", "accountkey", "sharedaccesskey", "secretkey")))


def grammars() -> list[tuple]:
    token_edge = r"[^\w+/]"
    return [
        (list(AFTER_NAME), _EDGE, _name(), list(AFTER_NAME.values())),
        ("token", token_edge, f"({'|'.join(form for form, _ in TOKENS)})" + r"(?:[^\w-])"),
        ("piece", "", _quoted(r"[\"']\s*(?:\+|&|\.\.|\|\|)\s*", marks="\"'")),
        ("private", "", r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"),
        ("armour", "", r"(-----BEGIN [A-Z0-9 ]+-----)"),
        ("armour end", "", r"(-----END [A-Z0-9 ]+-----)"),
        ("address", "", r"://[^\s/@:'\"`<>\x03]*:([^\s/@'\"`<>\x03]+)@[\w.\-\[$%{]"),
        ("pairs", r"[^\w]", rf"[\w][\w .]*=[^;\"'`=\n\x03]*;(?:\s*[\w .]+=[^;\"'`=\n\x03]*;)*\s*(?:{_PAIR_KEYS})=([^;\"'`\s(){{}}\x03]+)[;\"'`\s\x03]"),
        ("basic", r"[^A-Za-z0-9]", _any_case("basic") + r"\s+([A-Za-z0-9+/_-]{8,}={0,2})[^A-Za-z0-9+/_=-]"),
        ("bearer", r"[^A-Za-z0-9]", _any_case("bearer") + r"\s+([A-Za-z0-9._~+/-]{12,}=*)[^A-Za-z0-9._~+/=-]"),
        ("call", "", rf"(?:\.(?:{'|'.join(map(_any_case, ('login', 'auth', 'open', 'connect', 'authenticate', 'signin')))})|{_any_case('credential')}[sS]?|{_any_case('basicauth')})\(\s*(?:\"[^\"'\n]*\"|'[^\"'\n]*')\s*,\s*" + _quoted("", r"(?:\s*\+\s*[\"'][^\"'\n]*[\"'])*\s*\)", "\"'")),
        ("user option", "", r"(?: -u|--user)[ =]?[\"']?[^\s:\"'/\x03]+:([^\s\"'\x03]+)[\s\"'\x03]"),
        ("pass option", "", r" -p[\"']?([^\s\"'\x03]+)[\s\"'\x03]"),
        ("note", "", _any_case("login") + r":\s*[^\s\x03]+\s+/\s+([^\s\x03]+)[\s\x03]"),
    ]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    """The automaton of all grammars; one per process, and what it has learnt of texts stays."""
    return Automaton(grammars(), CONTEXTS)


# What a value looks like that is none.
LOOKUP = re.compile(r"^(?:[$#@]?\{|\$\(|\$[A-Za-z_]|%[A-Za-z_]+%$|<.*>$|\{\{|\[\[|__\w+__$|env[.:(]|vault:|arn:|ssm:|file:|https?://|os\.|process\.|System\.|ENV\[|config\.|settings\.)", re.I)
MASK = re.compile(r"(.)\1{3,}|[*xX.•#_\-?]+")
FIELDISH = re.compile(r"^[A-Za-z_\-.\s]*$")
KEY_WORD = re.compile(r"(?:pass(?:word|wd|phrase|wort|e)?|pwd|pw|kennwort|contrase[nñ]a|clave|secreta?|senha|wachtwoord|пароль|密码|密碼|パスワード|token|credentials?|(?:api|signing|secret|private|access|encryption|auth|account|master|client|license|storage|webhook|service|deploy|session|shared|crypto|aes|hmac|jwt)key)$", re.I)
WORDS = re.compile(r"[^\W_]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Names in camel, snake or upper case, with dots: what an unquoted value looks like when it is code.
CODE = re.compile(r"(?:_*(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)(?:[_.]|$))+")
# Words of placeholders, words of prompts and notes, and values that are types or schemes.
STAND_IN = frozenset("your my the insert enter replace change put add set example sample dummy fake placeholder todo fixme tbd redacted removed hidden masked censored null none nil undefined true false na empty unset default foo bar abc test here changeme replaceme me".split())
SAYING = frozenset("enter type your the a an is are was must should can cannot not no please again new old for of to in and or with by wrong invalid missing required expired reset forgot forgotten confirm repeat choose does match".split())
PLAIN_WORDS = frozenset("bearer basic digest string str text hidden".split())


def drawn(word: str) -> bool:
    """A run of letters and digits as no one writes words: letters and digits mixed, or case that changes every other letter."""
    if len(word) >= 5 and re.search(r"\d", word) and len(re.findall(r"[A-Za-z]+|\d+", word)) > 2:
        return True
    return shuffled(word)


def shuffled(value: str) -> bool:
    """Letters whose case changes as in a drawn string: runs of one case are far shorter than in camel case."""
    runs = re.findall(r"[A-Z]+|[a-z]+", value)
    return len(value) >= 8 and bool(runs) and sum(map(len, runs)) / len(runs) < 2.8 and not value.isupper()


def stand_in(value: str) -> bool:
    """A mask, or plain words of which the first or the last is one of placeholders."""
    if MASK.fullmatch(value):
        return True
    words = WORDS.findall(value)
    if not words or any(drawn(w) for w in words):
        return False
    lower = [w.lower() for w in words]
    if "".join(lower) in STAND_IN:
        return True
    parts = [w.lower() for word in words for w in CAMEL.findall(word)]
    if any(len(p) == 1 and not p.isdigit() and p not in ("a", "x") for p in parts):  # letters on their own, as in drawn strings
        return False
    if lower[0] in STAND_IN or lower[-1] in STAND_IN:
        return True
    return bool(parts) and (parts[-1] in ("here", "placeholder", "changeme") or parts[-2:] == ["replace", "me"] or (parts[0] in STAND_IN and not any(p.isdigit() for p in parts)))


@lru_cache(maxsize=65536)
def is_secret(value: str) -> bool:
    """Not a look-up, a placeholder, a mask, a prompt, a note or the name of a field."""
    if len(value) < 3 or LOOKUP.match(value) or stand_in(value):
        return False
    if re.search(r"\s", value):  # a pass phrase: words that make no sentence
        words = [w.lower() for w in WORDS.findall(value)]
        return len(words) >= 3 and re.fullmatch(r"\S+(?: \S+)+", value) is not None and not set(words) & SAYING and not any(KEY_WORD.fullmatch(w) for w in words) and value[-1] not in ".:?!" and not re.search(r"[(){}<>=%$,;:\"']", value) and value == value.lower()
    if FIELDISH.match(value) and KEY_WORD.search(value.strip("_-. ")):
        return False
    return value.lower() not in PLAIN_WORDS


def plausible(value: str) -> bool:
    """A value that no name vouches for: also needs a digit, a mark or drawn letters, and mustn't be a path or an address."""
    telling = bool(re.search(r"[0-9!@#$%^&*]", value)) or shuffled(value)
    return is_secret(value) and not re.search(r"\s", value) and len(value) >= 6 and "/" not in value[:1] and "://" not in value and telling and not re.fullmatch(r"[\d.:,\-]+", value)


_CLOSED = re.compile(r"\s*\)")
_JOINTS = re.compile(r"[\"']\s*(?:\+|&|\.\.|\|\|)\s*[\"']")
_FORMS = [(re.compile(form), least) for form, least in TOKENS]


def _of_name(text: str, hit: Hit, context: frozenset[str], pieces: dict[int, int]) -> tuple[int, int] | None:
    """The span a name's value has, if it is a credential."""
    s, e = hit.open, hit.close
    if hit.kind in ("assigned", "argument", "compared"):
        if hit.kind == "argument" and (text[hit.start - 1 : hit.start] not in ("", "\n", ".", "\t", " ") or "defined" in context):
            return None
        last = _joined(e, pieces)
        if hit.kind == "argument" and not _CLOSED.match(text, last + 1):
            return None
        whole = text[s:last] if last == e else _JOINTS.sub("", text[s:last])
        return (s, last) if is_secret(whole) else None
    value = text[s:e]
    if hit.kind == "remark":
        if value.count(".") < 2:
            value = value.rstrip(".,;)")
        return (s, s + len(value)) if len(value) > 4 and (plausible(value) or (is_secret(value) and ":" in text[hit.start : s] or is_secret(value) and "=" in text[hit.start : s])) else None
    if hit.kind in ("member", "plain"):
        return (s, e) if is_secret(value) and not CODE.fullmatch(value) else None
    return (s, e) if is_secret(value) else None


def _fits(text: str, hit: Hit, context: frozenset[str]) -> bool:
    """Does a name's grammar hold in the place it was found at?"""
    before = text[hit.start - 1 : hit.start]
    if hit.kind == "element":
        return before == "<"
    if hit.kind == "attribute":
        return before in ("'", '"') and before != ""
    if hit.kind == "remark":
        return "comment" in context
    if hit.kind == "environment":
        return "environment" in context
    if hit.kind == "plain":
        return before not in (" ", "\t") or "blank" in context or "exported" in context
    return True


def _joined(end: int, pieces: dict[int, int]) -> int:
    """Where the last piece added to a literal ends whose value ends at `end`."""
    while end in pieces:
        end = pieces[end]
    return end


def _alone(text: str, hit: Hit, context: frozenset[str], pieces: dict[int, int]) -> tuple[int, int] | None:
    """The span of a grammar that needs no name."""
    s, e, kind = hit.open, hit.close, hit.kind
    value = text[s:e]
    if kind == "token":
        if not any(len(value) >= least and form.fullmatch(value) for form, least in _FORMS) or stand_in(value):
            return None
        return (s, _joined(e, pieces)) if text[e : e + 1] in ("'", '"') else (s, e)
    if kind in ("address", "pairs"):
        return (s, e) if is_secret(value) else None
    if kind == "basic":
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8", "strict")
        except (binascii.Error, ValueError):
            return None
        _, colon, secret = plain.partition(":")
        return (s, e) if colon and is_secret(secret) else None
    if kind == "bearer":
        return (s, e) if plausible(value) else None
    if kind == "call":
        return (s, _joined(e, pieces)) if plausible(value) else None
    if kind == "user option":
        return (s, e) if is_secret(value) else None
    if kind == "pass option":
        return (s, e) if "command" in context and is_secret(value) and not re.fullmatch(r"\d{2,5}", value) else None
    return (s, e) if kind == "note" and "comment" in context and plausible(value) else None


def _read(text: str, hits: list[Hit], contexts) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials among the matches of a text, in order and apart from each other."""
    pieces = {h.start: h.close for h in hits if h.kind == "piece"}
    ends = sorted({h.close for h in hits if h.kind == "armour end"})
    found: dict[int, tuple[int, int, str]] = {}

    def keep(span: tuple[int, int] | None, kind: str) -> None:
        if span and (span[0] not in found or span[1] > found[span[0]][1]):
            found[span[0]] = (*span, kind)

    def closed(start: int) -> int:
        k = bisect_right(ends, start)
        return ends[k] if k < len(ends) else len(text)

    private = {h.open for h in hits if h.kind == "private"}
    public = [(h.open, closed(h.close)) for h in hits if h.kind == "armour" and h.open not in private]
    by_name: dict[int, list[Hit]] = {}
    for h in hits:
        if h.kind in RANK:
            by_name.setdefault(h.start, []).append(h)
        elif h.kind == "private":
            keep((h.open, closed(h.close)), "private key")
        elif h.kind not in ("piece", "armour", "armour end"):
            keep(_alone(text, h, contexts(h.start), pieces), h.kind)
    for start, held in by_name.items():
        context = contexts(start)
        fitting = [h for h in held if _fits(text, h, context)]
        if fitting:
            # An unquoted value goes as far as it may, so that a '#' in it doesn't end it.
            first = min(fitting, key=lambda h: (RANK[h.kind], -h.close if h.kind in ("member", "plain") else h.close))
            keep(_of_name(text, first, context, pieces), first.kind)
    out: list[tuple[int, int, str]] = []
    k = 0
    public.sort()
    for s, e, kind in sorted(found.values(), key=lambda h: (h[0], -h[1])):
        while k < len(public) and public[k][1] <= s:
            k += 1
        if (not out or s >= out[-1][1]) and not (k < len(public) and public[k][0] <= s):
            out.append((s, e, kind))
    return out


def all_spans(texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
    """The credentials of each text of a batch."""
    a = automaton()
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held = [k for k, t in enumerate(texts) if t]
    for k, classes, states in a.states([texts[k] for k in held]):
        if hits := a.hits(classes, states):
            out[held[k]] = _read(texts[held[k]], hits, lambda at, states=states: a.contexts[states[at]])
    return out


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials of a text, 0-based, in order and apart from each other."""
    return all_spans([text])[0]


def splice(text: str, where: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder over each span; what surrounds a span stays, so quotes still close."""
    out, at = [], 0
    for s, e, _ in where:
        out += [text[at:s], PLACEHOLDER]
        at = e
    return "".join([*out, text[at:]])


SPAN = "record_id bigint, field_name string, start_pos int, end_pos int, kind string"
_SPAN_TYPES = pa.schema([("record_id", pa.int64()), ("field_name", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string())])


def find(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """One row per credential; start_pos is 1-based, end_pos the last character's. fields: name -> column or expression."""
    names = list(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for k, name in enumerate(names, 1):
                for i, where in zip(ids, all_spans(batch.column(k).to_pylist()), strict=True):
                    for s, e, kind in where:
                        for col, x in zip(cols, (i, name, s + 1, e, kind), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPAN_TYPES.types, strict=True)], schema=_SPAN_TYPES)

    texts = [F.expr(e).cast("string").alias(f"_t{k}") for k, e in enumerate(fields.values())]
    return df.select(F.col(record_id).cast("bigint").alias("_id"), *texts).mapInArrow(scan, SPAN)


def redact(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """(record_id, field_name, redacted, credentials) of every text that holds a credential."""
    names = list(fields)
    schema = pa.schema([("record_id", pa.int64()), ("field_name", pa.string()), ("redacted", pa.string()), ("credentials", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for k, name in enumerate(names, 1):
                texts = batch.column(k).to_pylist()
                for i, text, where in zip(ids, texts, all_spans(texts), strict=True):
                    if where:
                        rows.append((i, name, splice(text, where), len(where)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    texts = [F.expr(e).cast("string").alias(f"_t{k}") for k, e in enumerate(fields.values())]
    return df.select(F.col(record_id).cast("bigint").alias("_id"), *texts).mapInArrow(scan, "record_id bigint, field_name string, redacted string, credentials int")


FIELDS = {"code_snippet": "code_snippet", "context.lines": "context.lines"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(load(spark, sf_dir, "findings"), "finding_id", FIELDS).select(F.col("record_id").alias("finding_id"), "field_name", "start_pos")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(load(spark, sf_dir, "findings"), "finding_id", FIELDS).withColumnRenamed("record_id", "finding_id")


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
