"""Problem 9: sentence units of documents in many scripts.

Structure first: fenced blocks, headings and list items are one unit each, a blank line ends a unit. Inside a paragraph
a mark ends a sentence by the rules of its script; where a full stop could be an abbreviation's, the document decides:
a word that elsewhere in it has a stop before a small letter or a comma, and never goes without one, is an abbreviation,
one that elsewhere in it goes without a stop amid a sentence is an ordinary word, a capitalised word that elsewhere in it
stands amid a sentence is a name. Where the document doesn't say, the corpus does: words whose stop never ends a unit, or is
mostly followed by small letters, and words whose stop mostly does end one, counted over all documents. Only where both are
silent a short list of fixed abbreviations speaks.

Each document is read once: split as if the corpus said nothing, with the words it would have been asked about and what its
own stops say for others. Only documents that asked about a word the corpus then knows are split again. Nothing of the
corpus travels with the tasks but the few words a document asked about.

Defined cases: null, empty and blank texts (byte-order marks included) have no units; an opening quote or bracket that
never closes within its paragraph is ignored; an open fence runs to the end of the text; \\r\\n, \\r and \\n are line ends;
repeated documents have their units repeated; texts and words of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut, hot_split_join, load

#: Parts that the units of one text are spread over where they are compared with the texts to be split again.
SALT = 16
UNIT = "doc_id bigint, unit_no int, start_pos int, end_pos int, sentence string"

# Abbreviations by what may follow them. Before a name; before a number; inside any sentence.
TITLES = frozenset("mr mrs ms dr prof sr sra srta dra don m mm mme mlle st hr fr herr gen sen rep capt lt col sgt rev hon डॉ श्री श्रीमती г-н г-жа".split())
NUMBERED = frozenset("nr fig figs sec secs vol ch eq eqs ref refs p pp pg art arts abb tab kap abs s n° núm num pág págs стр рис п пп гл табл σελ αρ εικ max min ca approx aprox circa jan feb mar apr jun jul aug sep sept oct nov dec v ver".split())
#: Those that are ordinary words in small letters.
CAPITAL = frozenset("No Nos NO".split())
INSIDE = frozenset("e.g i.e eg ie cf vs viz incl excl esp resp bzw ggf evtl inkl exkl vgl sog z.b d.h u.a s.o s.u i.d.r p.ex c.-à-d p.ej т.е т.к напр см тыс млн млрд δηλ βλ π.χ".split())
LISTED = TITLES | NUMBERED | INSIDE | {w.lower() for w in CAPITAL}
#: Words a German ordinal stands behind.
ORDINAL_BEFORE = frozenset("der die das den dem des am im zum zur vom beim bis ab seit ein eine einen einem einer jeder jede jedes diese dieser diesem".split())

PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "［": "］", "{": "}"}
CLOSERS = frozenset("”“»›」』）)]】》〉］}\"")
WIDE = frozenset("。！？｡．")
ALWAYS = frozenset("।॥؟۔。！？｡")
QUESTION = frozenset(";;")
QUOTATIVE = re.compile(r"[」』”）〉》]*(?:と|って|という|との)")
EVENT = re.compile(r"[.!?…。！？｡।॥؟۔]+|[;;](?=\s|$)|[“„«‹「『（(\[【《〈［{\"”»›」』）)\]】》〉］}]|(?<=[ก-๎])\s+(?=[ก-๎])")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
FENCE = re.compile(r"[\s﻿]*(`{3,}|~{3,})")
HEADING = re.compile(r"[\s﻿]{0,4}#{1,6}(?:\s|$)")
ITEM = re.compile(r"[\s﻿]*(?:[-*+•‣◦▪·–]|\(?\d{1,4}[.)]|\(?(?:[A-Za-z]|[ivx]{1,5})\))[ \t]+\S")
RULER = re.compile(r"\s*(?:[-=_*]\s*){3,}$")
WORD = re.compile(r"[^\W_]+(?:[.’'\-][^\W_]+)*", re.U)
OPENING = frozenset("([{«“„\"‘（「")
CODE_START = re.compile(r"[a-z_$][\w$]*(?:\.[\w$]+|\(|_|::|/[\w.])", re.A)
SHORT_STOP = re.compile(r"\s([^\W\d_]{1,3})\.")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
STOPPED = re.compile(r"(?<![\w.])([^\W\d_][^\W\d_.\-]*(?:[.\-][^\W\d_]+)*)\.(?=([\s,;:)]*)(\S?))")
AMID = re.compile(r"(?<=[a-zà-öø-ÿа-яё,] )([A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*)(?![\w.])")
NAME = re.compile(r"(?<=[a-zà-öø-ÿа-яё,] )([A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+)")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the units and paragraphs of a text; whole: one unit whatever it holds."""
    at, size = 0, len(text)
    start, kind = None, ""
    while at < size:
        m = LINE.match(text, at)
        line, after = m[0], m.end()
        bare = line.strip().strip("﻿").strip()
        if not bare:
            if start is not None:
                yield start, at, kind == "item"
            start, kind = None, ""
        elif fence := FENCE.match(line):
            if start is not None:
                yield start, at, kind == "item"
            end = after
            while end < size:
                m = LINE.match(text, end)
                end = m.end()
                if m[0].strip().startswith(fence[1][:3]) and not m[0].strip().strip(fence[1][0]):
                    break
            yield at, end, True
            start, kind, after = None, "", end
        elif HEADING.match(line):
            if start is not None:
                yield start, at, kind == "item"
            yield at, after, True
            start, kind = None, ""
        elif RULER.match(line) and len(bare) >= 3:
            if start is not None:
                yield start, at, kind == "item"
            yield at, after, True
            start, kind = None, ""
        elif kind != "text" and ITEM.match(line):
            if start is not None:
                yield start, at, True
            start, kind = at, "item"
        elif start is None:
            start, kind = at, "text"
        at = after
    if start is not None:
        yield start, size, kind == "item"


def _case(ch: str) -> str:
    """'l' small, 'u' capital, 'c' a letter without case, 'd' digit, else 'o'."""
    if ch.isdigit():
        return "d"
    if ch.isalpha():
        return "l" if ch.islower() else "u" if ch.isupper() or ch.istitle() else "c"
    return "o"


class Evidence:
    """What the full stops of a text say about the words before them, by word as written."""

    def __init__(self) -> None:
        self.stops, self.ends, self.small, self.digits, self.capitals = (Counter() for _ in range(5))
        self.words: Counter[str] = Counter()

    def read(self, part: str) -> None:
        """Take in a paragraph."""
        for m in STOPPED.finditer(part):
            w = m[1]
            self.stops[w] += 1
            self.capitals[w] += w[0].isupper()
            self.digits[w] += m[3].isdigit()
            if m.end() == len(part) or not m[3]:
                self.ends[w] += 1
            elif (m[2].strip() and m[2][0] in ",;:") or (m[2] and _case(m[3]) == "l" and not CODE_START.match(part, m.end(2))):
                self.small[w] += 1
        self.words.update(WORD.findall(part))

    def add(self, other: Evidence) -> None:
        for mine, its in zip(self._all(), other._all(), strict=True):
            mine.update(its)

    def _all(self) -> tuple[Counter[str], ...]:
        return self.stops, self.ends, self.small, self.digits, self.capitals, self.words


class Reader:
    """Splits paragraphs of one document; abbreviations and names come from it first, then from the corpus, then from the lists.

    known, plain: what the corpus says of words the document may ask about. asked: those it did ask about."""

    def __init__(self, text: str, known: frozenset[str] = frozenset(), plain: frozenset[str] = frozenset()):
        self.text, self.known, self.plain = text, known, plain
        self.asked: set[str] = set()
        self.evidence = Evidence()
        self._own: frozenset[str] | None = None
        self._names: frozenset[str] | None = None
        self._amid: Counter[str] | None = None

    @property
    def abbreviations(self) -> frozenset[str]:
        """Words of the document, in small letters, with a stop inside a sentence and never without one."""
        if self._own is None:
            stopped = {w.lower() for w, n in self.evidence.small.items() if n}
            if stopped:
                free: Counter[str] = Counter()
                for sign, counts in ((1, self.evidence.words), (-1, self.evidence.stops)):
                    for w, n in counts.items():
                        if (low := w.lower()) in stopped:
                            free[low] += sign * n
                stopped = {w for w in stopped if free[w] <= 0}
            self._own = frozenset(stopped)
        return self._own

    @property
    def names(self) -> frozenset[str]:
        if self._names is None:
            self._names = frozenset(NAME.findall(self.text))
        return self._names

    def _without_stop(self, word: str) -> int:
        """How often the document has the word amid a sentence without a stop."""
        if not word[:1].isupper():
            return self.evidence.words[word] - self.evidence.stops[word]
        if self._amid is None:
            self._amid = Counter(AMID.findall(self.text))
        return self._amid[word]

    def ordinary(self, word: str) -> bool:
        """Is a listed word none of an abbreviation here: by the document, else by the corpus?"""
        if self.evidence.small[word] or self.evidence.digits[word] > 1:
            return False
        if self._without_stop(word) > 0:
            return True
        self.asked.add("=" + word)
        return word in self.plain

    def abbreviation(self, low: str) -> bool:
        """Is an unlisted word an abbreviation to the corpus?"""
        self.asked.add(low)
        return low in self.known

    def _listed(self, word: str, low: str, joined: str, after: int, kind: str, ch: str) -> bool:
        """Does a list say that the stop is inside a sentence?"""
        if low in INSIDE or joined in INSIDE:
            return True
        if len(low) <= 2 and low.isalpha() and not joined and (m := SHORT_STOP.match(self.text, after)):
            # The first half of an abbreviation in two parts: single letters, capitals, or a known one.
            if (len(low) == 1 == len(m[1])) or (word.isupper() and m[1].isupper()) or f"{low}.{m[1].lower()}" in INSIDE:
                return True
        if low in TITLES and kind in "uc":
            return True
        numbered = low in NUMBERED or word in CAPITAL
        return numbered and (kind in "dl" or (ch in "(§#" and len(low) > 1))

    def _stop_ends(self, start: int, mark: int, after: int, nxt: int) -> bool:
        """Does a single full stop at `mark` end the sentence, when text goes on at `nxt` after white space?"""
        text, ch = self.text, self.text[nxt]
        kind = _case(ch)
        k = mark
        while k > start and text[k - 1] not in OPENING and not text[k - 1].isspace():
            k -= 1
        word = text[k:mark]
        word = re.split(r"[’'](?=[^\W\d_]{2})", word)[-1]
        low = word.lower().strip(".,;:")
        if m := re.search(r"([^\W\d_]{1,3})\.\s?$", text[max(start, mark - len(word) - 6) : mark - len(word)]):
            joined = f"{m[1].lower()}.{low}"
        else:
            joined = ""
        if self._listed(word, low, joined, after, kind, ch) and not (low in LISTED and not joined and self.ordinary(word)):
            return False
        if word.isdigit() and len(word) <= 3 and kind == "u":
            z = mark - len(word)
            while z > start and text[z - 1].isspace():
                z -= 1
            a = z
            while a > start and text[a - 1].isalpha():
                a -= 1
            if z < mark - len(word) and text[a:z].lower() in ORDINAL_BEFORE:
                return False
        last = next((c for c in reversed(text[start:mark]) if c.isalnum()), "")
        if kind == "l" and _case(last) != "c":
            return bool(CODE_START.match(text, nxt)) and not re.match(r"(?:[^\W\d_]\.){2,}", text[nxt : nxt + 8]) and low not in self.abbreviations and not self.abbreviation(low)
        if kind in "du":
            own, follower = low in self.abbreviations, WORD.match(text, nxt)
            if kind == "u" and own and follower and follower[0] in self.names:
                return False
            if self.abbreviation(low) and (kind == "d" or follower):
                return False
        return not (len(word) == 1 and word.isupper() and kind == "u")

    def split(self, start: int, end: int) -> Iterator[int]:
        """The ends of the sentences of the paragraph text[start:end]."""
        text = self.text
        events = list(EVENT.finditer(text, start, end))
        closes: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in events:
            c = m[0]
            if len(c) == 1:
                if c == '"':
                    if any(o == c for o, _ in stack):
                        while stack and stack[-1][0] != c:
                            stack.pop()
                        closes[stack.pop()[1]] = m.start()
                    else:
                        stack.append((c, m.start()))
                elif any(c in PAIRS.get(o, "") for o, _ in stack):
                    while c not in PAIRS.get(stack[-1][0], ""):
                        stack.pop()
                    closes[stack.pop()[1]] = m.start()
                elif c in PAIRS:
                    stack.append((c, m.start()))
        begin, inside = start, -1
        while begin < end and (text[begin].isspace() or text[begin] == "﻿"):
            begin += 1
        for m in events:
            at, c = m.start(), m[0]
            if at < inside or at < begin and not c.isspace():
                continue
            if at in closes:
                inside = closes[at]
                if not (at == inside):
                    opened = at
                continue
            closing = at == inside
            if c.isspace():
                yield at
                begin = m.end()
                continue
            if closing:
                inside = -1
                before = text[at - 1] if at else ""
                k = at - 1
                while k > opened and (text[k].isspace()):
                    k -= 1
                before = text[k]
                if before not in ".!?…。！？｡।॥؟۔":
                    continue
                whole = opened == begin
            elif c in CLOSERS or c in PAIRS:
                continue
            else:
                whole = None
            after = m.end()
            while after < end and text[after] in CLOSERS and whole is None and after not in closes and text[after] != '"':
                after += 1
            nxt = after
            while nxt < end and (text[nxt].isspace() or text[nxt] == "﻿"):
                nxt += 1
            if nxt >= end:
                break
            ch = text[nxt]
            if whole is not None:
                if nxt == after:
                    done = whole and bool(CJK.match(text, at - 1) or CJK.match(text, nxt) or before in WIDE) and not QUOTATIVE.match(text, at) and not EVENT.match(text, nxt)
                    done = done or (whole and before in WIDE and ch in PAIRS)
                else:
                    kind = _case(ch)
                    done = kind != "l" and (whole or kind in "ud" or (kind == "o" and ch not in ",;:-–—"))
                    if kind == "l" and whole and CODE_START.match(text, nxt):
                        done = True
            elif c in QUESTION:
                done = bool(GREEK.search(text, begin, at))
            elif nxt == after:
                last = c[-1]
                wide = c[0] in WIDE or last in WIDE
                cjk = bool(at and CJK.match(text, at - 1))
                done = (wide or (cjk and c[0] in "!?…")) and ch not in "、，,；;：:"
                done = done or (c[0] in ALWAYS and ch.isalpha())
                if c[0] == "…" and not cjk:
                    done = False
            elif c[0] in ALWAYS or c[0] in WIDE:
                done = True
            else:
                kind = _case(ch)
                last = next((x for x in reversed(text[begin:at]) if x.isalnum()), "")
                if c == ".":
                    done = at > begin and not text[at - 1].isspace() and self._stop_ends(begin, at, after, nxt)
                    if at > begin and text[at - 1].isspace():
                        done = kind != "l"
                elif kind == "l" and _case(last) != "c":
                    done = bool(CODE_START.match(text, nxt)) and not re.match(r"(?:[^\W\d_]\.){2,}", text[nxt : nxt + 8])
                else:
                    done = ch not in ",;:"
            if done:
                yield after
                begin = nxt
        yield end


def split_text(text: str | None, known: frozenset[str] = frozenset(), plain: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int]], Reader | None]:
    """((start, end) of the sentence units of a text, 0-based, without white space around them; its reader)."""
    if not text:
        return [], None
    reader, out = Reader(text, known, plain), []

    def keep(a: int, b: int) -> None:
        while a < b and (text[a].isspace() or text[a] == "\ufeff"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] == "\ufeff"):
            b -= 1
        if a < b:
            out.append((a, b))

    parts = list(blocks(text))
    for start, end, whole in parts:
        if not whole:
            reader.evidence.read(text[start:end].rstrip())
    for start, end, whole in parts:
        if whole:
            keep(start, end)
            continue
        at = start
        for stop in reader.split(start, end):
            keep(at, stop)
            at = stop
    return out, reader


def units(text: str | None, known: frozenset[str] = frozenset(), plain: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    return split_text(text, known, plain)[0]


COUNTS = ("stops", "ends", "small", "digits", "capitals", "free")
READ = "k bigint, doc_id bigint, unit_no int, start_pos int, end_pos int, sentence string, asked string, word string, " + ", ".join(f"{c} bigint" for c in COUNTS)
_READ_TYPES = [("k", pa.int64()), ("doc_id", pa.int64()), ("unit_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("sentence", pa.string()), ("asked", pa.string()), ("word", pa.string()), *((c, pa.int64()) for c in COUNTS)]


def _table(cols: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in _READ_TYPES], names=[c for c, _ in _READ_TYPES])


def _said(e: Evidence) -> Iterator[pa.RecordBatch]:
    """Evidence as rows: by words in small letters, and for listed words as they are written ('=' before them)."""
    sums: dict[str, list[int]] = {}
    for w in e.stops.keys() | e.words.keys():
        free = max(0, e.words[w] - e.stops[w])
        row = [e.stops[w], e.ends[w], e.small[w], e.digits[w], e.capitals[w], free]
        low = w.lower()
        for key in (low, "=" + w) if low in LISTED else (low,):
            old = sums.get(key)
            sums[key] = [a + b for a, b in zip(old, row, strict=True)] if old else row
    yield _table({"word": list(sums), **{c: [r[k] for r in sums.values()] for k, c in enumerate(COUNTS)}}, len(sums))


def _first_reading(texts: bool):
    """Units as the document alone gives them, the words it asked about, and partial counts of what stops say."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Evidence()
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("k", "doc_id", "unit_no", "start_pos", "end_pos", "sentence")}
            asked: dict[str, list] = {c: [] for c in ("k", "asked")}
            for k, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans, reader = split_text(text)
                found["k"] += [k] * len(spans)
                found["doc_id"] += [i] * len(spans)
                found["unit_no"] += range(1, len(spans) + 1)
                found["start_pos"] += [a + 1 for a, _ in spans]
                found["end_pos"] += [b for _, b in spans]
                found["sentence"] += [text[a:b] for a, b in spans] if texts else [None] * len(spans)
                if reader:
                    asked["k"] += [k] * len(reader.asked)
                    asked["asked"] += reader.asked
                    total.add(reader.evidence)
            yield _table(found, len(found["k"]))
            yield _table(asked, len(asked["k"]))
            if len(total.words) > 200_000:
                yield from _said(total)
                total = Evidence()
        yield from _said(total)

    return read


def corpus_words(read: DataFrame) -> DataFrame:
    """(word, stops, known): words of the corpus that are abbreviations (known) or, of the listed ones, ordinary words.

    An abbreviation's full stop never ends a unit (of 50 or more), while it is capitalised or mostly before small letters and
    digits, or is mostly before small letters (of 10). An ordinary word's mostly ends one (of 20), seldom before such.
    """
    sums = read.filter("word is not null").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    telling = (F.col("capitals") >= 0.9 * F.col("stops")) | (F.col("small") + F.col("digits") >= 0.5 * F.col("stops"))
    never = (F.col("stops") >= 50) & (F.col("ends") <= 0.01 * F.col("stops")) & telling
    mostly = (F.col("stops") >= 10) & (F.col("small") >= 0.5 * F.col("stops"))
    listed = F.col("word").startswith("=")
    known = ~listed & (never | mostly) & (F.col("free") <= 0.05 * F.col("stops"))
    plain = listed & (F.col("stops") >= 20) & (F.col("ends") >= 0.3 * F.col("stops")) & (F.col("small") + F.col("digits") < 0.3 * F.col("stops"))
    return sums.filter(known | plain).select("word", "stops", known.alias("known"))


def split_documents(docs: DataFrame, doc_id: str, text: str, texts: bool = False) -> DataFrame:
    """(doc_id, unit_no, start_pos, end_pos, sentence) of every unit, 1-based, in order. texts: with the sentences themselves, else null."""
    rows = docs.select(F.xxhash64(F.col(text)).alias("k"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    read = cut(rows.mapInArrow(_first_reading(texts), READ), "first-reading")
    corpus = cut(corpus_words(read), "corpus-words")
    asked = read.filter("asked is not null").select("k", F.col("asked").alias("word"))
    told = hot_split_join(asked, corpus, ["word"], "stops")
    words = lambda known: F.collect_set(F.when(F.col("known") == known, F.col("word")))
    again = cut(told.groupBy("k").agg(words(True).alias("known"), words(False).alias("plain"), F.count("*").alias("uses")), "read-again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t, known, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, (a, b) in enumerate(units(t, frozenset(known), frozenset(w[1:] for w in plain)), 1):
                    for col, x in zip(cols, (i, n, a + 1, b, t[a:b] if texts else None), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "unit_no", "start_pos", "end_pos", "sentence"])

    second = hot_split_join(rows, again, ["k"], "uses").select("doc_id", "text", "known", "plain").mapInArrow(run, UNIT)
    # A text may be a third of all documents: its units are spread over SALT parts.
    first = read.filter("unit_no is not null").withColumn("s", F.pmod("start_pos", F.lit(SALT)))
    gone = again.select("k", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    return first.join(gone, ["k", "s"], "left_anti").select("doc_id", "unit_no", "start_pos", "end_pos", "sentence").unionByName(second)


def p9_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its text."""
    return split_documents(load(spark, sf_dir, "documents"), "doc_id", "text", texts=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "start_pos")


QUERIES = {"p9_found": p9_found, "p9_units": p9_units}
