"""One deterministic automaton for many grammars, run over whole batches of texts at once.

Grammars are regular expressions without look-around or back-references. All of them together become one nondeterministic
automaton with marks: where a grammar starts, where its value begins and ends, where it is accepted, and contexts, which say
what a place lies in. It is made deterministic as texts demand it: a state is the set of all places in all grammars a text
may be at, and a step that has been taken once is a table entry.

A batch is cut into overlapping chunks that lie side by side in a matrix, and one table look-up moves all chunks on by one
character. A chunk starts before its own stretch; where its state there isn't the one that the chunk before it arrives at, the
chunk is read again from the true state until both agree, so the result is that of one run over the whole text, whatever its
length. Marks are read off by walking back from where a grammar was accepted, over that match alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as sre

import numpy as np

BEGIN, END = "\x02", "\x03"
CHUNK, OVERLAP = 4096, 256
CELLS = 1 << 21
CLASSES = 256
MOST_STATES = 20_000


@dataclass(frozen=True)
class Hit:
    """A match: its kind, where its grammar starts, and its value [open, close)."""

    kind: str
    start: int
    open: int
    close: int


class Automaton:
    """grammars: (kind, lead, body): the lead is read before the place that counts as the start; the group of the body is the
    value. A body may be shared: (kinds, lead, body, tails) with one tail a kind. contexts: name -> pattern, which holds at
    the places where it has just been read."""

    def __init__(self, grammars: Sequence[tuple], contexts: dict[str, str]):
        self.sets: list[tuple] = []
        self._set_ids: dict[tuple, int] = {}
        self.step: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.role: list[tuple[str, str] | None] = []
        self.root = self._node()
        for grammar in grammars:
            if len(grammar) == 3:
                kind, lead, body = grammar
                self._accept(self._build(body, self._start(lead)), kind)
            else:
                kinds, lead, body, tails = grammar
                after = self._build(body, self._start(lead))
                for kind, tail in zip(kinds, tails, strict=True):
                    self._accept(self._build(tail, after), kind)
        for name, pattern in contexts.items():
            self.role[self._build(pattern, self._fork(self.root))] = ("context", name)
        self.back_free: list[list[int]] = [[] for _ in self.step]
        self.back_step: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for a, targets in enumerate(self.free):
            for b in targets:
                self.back_free[b].append(a)
        for a, moves in enumerate(self.step):
            for s, b in moves:
                self.back_step[b].append((a, s))
        self._closure: dict[int, frozenset[int]] = {}
        self.context_names = list(contexts)
        self.class_of = np.full(0x110000, 255, np.uint8)
        self._class_ids: dict[tuple[bool, ...], int] = {}
        self.holds: list[tuple[bool, ...]] = []
        self._reset()

    # The nondeterministic automaton.

    def _node(self) -> int:
        self.step.append([])
        self.free.append([])
        self.role.append(None)
        return len(self.step) - 1

    def _fork(self, a: int, role: tuple[str, str] | None = None) -> int:
        b = self._node()
        self.free[a].append(b)
        self.role[b] = role
        return b

    def _start(self, lead: str) -> int:
        return self._fork(self._build(lead, self._fork(self.root)), ("start", ""))

    def _accept(self, a: int, kind: str) -> None:
        self._fork(a, ("accept", kind))

    def _set(self, items: tuple) -> int:
        if items not in self._set_ids:
            self._set_ids[items] = len(self.sets)
            self.sets.append(items)
        return self._set_ids[items]

    def _build(self, pattern: str, at: int) -> int:
        return self._sequence(sre.parse(pattern), at)

    def _sequence(self, parts, at: int) -> int:
        for code, arg in parts:
            if code in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
                items = (code, arg) if code in (op.LITERAL, op.NOT_LITERAL) else (code,) if code is op.ANY else (code, tuple(arg))
                nxt = self._node()
                self.step[at].append((self._set(items), nxt))
                at = nxt
            elif code is op.SUBPATTERN:
                group, _, _, inner = arg
                if group is not None:
                    at = self._fork(at, ("open", ""))
                at = self._sequence(inner, at)
                if group is not None:
                    at = self._fork(at, ("close", ""))
            elif code is op.BRANCH:
                end = self._node()
                for branch in arg[1]:
                    self.free[self._sequence(branch, self._fork(at))].append(end)
                at = end
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inner = arg
                for _ in range(low):
                    at = self._sequence(inner, at)
                if high is op.MAXREPEAT:
                    loop = self._fork(at)
                    self.free[self._sequence(inner, loop)].append(loop)
                    at = self._fork(loop)
                else:
                    end = self._node()
                    self.free[at].append(end)
                    for _ in range(high - low):
                        at = self._sequence(inner, at)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"no part of a regular grammar: {code}")
        return at

    def _reach(self, a: int) -> frozenset[int]:
        """A node with all it leads to without reading anything."""
        if a not in self._closure:
            seen, todo = {a}, [a]
            while todo:
                for b in self.free[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            self._closure[a] = frozenset(seen)
        return self._closure[a]

    # Its deterministic form, made as it is needed.

    def _reset(self) -> None:
        self.members: list[frozenset[int]] = []
        self.state_ids: dict[frozenset[int], int] = {}
        self.table = np.full(CLASSES * 512, -1, np.int32)
        self.accepts: list[list[int]] = []
        self.contexts: list[frozenset[str]] = []
        self._flags = np.zeros(512, bool)
        self._state(self._reach(self.root))

    def _state(self, nodes: frozenset[int]) -> int:
        k = self.state_ids.get(nodes)
        if k is None:
            k = self.state_ids[nodes] = len(self.members)
            self.members.append(nodes)
            roles = [(n, self.role[n]) for n in nodes if self.role[n]]
            self.accepts.append(sorted(n for n, r in roles if r[0] == "accept"))
            self.contexts.append(frozenset(r[1] for _, r in roles if r[0] == "context"))
            if (k + 1) * CLASSES > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
                self._flags = np.concatenate([self._flags, np.zeros(len(self._flags), bool)])
            self._flags[k] = bool(self.accepts[-1])
        return k

    def _move(self, state: int, cls: int) -> int:
        key = state * CLASSES + cls
        if self.table[key] < 0:
            holds = self.holds[cls]
            nodes = set(self._reach(self.root))  # a grammar may start anywhere
            for a in self.members[state]:
                for s, b in self.step[a]:
                    if holds[s]:
                        nodes |= self._reach(b)
            made = self._state(frozenset(nodes))
            self.table[key] = made
        return int(self.table[key])

    def _has(self, items: tuple, ch: str) -> bool:
        code, *rest = items
        point = ord(ch)
        if code is op.LITERAL:
            return point == rest[0]
        if code is op.NOT_LITERAL:
            return point != rest[0]
        if code is op.ANY:
            return ch != "\n"
        inside, negated = False, False
        for kind, arg in rest[0]:
            if kind is op.NEGATE:
                negated = True
            elif kind is op.LITERAL:
                inside |= point == arg
            elif kind is op.RANGE:
                inside |= arg[0] <= point <= arg[1]
            else:
                word, space, digit = ch.isalnum() or ch == "_", ch.isspace(), ch.isdecimal()
                inside |= {op.CATEGORY_WORD: word, op.CATEGORY_NOT_WORD: not word, op.CATEGORY_SPACE: space, op.CATEGORY_NOT_SPACE: not space, op.CATEGORY_DIGIT: digit, op.CATEGORY_NOT_DIGIT: not digit}[arg]
        return inside != negated

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """The class of each character: characters no grammar tells apart share one."""
        out = self.class_of[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]).tolist():
                holds = tuple(self._has(s, chr(p)) for s in self.sets)
                if holds not in self._class_ids:
                    if len(self.holds) == 255:
                        raise ValueError("more than 255 classes of characters")
                    self._class_ids[holds] = len(self.holds)
                    self.holds.append(holds)
                self.class_of[p] = self._class_ids[holds]
            out = self.class_of[points]
        return out

    def _run(self, rows: np.ndarray) -> np.ndarray:
        """The states of all rows of classes after each of their characters: one look-up a column."""
        columns = np.ascontiguousarray(rows.T)
        out = np.empty(columns.shape, np.int32)
        now = np.zeros(columns.shape[1], np.int32)
        for k in range(len(columns)):
            keys = now * CLASSES + columns[k]
            now = self.table.take(keys)
            if now.min() < 0:
                for key in np.unique(keys[now < 0]).tolist():
                    self._move(*divmod(key, CLASSES))
                now = self.table.take(keys)
            out[k] = now
        return np.ascontiguousarray(out.T)

    def _long(self, text: np.ndarray) -> np.ndarray:
        """The states of a text of many chunks."""
        starts = range(0, len(text), CHUNK)
        width = CHUNK + OVERLAP
        rows = np.full((len(starts), width), text[-1], np.uint8)
        for r, at in enumerate(starts):
            piece = text[max(0, at - OVERLAP) : at + CHUNK]
            rows[r, : len(piece)] = piece
        out = np.empty(len(text), np.int32)
        parts = max(1, CELLS // width)
        for first in range(0, len(starts), parts):
            found = self._run(rows[first : first + parts])
            for r, at in enumerate(starts[first : first + parts]):
                skip = at - max(0, at - OVERLAP)
                stop = min(len(text), at + CHUNK)
                mine = found[r, skip : skip + stop - at]
                if at:
                    true, said = int(out[at - 1]), int(found[r, skip - 1])
                    k = 0
                    while true != said and k < len(mine):  # read again until the runs agree
                        true, said = self._move(true, int(text[at + k])), int(mine[k])
                        mine[k] = true
                        k += 1
                out[at:stop] = mine
        return out

    def states(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position of the text, its classes, its states); the k-th state is that before the k-th character, the last one
        that behind the end."""
        if len(self.members) > MOST_STATES:
            self._reset()
        points = np.frombuffer("".join(f"{BEGIN}{t}{END}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self._classes(points)
        ends = np.cumsum([len(t) + 2 for t in texts])
        order = np.argsort([len(t) for t in texts], kind="stable").tolist()
        batch: list[int] = []

        def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            width = len(texts[batch[-1]]) + 2
            rows = np.full((len(batch), width), classes[ends[batch[0]] - 1], np.uint8)
            for r, k in enumerate(batch):
                n = len(texts[k]) + 2
                rows[r, :n] = classes[ends[k] - n : ends[k]]
            found = self._run(rows)
            for r, k in enumerate(batch):
                n = len(texts[k]) + 2
                yield k, rows[r, :n], found[r, :n]

        for k in order:
            n = len(texts[k]) + 2
            if n > CHUNK:
                text = classes[ends[k] - n : ends[k]]
                yield k, text, self._long(text)
            else:
                if batch and (len(batch) + 1) * n > CELLS:
                    yield from flush()
                    batch = []
                batch.append(k)
        if batch:
            yield from flush()

    def hits(self, classes: np.ndarray, states: np.ndarray) -> list[Hit]:
        """All matches of a text, in the order of their ends."""
        out = []
        for j in np.flatnonzero(self._flags[states]).tolist():
            for node in self.accepts[states[j]]:
                if (hit := self._trace(classes, states, j, node)) is not None:
                    out.append(hit)
        return out

    def _trace(self, classes: np.ndarray, states: np.ndarray, j: int, node: int) -> Hit | None:
        """Walk back from an accepting place over the places it was reached by: the earliest start, the value's last end and,
        for that end, its earliest beginning."""
        start = opened = closed = None
        nodes = {node}
        while True:
            members = self.members[states[j]]
            todo = list(nodes)
            while todo:
                for a in self.back_free[todo.pop()]:
                    if a not in nodes and a in members:
                        nodes.add(a)
                        todo.append(a)
            for n in nodes:
                role = self.role[n]
                if role:
                    if role[0] == "close" and closed is None:
                        closed = j
                    elif role[0] == "open":
                        opened = j
                    elif role[0] == "start":
                        start = j
            if j == 0:
                break
            before, holds = self.members[states[j - 1]], self.holds[classes[j]]
            nodes = {a for n in nodes for a, s in self.back_step[n] if holds[s] and a in before}
            if not nodes:
                break
            j -= 1
        return Hit(self.role[node][1], start, opened, closed) if start is not None and closed is not None and opened is not None else None
