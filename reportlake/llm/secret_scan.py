"""Secrets by assignment-aware lexing.

Each text is lexed as source code or configuration: names, operators, quoted and bare
literals. Targets and what is assigned to them become pairs; names on the right side are
replaced by the literals they were given before, so a literal that reaches a sensitive
name through constants or concatenation is found where it is written. A pair's score
joins how telling the target's name is and how random the literal looks.

Spans of fixed patterns (``base_spans``) are always part of the result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import pieces

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.7

# ---------------------------------------------------------------- fixed patterns

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\x01" * 16


def base_spans(data: bytes, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; leftmost and not overlapping within a kind.

    ``data`` is the text in UTF-8; quick looks at it spare most texts the patterns.
    """
    out = []
    low = data.lower()
    if any(word in low for word in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if _HEX_RUN in data.translate(_HEX_BYTES):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# ---------------------------------------------------------------- lexing

_LEXEMES = r"""
    (?P<string>STRINGS)
    |(?P<comment>//|--)
    |(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_][\w$]*)*)
    |(?P<assign>:=|=>|\+=|(?<![=!<>+*/%&|^-])=(?!=)|:(?!:))
    |(?P<plus>\+|\.\.)
    |(?P<number>[0-9][\w./+=-]*)
    |(?P<close>[\])])
    |(?P<end>[\n;,{}])
    |(?P<other>[^\s])
    """
_STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'"}
# By the quotes that may still begin a string on a line: one that found no end of its own
# kind has passed over all others of that kind as escaped, so none of these finds one.
_LEXEME = {
    quotes: re.compile(_LEXEMES.replace("STRINGS", "|".join(map(_STRINGS.get, quotes)) or "(?!)"), re.VERBOSE | re.ASCII)
    for quotes in ("\"'", '"', "'", "")
}
PIECES = 64  # literals of a value that is held as a plain list
_BARE = re.compile(r"[^\s,;\"'`#(){}\[\]]+")
_NO_LITERAL = re.compile(r"^(?:\$[\w{(].*|<.*>|%.*%|\{\{.*|true|false|null|none|nil|undefined|process\..*|os\..*|env\..*)$", re.IGNORECASE | re.DOTALL)


class Pair:
    """A target and what is assigned to it: (start, end, name), the name None for literals.

    ``aside``: it stands after ``--`` or ``//`` on its line.
    """

    __slots__ = ("name", "operands", "aside")

    def __init__(self, name: str, operands: list, aside: bool = False):
        self.name, self.operands, self.aside = name, operands, aside


def pairs(text: str, at: int = 0, stop: int | None = None, aside: bool = False) -> Iterator[Pair]:
    """Name and operands of each assignment, setting and key, in the order of the text.

    What follows ``--`` or ``//`` may be a comment, a flag or code after a decrement: the
    rest of the line is lexed apart and leaves the open target as it is.
    """
    stop = len(text) if stop is None else stop
    target, operands, joined = None, None, True  # operands: None left of the operator
    quotes = "\"'"
    while m := _LEXEME[quotes].search(text, at, stop):
        kind, value, at = m.lastgroup, m[0], m.end()
        if value == "\n":
            quotes = "\"'"
        elif kind == "other" and value in quotes:
            quotes = quotes.replace(value, "")
        if kind == "comment" and not aside:
            line = text.find("\n", at, stop)
            line = stop if line < 0 else line
            yield from pairs(text, at, line, True)
            at = line
            continue
        if kind in ("end", "comment"):
            if operands:
                yield Pair(target, operands, aside)
            target, operands = None, None
        elif kind == "assign":
            if operands and target is not None and value not in (":",):
                # a = b = "x": b is a target as well
                last = operands[-1]
                yield Pair(target, operands, aside)
                target = last[2]
            elif operands:
                target = operands[-1][2]
            operands = [] if target is not None else None
            joined = True
        elif operands is None:
            if kind == "name":
                target = value
            elif kind == "string" and len(value) > 2:
                target = value[1:-1]
            elif kind != "close":
                target = None
        elif kind == "plus":
            joined = True
        elif not joined:
            if kind == "name":  # the next word of a line: it may be a target itself
                yield Pair(target, operands, aside)
                target, operands = value, None
            elif kind == "string":
                yield Pair(target, operands, aside)
                target, operands = value[1:-1], None
        elif kind == "string":
            operands.append((m.start() + 1, m.end() - 1, None))
            joined = False
        elif kind == "name":
            bare = _BARE.match(text, m.start())
            if bare.end() > m.end() and not bare[0].rstrip(".:+-=").isidentifier():
                at = bare.end()
                operands.append((m.start(), at, None))
            else:
                operands.append((m.start(), m.end(), value))
            joined = False
        elif kind == "number":
            at = _BARE.match(text, m.start()).end()
            operands.append((m.start(), at, None))
            joined = False
    if operands:
        yield Pair(target, operands, aside)


class Line:
    """Distinct literals in order, which grows at both ends, with what their score needs."""

    EDGE = 16  # characters kept of either end; a placeholder's longest fixed word has 11

    def __init__(self, text: str):
        self.text, self.front, self.back, self.place = text, [], [], {}
        self.n, self.counts, self.head, self.tail = 0, Counter(), "", ""
        self.placeholder = self.spoilt = False
        self.told = (0, 0)

    @property
    def ends(self) -> tuple[int, int]:
        return -len(self.front), len(self.back)

    def add(self, span: tuple[int, int], first: bool = False) -> None:
        value = self.text[span[0] : span[1]]
        # what holds a blank or a placeholder within one literal never scores, whatever is joined to it
        self.spoilt = self.spoilt or any(c.isspace() for c in value) or bool(_PLACEHOLDER.search(value))
        if first:
            self.front.append(span)
            self.place[span] = -len(self.front)
            seam = value[-10:] + self.head[:10]
            self.head = (value + self.head)[: self.EDGE]
            if len(self.tail) < self.EDGE:
                self.tail = (value + self.tail)[-self.EDGE :]
        else:
            self.place[span] = len(self.back)
            self.back.append(span)
            seam = self.tail[-10:] + value[:10]
            self.tail = (self.tail + value)[-self.EDGE :]
            if len(self.head) < self.EDGE:
                self.head = (self.head + value)[: self.EDGE]
        self.placeholder = self.placeholder or bool(_PLACEHOLDER.search(seam))
        self.n += len(value)
        self.counts.update(value)

    def score(self) -> float:
        """``literal_score`` of all literals joined."""
        edges = self.head if self.n <= self.EDGE else self.head + self.tail
        if self.n < 8 or self.spoilt or self.placeholder or _NO_LITERAL.match(edges):
            return 0.0
        return _randomness(self.n, self.counts)


class Stretch:
    """A value of many literals: a stretch of a line, the whole of it when it was made.

    A value with a few more literals in front or behind is the next stretch of the same
    line, so a text that is built bit by bit is held once. All stretches of a line are nested.
    """

    __slots__ = ("line", "low", "high", "score", "spoilt")

    def __init__(self, line: Line):
        self.line, self.score, self.spoilt = line, line.score(), line.spoilt
        self.low, self.high = line.ends

    @classmethod
    def of(cls, text: str, spans) -> Stretch:
        line = Line(text)
        for span in spans:
            line.add(span)
        return cls(line)

    def __len__(self) -> int:
        return self.high - self.low

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return self.between(self.low, self.high)

    def __contains__(self, span: tuple[int, int]) -> bool:
        return self.low <= self.line.place.get(span, self.high) < self.high

    def between(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        front, back = self.line.front, self.line.back
        return (back[k] if k >= 0 else front[-1 - k] for k in range(low, high))

    def untold(self) -> list[tuple[int, int]]:
        """The literals that no stretch of the line gave here before."""
        low, high = self.line.told
        self.line.told = min(low, self.low), max(high, self.high)
        return [*self.between(self.low, min(low, self.high)), *self.between(max(high, self.low), self.high)]

    def grown(self, front: list, back: list) -> Stretch:
        if not front and not back:
            return self
        line = self.line if self.line.ends == (self.low, self.high) else Stretch.of(self.line.text, self).line
        for span in reversed(front):
            line.add(span, first=True)
        for span in back:
            line.add(span)
        return Stretch(line)


def put_together(text: str, parts: list) -> list[tuple[int, int]] | Stretch:
    """The distinct literals of ``parts`` (lists and stretches) in order."""
    large = [x for x in parts if isinstance(x, Stretch)]
    if not large:
        spans = list(dict.fromkeys(chain.from_iterable(parts)))
        return spans if len(spans) <= PIECES else Stretch.of(text, spans)
    core = max(large, key=len)
    at = next(k for k, x in enumerate(parts) if x is core)
    others = [x for x in parts if not (isinstance(x, Stretch) and x.line is core.line)]
    front = list(dict.fromkeys(chain.from_iterable(parts[:at])))
    inside = [s for s in front if s in core]
    if inside:
        if front[-len(inside) :] != inside or inside != list(core.between(core.low, core.low + len(inside))):
            return Stretch.of(text, dict.fromkeys(chain.from_iterable(parts)))  # the order is another
        front = front[: -len(inside)]
    there = set(front)
    back = [s for s in dict.fromkeys(chain.from_iterable(others)) if s not in core and s not in there]
    return core.grown(front, back)


def resolved(text: str, most: int | None = PIECES) -> Iterator[tuple[str, list[tuple[int, int]] | Stretch]]:
    """Targets and the literals that reach them, names replaced by what they held before.

    A name that was never assigned may be a bare literal of a configuration file: it
    counts as one if it holds a digit and looks random. A value of more than ``most``
    literals is taken for text that is being built, no secret: it and what is made of it
    holds none. With ``most`` None values have any number of literals.
    """
    code: dict[str, list[tuple[int, int]] | Stretch | None] = {}
    beside: dict[str, list[tuple[int, int]] | Stretch | None] = {}  # a comment doesn't change what code has assigned
    for pair in pairs(text):
        known = ChainMap(beside, code) if pair.aside else ChainMap(code, beside)
        if any(name in known and known[name] is None for _, _, name in pair.operands):
            known[pair.name] = None
            continue
        parts: list = []
        for start, end, name in pair.operands:
            if name is None or name not in known and any(map(str.isdigit, name)) and literal_score(name) > 0.6:
                parts.append([(start, end)])
            elif name in known:
                parts.append(known[name])
        spans = put_together(text, parts)
        if most is not None and len(spans) > most or isinstance(spans, Stretch) and spans.spoilt:
            known[pair.name] = None
            continue
        known[pair.name] = spans
        if spans:
            yield pair.name, spans


# ---------------------------------------------------------------- scores

# How telling a word of a name is.
_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.95, "tokens": 0.95,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.6,
}
_BEFORE_KEY = ("api", "access", "private", "secret", "signing", "encryption", "account", "shared", "master", "auth", "service")
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"bearer", b"auth", b"signature", b"salt")
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*{3,}|\.{3,}|your|example|changeme|placeholder|dummy|sample|todo)", re.IGNORECASE)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in _SPLIT.findall(name)]
    best = max((_WORDS.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys") and a in _BEFORE_KEY:
            best = 1.0
    return best


def literal_score(value: str) -> float:
    """From 0 to 1 by length, entropy a character and kinds of characters."""
    n = len(value)
    if n < 8 or _NO_LITERAL.match(value) or _PLACEHOLDER.search(value) or any(c.isspace() for c in value):
        return 0.0
    return _randomness(n, Counter(value))


def _randomness(n: int, counts: Counter) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(test(c) for c in counts) for test in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in counts)
    return 0.4 * min(1.0, entropy / 3.5) + 0.3 * min(1.0, (n - 4) / 16) + 0.15 * min(2, kinds - 1)


def lexed_spans(data: bytes, text: str, most: int | None = PIECES) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive target and score high enough together; ``most`` as in ``resolved``."""
    low = data.lower()
    if not (b"=" in data or b":" in data) or not any(stem in low for stem in _STEMS):
        return []
    out = {}
    for name, spans in resolved(text, most):
        if telling := name_score(name):
            many = isinstance(spans, Stretch)
            looks = spans.score if many else literal_score("".join(text[a:b] for a, b in spans))
            if looks > 0.3 and 0.6 * telling + 0.4 * looks >= THRESHOLD:
                out.update({(a, b): ("literal", a, b) for a, b in (spans.untold() if many else spans) if b > a})
    return list(out.values())


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(data: bytes, most: int | None = PIECES) -> tuple:
    """Counts by base kind, digest of the base spans, all spans; ``most`` as in ``resolved``."""
    text = data.decode()
    base = base_spans(data, text)
    starts, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    more = [x for x in lexed_spans(data, text, most) if not base or not (k := bisect_right(starts, x[1])) or reach[k - 1] < x[2]]
    counts = [sum(x[0] == kind for x in base) for kind in KINDS[:3]]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(ordered(base + more))


NAMES = [*(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans"]


def _scan(most: int | None):
    types = [pa.int64()] * 3 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                found = [pa.array(list(v), t) for v, t in zip(zip(*(scan(t, most) for t in texts)), types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *found], names=["doc_id", *NAMES])

    return run


def find_secrets(docs: DataFrame, most: int | None = PIECES) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points of the whole text, ends exclusive. Counts and digest are of
    the fixed patterns; ``spans`` also holds lexed literals outside them (see ``resolved``).
    ``most``: literals of a value, None for any number. The work grows with the text's
    length; where values of many literals are put together in other orders again and again,
    with their lengths too. Null text is empty text. Repeated rows and null ids are kept, other columns are ignored, an empty
    table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return narrow.mapInArrow(_scan(most), schema)
