"""Personal data by a linear-chain conditional random field over word shapes.

The field labels the words between blanks, a line of text a sequence, with the beginning
and inside of each kind. It is trained from ``LABELLED``, and decoded by Viterbi for many
lines at once in numpy. Spans of fixed patterns (``base_spans``) are always part of the
result; the field adds forms the patterns miss, after a check of their digits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")

# The labelled table: what stands between <kind: and > is of that kind.
LABELLED = """
write to <email:ana.lopez@mail.example> before noon
my address is <email:j_smith99@post.example.org>, thanks
<email:info@shop.example> answers within a day
Mail: <email:K.Weber@uni-x.example.de>
contact <email:bob@example.com> or <email:alice@example.net>
reach me at <email:first.last@sub.domain.example>.
send it to <email:team+jobs@work.example> and wait
the host <ip:192.168.0.14> did not answer
<ip:10.0.0.1> and <ip:10.0.0.2> are routers
login from <ip:203.0.113.77>, port closed
ping <ip:8.8.4.4> failed twice
server at <ip:172.16.254.1>.
blocked address <ip:198.51.100.23> since Monday
call <phone:+1 555 010 9999> after six
call <phone:+49 30 1234567> or write
Phone: <phone:+33 1 23 45 67 89>
my number is <phone:+34-600-123-456>, ask for Eva
tel <phone:(030) 555 0199> is busy
dial <phone:555-0100-2233> for help
fax <phone:0049 89 998877> is off
ring <phone:+15550102345> any time
cell <phone:(555) 010-2345> until nine
office <phone:+44 (20) 7946 0018> on weekdays
mobile <phone:0600-12-34-56> or home
card <card:4111 1111 1111 1111> was charged
paid with <card:5500-0000-0000-0004>, thanks
number <card:4012888888881881> expired
<card:3782.8224.6310.0055> is on file
visa <card:4222-2222-2222-2220> declined
use <card:6011 0000 0000 0004> please
the card <card:4716 8910 2233 4455> is blocked.
in 2019 we sold 450 units
version 2.4.1 and version 10.2 are out
on 12/05/2021 at 10:45 we met
section 3.1.4 says nothing about it
the price is 1,299.00 and not 1,399
room 12 on floor 3 has 40 seats
it rose by 12.5 percent to 8000
The meeting is on 2020-01-31, room 5.
see page 118 and table 4.2
commit 24be64439e3e49cf46b2d7c90f3602a3 is broken
chapter 7, verse 12 and 13
about 1000000 people live there
order 100234 has 3 items
Licensed under the Apache License, Version 2.0.
All rights reserved.
The quick brown fox jumps over the lazy dog
the name of the man and the house
what is that, and where is it from
BIG! SALE!! NOW!!! 50% off
a | b | c | d
it###  was*** not$$$ here&&& or%%% there
follow @someone or @nobody for news
look @ this and that @ home
x = y + 3 - 2 and z
tel aviv is a city and mail is slow
call me back when you can
email me or phone me, please
from 1990 to 1999 and from 2001 to 2010
ratio 16:9 and 4:3 at 60 fps
1 2 3 4 5 6 7 8 9 10
"""

# ---------------------------------------------------------------- fixed patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# starts inside a run of digits can't match where its first digit doesn't
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    found = _digits(text)
    return 16 <= len(found) <= 19 and luhn(found)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- word shapes

_OTHER, _LOWER, _UPPER, _DIGIT, _AT, _DOT, _PLUS, _PAREN, _DASH, _PUNCT, _BLANK, _LINE = range(12)
_CLASS = np.full(129, _OTHER, dtype=np.uint8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = (
        _LINE if _s == "\n" else _BLANK if _s in " \t\x0b\x0c\r" else _DIGIT if _s.isdigit() else _LOWER if _s.islower() else _UPPER if _s.isupper()
        else {"@": _AT, ".": _DOT, "+": _PLUS, "(": _PAREN, ")": _PAREN, "-": _DASH}.get(_s, _PUNCT if _s.isprintable() else _OTHER)
    )
_DIGITS = np.digitize(np.arange(64), [1, 2, 3, 4, 5, 7, 9, 13, 20]).astype(np.int32)  # 10 steps
_DOTS = np.minimum(np.arange(64), 4).astype(np.int32)
_LENGTH = np.digitize(np.arange(64), [3, 6, 12]).astype(np.int32)
_FIRST = np.array([0, 1, 1, 2, 0, 0, 3, 4, 0, 0, 0, 0], dtype=np.int32)
_LAST = np.array([0, 1, 1, 2, 0, 3, 0, 3, 0, 3, 0, 0], dtype=np.int32)
_STEPS = (10, 3, 5, 5, 4, 2, 3, 4)  # digits, @, dots, first, last, letters, dashes, length
SHAPES = int(np.prod(_STEPS))


def words_and_shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start and end of each word, the number of its line, and its shape."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = _CLASS[np.minimum(points, 128)]
    full = kind < _BLANK
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        empty = np.array([], dtype=np.int64)
        return empty, empty, empty, empty.astype(np.int32)

    def number(which):
        return np.minimum(np.add.reduceat(np.concatenate([which, [False]]).view(np.uint8), edge, dtype=np.int32)[::2], 63)

    line = np.cumsum(kind == _LINE)[start]
    letters = number((kind == _LOWER) | (kind == _UPPER)) > 0
    parts = (
        _DIGITS[number(kind == _DIGIT)],
        np.minimum(number(kind == _AT), 2),
        _DOTS[number(kind == _DOT)],
        _FIRST[kind[start]],
        _LAST[kind[end - 1]],
        letters.astype(np.int32),
        np.minimum(number(kind == _DASH), 2),
        _LENGTH[np.minimum(end - start, 63)],
    )
    shape = np.zeros(len(start), dtype=np.int32)
    for step, part in zip(_STEPS, parts):
        shape = shape * step + part
    return start, end, line, shape


def _shape_features() -> np.ndarray:
    """For each shape the features it has: one a part, some pairs, all distinct numbers."""
    parts, rest = [], np.arange(SHAPES)
    for step in reversed(_STEPS):
        parts.append(rest % step)
        rest = rest // step
    parts = parts[::-1]
    columns, base = [], 0
    for k in range(len(parts)):
        columns.append(base + parts[k])
        base += _STEPS[k]
    for a, b in ((0, 1), (0, 2), (0, 3), (0, 5), (2, 5), (1, 2), (0, 6)):
        columns.append(base + parts[a] * _STEPS[b] + parts[b])
        base += _STEPS[a] * _STEPS[b]
    return np.stack(columns, axis=1)


FEATURES = _shape_features()
N_FEATURES = int(FEATURES.max()) + 1

# ---------------------------------------------------------------- the field

STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_N = len(STATES)
_BANNED = np.zeros((_N, _N), dtype=bool)
for _k in range(len(KINDS)):
    _BANNED[:, 2 + 2 * _k] = True  # inside only after beginning or inside
    _BANNED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def labelled_lines(table: str = LABELLED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for row in table.strip().splitlines():
        text, spans, at = "", [], 0
        for m in re.finditer(r"<(\w+):([^>]*)>", row):
            text += row[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + row[at:], spans))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Scores of a state from the shapes of the word and both neighbours, and of moves."""

    def __init__(self):
        self.weights = np.zeros((3, N_FEATURES, _N))
        self.moves = np.where(_BANNED, -1e4, 0.0)
        self.first = np.where(_BANNED[0], -1e4, 0.0)

    def tables(self) -> list[np.ndarray]:
        """A row of state scores for each shape: of the word, the one before, the one after.

        One more row stands for no neighbour.
        """
        return [np.concatenate([w[FEATURES].sum(axis=1), np.zeros((1, _N))]).astype(np.float32) for w in self.weights]

    def train(self, lines=None, steps: int = 150, decay: float = 0.02) -> Field:
        """Steps of adaptive gradient ascent on the penalised likelihood of all lines."""
        data = []
        for text, spans in labelled_lines() if lines is None else lines:
            start, end, _, shape = words_and_shapes(text)
            state = np.zeros(len(start), dtype=np.int64)
            for kind, a, b in spans:
                inside = np.flatnonzero((start < b) & (end > a))
                state[inside] = 2 + 2 * KINDS.index(kind)
                state[inside[0]] -= 1
            data.append((shape, state))
        seen = [np.zeros_like(x) for x in (self.weights, self.moves, self.first)]
        for _ in range(steps):
            slopes = [-decay * self.weights, np.where(_BANNED, 0, -decay * self.moves), np.where(_BANNED[0], 0, -decay * self.first)]
            for shape, state in data:
                self._add_slope(shape, state, slopes)
            for value, slope, past in zip((self.weights, self.moves, self.first), slopes, seen):
                past += slope * slope
                value += 0.3 * slope / (np.sqrt(past) + 1e-8)
            self.moves[_BANNED] = -1e4
            self.first[_BANNED[0]] = -1e4
        return self

    def _add_slope(self, shape, state, slopes) -> None:
        n = len(shape)
        near = [np.arange(n), np.arange(n) - 1, np.arange(n) + 1]
        used = [(np.flatnonzero((at >= 0) & (at < n)), at) for at in near]
        score = np.zeros((n, _N))
        for w, (ok, at) in zip(self.weights, used):
            score[ok] += w[FEATURES[shape[at[ok]]]].sum(axis=1)
        ahead, back = np.zeros((n, _N)), np.zeros((n, _N))
        ahead[0] = self.first + score[0]
        for t in range(1, n):
            ahead[t] = _logsum(ahead[t - 1][:, None] + self.moves, 0) + score[t]
        for t in range(n - 2, -1, -1):
            back[t] = _logsum(self.moves + score[t + 1] + back[t + 1], 1)
        total = _logsum(ahead[-1], 0)
        gap = -np.exp(ahead + back - total)
        gap[np.arange(n), state] += 1
        for slope, (ok, at) in zip(slopes[0], used):
            for column in FEATURES[shape[at[ok]]].T:
                np.add.at(slope, column, gap[ok])
        slopes[2] += gap[0]
        for t in range(1, n):
            slopes[1] -= np.exp(ahead[t - 1][:, None] + self.moves + score[t] + back[t] - total)
            slopes[1][state[t - 1], state[t]] += 1


class Decoder:
    def __init__(self, field: Field):
        self.own, self.before, self.after = field.tables()
        self.moves, self.first = field.moves.astype(np.float32), field.first.astype(np.float32)

    def states(self, shape: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best state of each word; words of one line follow each other."""
        n = len(shape)
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        sizes = np.diff(np.append(starts, n))
        ends = starts + sizes - 1
        left, right = np.concatenate([[SHAPES], shape[:-1]]), np.concatenate([shape[1:], [SHAPES]])
        left[starts] = SHAPES
        right[ends] = SHAPES
        score = self.own[shape] + self.before[left] + self.after[right]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lines longer than t
        come = np.zeros((n, _N), dtype=np.int8)
        best = self.first + score[starts]
        for t in range(1, sizes[0]):
            rows = starts[: active[t]] + t
            ways = best[: active[t], None, :] + self.moves.T  # to a state, from a state
            from_ = ways.argmax(axis=2)
            come[rows] = from_
            best[: active[t]] = np.take_along_axis(ways, from_[:, :, None], 2)[:, :, 0] + score[rows]
        out = np.zeros(n, dtype=np.int8)
        now = best.argmax(axis=1)
        for t in range(sizes[0] - 1, -1, -1):
            rows = starts[: active[t]] + t
            out[rows] = now[: active[t]]
            now[: active[t]] = come[rows, now[: active[t]]]
        return out


_TRIM = " \t.,;:!?\"'<>[]{}|*#$&%"


def _checked(kind: str, text: str) -> bool:
    """Whether a span that the field proposes can be of its kind."""
    found = _digits(text)
    if kind == "email":
        return text.count("@") == 1 and bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]*\w", text))
    if kind == "ip":
        return _is_ip(text) if re.fullmatch(r"[0-9.]+", text) else False
    if kind == "card":
        return 13 <= len(found) <= 19 and luhn(found) and bool(re.fullmatch(r"[0-9 .-]+", text))
    return 8 <= len(found) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", text)) and not re.fullmatch(r"[0-9]+", text)


def field_spans(texts: list[str], decoder: Decoder) -> list[list[tuple[str, int, int]]]:
    """Checked spans of the field in each text, decoded together."""
    each = [words_and_shapes(t) for t in texts]
    shape = np.concatenate([e[3] for e in each])
    if not len(shape):
        return [[] for _ in texts]
    base = np.cumsum([0] + [int(e[2][-1]) + 1 if len(e[2]) else 1 for e in each])
    state = decoder.states(shape, np.concatenate([e[2] + b for e, b in zip(each, base)]))
    out, at = [], 0
    for text, (start, end, line, _) in zip(texts, each):
        own = state[at : at + len(start)]
        at += len(start)
        spans = []
        for first in np.flatnonzero((own > 0) & (own % 2 == 1)).tolist():
            last = first
            while last + 1 < len(own) and own[last + 1] == own[first] + 1 and line[last + 1] == line[first]:
                last += 1
            a, b = int(start[first]), int(end[last])
            while a < b and text[a] in _TRIM:
                a += 1
            while a < b and text[b - 1] in _TRIM:
                b -= 1
            kind = KINDS[(own[first] - 1) // 2]
            if _checked(kind, text[a:b]):
                spans.append((kind, a, b))
        out.append(spans)
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _apart(more: list, base: list) -> list:
    """Those of ``more`` that overlap none of ``base``."""
    placed = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in placed]
    reach = list(accumulate((b for _, b in placed), max))
    out = []
    for span in more:
        before = bisect_left(starts, span[2])
        if not before or reach[before - 1] <= span[1]:
            out.append(span)
    return out


def find(texts: list[str], decoder: Decoder) -> list[tuple]:
    """(counts by kind, digest of the base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, field_spans(texts, decoder)):
        base = base_spans(text)
        new = _apart(more, base)
        both = sorted(base + new, key=lambda x: (KINDS.index(x[0]), x[1]))
        counts = [sum(x[0] == kind for x in base) for kind in KINDS]
        out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)))
    return out


NAMES = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def _scan(decoder: Decoder):
    types = [pa.int64()] * len(KINDS) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text", 2_000_000):
                rows = zip(*find([t.decode() for t in texts], decoder))
                found = [pa.array(list(v), t) for v, t in zip(rows, types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *found], names=["doc_id", *NAMES])

    return run


def find_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points of the whole text, ends exclusive. Counts and digest are of
    the fixed patterns; ``spans`` also holds what the field adds without overlap. Null
    text is empty text. Repeated rows and null ids are kept, other columns are ignored, an
    empty table gives an empty result.
    """
    decoder = Decoder(field or Field().train())
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return narrow.mapInArrow(_scan(decoder), schema)
