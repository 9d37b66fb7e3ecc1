"""Chat formatting by a compiled template, and reading the output back.

Control strings inside texts are escaped reversibly: ``<|`` becomes ``<\\|``, and where
backslashes stand between, one more is added. So ``<|`` is only ever written by the
template, whatever a text says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.template import END, START, compile_template

TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' + message.role|role + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|escape }}{% endgeneration %}"
    "{% else %}{{ message.text|escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}"
    "{% endfor %}"
)
_HEAD, _TAIL = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Of one line: a role ends at the first line break."""
    return escape(role.replace("&", "&a").replace("\n", "&n"))


def unescape_role(line: str) -> str:
    return unescape(line).replace("&n", "\n").replace("&a", "&")


FILTERS = {"escape": escape, "role": escape_role}


class Reader:
    """Reads formatted output back, piece by piece; holds one turn at most."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open: list[str] = []
        self.marked: list[str] | None = None

    def feed(self, pieces: Iterable) -> Reader:
        for piece in pieces:
            if piece is START:
                self.marked = []
            elif piece is END:
                text = unescape("".join(self.marked))
                self.loss.update(text.encode())
                self.loss_chars += len(text)
                self.marked = None
            else:
                self.chars += len(piece)
                self.open.append(piece)
                if self.marked is not None:
                    self.marked.append(piece)
                elif _TAIL in piece or piece.endswith("\n"):
                    self._close()
        self._close()
        if "".join(self.open):
            raise ValueError("the output ends within a turn")
        return self

    def _close(self) -> None:
        """Takes all whole turns off the open output."""
        rest = "".join(self.open)
        while (end := rest.find(_TAIL)) >= 0:
            if not rest.startswith(_HEAD):
                raise ValueError("a turn does not begin with its mark")
            line = rest.index("\n")
            role, text = unescape_role(rest[len(_HEAD) : line]), unescape(rest[line + 1 : end])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            rest = rest[end + len(_TAIL) :]
        self.open = [rest] if rest else []


def _messages(rows: Iterable[tuple]) -> Iterator[dict]:
    for _, role, text in rows:
        yield {"role": role or "", "text": text or ""}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")))


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        out: list[tuple] = []
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            read = Reader().feed(render(messages=_messages(rows)))
            out.append((conv_id, read.n_turns, read.turns.hexdigest(), read.loss_chars, read.loss.hexdigest(), read.chars))
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, _TYPES)], names=_NAMES)


def in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together, by turn; equal turns by role, then text."""
    narrow = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a conversation, as read back from the formatted output.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Null role and
    text are empty; rows with a null id form a conversation; repeated rows are turns of
    their own. A conversation streams through its task turn by turn, however long it is.
    Other columns are ignored; an empty table gives an empty result.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return in_order(turns).mapInArrow(_format(template), schema)


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv_id, piece, text, loss): a row a turn's stretch, in order."""
        render = compile_template(template, FILTERS)
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            ids, text, loss, number, marked = [], [], [], 0, False
            for piece in render(messages=_messages(rows)):
                if piece is START or piece is END:
                    marked = piece is START
                elif piece:
                    ids.append(number)
                    text.append(piece)
                    loss.append(marked)
                    number += 1
                    if len(ids) >= 1000:
                        yield _stretch(conv_id, ids, text, loss)
                        ids, text, loss = [], [], []
            yield _stretch(conv_id, ids, text, loss)

    return run


def _stretch(conv_id, ids, text, loss) -> pa.RecordBatch:
    arrays = [pa.array([conv_id] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(text, pa.string()), pa.array(loss, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "piece", "text", "loss"])


def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The output itself: conv_id, piece, text, loss (whether a model learns the piece)."""
    return in_order(turns).mapInArrow(_render(template), "conv_id bigint, piece bigint, text string, loss boolean")
