"""Periodic runs of words: stretches that repeat a short sequence at least four times.

A run of period q and at least 4q words holds four neighbouring multiples of q, all with
the same word. These places of the harmonic grid are found for every q by comparing
strided slices of a batch's words; the grammar of ``recompression`` then says exactly how
far each candidate reaches to both sides.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import pieces
from reportlake.llm.recompression import common_extension, grammar, mirrored

REPEATS, LEAST = 4, 6  # a run has this many periods, and words, at least


def _candidates(words: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Periods and grid places, by period, then place.

    ``words`` holds documents of falling length, so that those that are long enough for a
    period come first; ``ends`` are their ends, ``counts`` their lengths.
    """
    periods, places = [], []
    longest = int(counts[0]) if len(counts) else 0
    fit = len(counts) - np.searchsorted(counts[::-1], REPEATS * np.arange(longest // REPEATS + 1))
    for q in range(1, longest // REPEATS + 1):
        stretch = words[: ends[fit[q] - 1]]
        grid = stretch[::q]
        same = grid[:-1] == grid[1:]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        for shift in (q // 2, q // 3, q - 1):  # a run has these places too
            if shift and len(at):
                ok = stretch[at + shift] == stretch[at + shift + q]
                at = at[ok]
                at = at[stretch[at + shift + q] == stretch[at + shift + 2 * q]]
        if len(at):
            periods.append(np.full(len(at), q))
            places.append(at)
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(periods), np.concatenate(places)


def _stretches(words: np.ndarray, periods: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the longest stretch through each candidate, each once.

    Candidates of one period that follow each other on the grid mostly share a stretch: the
    first is asked for, and those that it doesn't hold are asked in the next turn.
    """
    forward = grammar(words)
    backward = mirrored(forward)
    found = []
    while len(places):
        ask = np.ones(len(places), dtype=bool)
        ask[1:] = (periods[1:] != periods[:-1]) | (places[1:] != places[:-1] + periods[1:])
        p, q = places[ask], periods[ask]
        ahead = common_extension(forward, p, p + q)
        behind = common_extension(backward, len(words) - p, len(words) - p - q)
        start, end = p - behind, p + q + ahead
        found.append((start, end, q))
        group = np.cumsum(ask) - 1
        open_ = places + periods > end[group]
        places, periods = places[open_], periods[open_]
    start, end, q = (np.concatenate(c) for c in zip(*found))
    long = end - start >= np.maximum(LEAST, REPEATS * q)
    start, end, q = start[long], end[long], q[long]
    # of the periods of one stretch the smallest is meant
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _laid_out(documents: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence with a separator before, between and after the documents; their starts and ends."""
    counts = np.array([len(documents[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(counts + 1)
    words = np.empty(int(ends[-1]) + 1, dtype=np.int64)
    marks = np.concatenate([[0], ends])
    words[marks] = -1 - np.arange(len(marks))
    for start, k in zip(marks[:-1].tolist(), order.tolist()):
        words[start + 1 : start + 1 + len(documents[k])] = documents[k]
    return words, marks[:-1] + 1, ends


def find_runs(documents: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of non-negative numbers its runs: rows (start, length, period).

    A run is a stretch with smallest period q of at least max(6, 4q) places that no place
    beside it extends. Rows come by start, then period.
    """
    out = [np.zeros((0, 3), dtype=np.int64)] * len(documents)
    counts = np.array([len(d) for d in documents], dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= LEAST]
    if not len(order):
        return out
    words, starts, ends = _laid_out(documents, order)
    periods, places = _candidates(words, ends, counts[order])
    if not len(places):
        return out
    # the grammar is built over the documents with candidates alone
    owner = np.searchsorted(starts, places, side="right") - 1
    some, owner_at = np.unique(owner, return_inverse=True)
    places = places - starts[owner]
    words, starts, ends = _laid_out(documents, order[some])
    start, end, q = _stretches(words, periods, places + starts[owner_at])
    owner = np.searchsorted(starts, start, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(some) + 1))
    rows = np.stack([start - starts[owner], end - start, q], axis=1)
    for k, place in enumerate(order[some].tolist()):
        out[place] = rows[cuts[k] : cuts[k + 1]]
    return out


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Where each word of a document is taken from: in a tenth of them the end repeats itself.

    None where the words stay as they are.
    """
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut down to its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


COLUMNS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """The values of ``COLUMNS`` for one document."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    longest: tuple = (None,) * 4
    if len(runs):
        s, n, q = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        longest = s, n, q, 1000 * n // q
        words = [words[k] for k in np.flatnonzero(without_repeats(len(words), runs)).tolist()]
    digest = hashlib.sha256(b" ".join(words)).hexdigest()
    return len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), digest


def scan(ids: list, texts: list[bytes], plant: bool) -> list[tuple]:
    """``described`` for each text, its runs found together with those of the others."""
    numbers: dict[bytes, int] = {}
    split, coded = [], []
    for doc_id, text in zip(ids, texts):
        words = text.split()
        code = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        source = planted(len(words), doc_id) if plant else None
        if source is not None:
            code = code[source]
            words = [words[k] for k in source.tolist()]
        split.append(words)
        coded.append(code)
    return [described(words, runs) for words, runs in zip(split, find_runs(coded))]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_runs, the longest run, digests of runs and text.

    Words are what stands between blanks (space and the controls 9 to 13), and runs are
    counted in words. ``start``, ``length``, ``period`` and ``exponent_milli`` (thousandths
    of periods in the run, rounded down) describe the longest run, of equally long ones
    the first and then that of smaller period; they are null without a run. ``runs_sha256``
    is of all runs, a line each; ``collapsed_sha256`` of the words that stay when every run
    is cut to its first period. With ``plant`` a tenth of the documents, by their ids, are
    made to repeat their end first.

    Null and empty texts and texts of blanks have no words and no runs. Ids may repeat or
    be null (null counts as empty where ids decide); other columns are ignored; an empty
    table gives an empty result. A text is held whole, with some 200 bytes a word while
    its runs are looked for.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
        for batch in parts:
            for first, texts in pieces(batch, "text"):
                ids = batch.column("doc_id").slice(first, len(texts))
                rows = scan(ids.to_pylist(), texts, plant)
                found = [pa.array(list(v), t) for v, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([ids, *found], names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return narrow.mapInArrow(batches, f"doc_id bigint, {COLUMNS}")
