"""A run-length grammar of integer sequences by recompression, and common extensions from it.

Rounds alternate. A block round replaces each maximal block of one symbol by a symbol for
(symbol, count); a pair round splits the symbols into left and right ones and replaces each
left symbol with a right one behind it by a symbol for the pair. Symbols are named by exact
equality, so equal stretches get equal symbols but for a few at their ends. The sequence
of every round is kept with the places its symbols begin at in the round below: the rules
of the grammar applied to the text, of a size that shrinks geometrically.

Separators (negative symbols) take part in no rule. A forest of documents is one sequence,
and no symbol spans two of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """A round's sequence, and how the next round groups it."""

    symbols: np.ndarray
    starts: np.ndarray | None = None  # of each symbol of the next round, and the end
    above: np.ndarray | None = None  # symbol of the next round over each place
    blocks: bool = False  # grouped by a block round


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A new symbol for each distinct key, counted from ``fresh``."""
    distinct, place = np.unique(keys, return_inverse=True)
    return place.astype(np.int64) + fresh, fresh + len(distinct)


def _group(level: Level, starts: np.ndarray) -> None:
    n = len(level.symbols)
    level.starts = np.append(starts, n)
    level.above = np.repeat(np.arange(len(starts)), np.diff(level.starts))


def _block_round(level: Level, fresh: int) -> tuple[Level | None, int]:
    s = level.symbols
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    if first.all():
        return None, fresh
    starts = np.flatnonzero(first)
    _group(level, starts)
    level.blocks = True
    up, counts = s[starts].copy(), np.diff(level.starts)
    many = counts > 1
    up[many], fresh = _named(up[many] * (int(counts.max()) + 1) + counts[many], fresh)
    return Level(up), fresh


def _pair_round(level: Level, fresh: int, number: int) -> tuple[Level | None, int]:
    s = level.symbols
    real = (s[:-1] >= 0) & (s[1:] >= 0)
    if not real.any():
        return None, fresh
    pair, most = real, 0
    for seed in range(64):  # the first two, or as many as it takes to find a pair
        if seed > 1 and most:
            break
        mixed = (s.astype(np.uint64) + np.uint64(64 * number + seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        side = (mixed >> np.uint64(63)).astype(bool)
        for left in (side, ~side):
            found = real & left[:-1] & ~left[1:]
            count = int(found.sum())
            if count > most:
                pair, most = found, count
    if not most:
        return None, fresh
    first = np.ones(len(s), dtype=bool)
    first[1:] = ~pair
    starts = np.flatnonzero(first)
    _group(level, starts)
    up = s[starts].copy()
    double = np.diff(level.starts) == 2
    at = starts[double]
    up[double], fresh = _named(s[at] * fresh + s[at + 1], fresh)
    return Level(up), fresh


def grammar(symbols: np.ndarray) -> list[Level]:
    """All rounds from ``symbols`` up, until nothing but single symbols between separators is left."""
    levels = [Level(symbols.astype(np.int64))]
    fresh = int(symbols.max(initial=0)) + 1
    number = 0
    while True:
        up, fresh = _block_round(levels[-1], fresh)
        if up is not None:
            levels.append(up)
        up, fresh = _pair_round(levels[-1], fresh, number)
        if up is None:
            return levels
        levels.append(up)
        number += 1


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar of the reversed sequence."""
    out = []
    for level in levels:
        own = Level(level.symbols[::-1], blocks=level.blocks)
        if level.starts is not None:
            own.starts = len(level.symbols) - level.starts[::-1]
            own.above = len(level.starts) - 2 - level.above[::-1]
        out.append(own)
    return out


def common_extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from places ``a`` and ``b`` on are the same, for each pair of places.

    Going up, a pair of places moves past what is left of the group it stands in, then to
    the symbols over it; where symbols differ it goes down again, past the first part that
    the two have in common in each round. The sequence ends with a separator, which stops
    every pair.
    """
    x, y = a.astype(np.int64), b.astype(np.int64)
    stop = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    for height, level in enumerate(levels):
        s = level.symbols
        live = live[s[x[live]] == s[y[live]]]
        if not len(live):
            break
        if level.above is None:
            while len(live):
                x[live] += 1
                y[live] += 1
                live = live[s[x[live]] == s[y[live]]]
            break
        p, q = x[live], y[live]
        over_p, over_q = level.above[p], level.above[q]
        inside = (p > level.starts[over_p]) | (q > level.starts[over_q])
        step = np.where(inside, np.minimum(level.starts[over_p + 1] - p, level.starts[over_q + 1] - q), 0)
        p, q = p + step, q + step
        x[live], y[live] = p, q
        live = live[s[p] == s[q]]
        stop[live] = height + 1
        x[live], y[live] = level.above[x[live]], level.above[y[live]]
    for height in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(stop >= height)
        if not len(down):
            continue
        level = levels[height - 1]
        p, q = x[down], y[down]
        rest = np.minimum(level.starts[p + 1] - level.starts[p], level.starts[q + 1] - level.starts[q])
        p, q = level.starts[p], level.starts[q]
        same = level.symbols[p] == level.symbols[q]
        step = np.where(same, rest if level.blocks else 1, 0)
        x[down], y[down] = p + step, q + step
    return x - a
