"""The stretch of a text that is closest to a wanted one, word by word.

Candidates come from shared words: a stretch that is close enough holds most of the
wanted words within a bounded distance, which running counts tell for all places at once.
Only around such places an edit distance is filled in, a wanted word at a time for all
words of the text, and each cell carries where its stretch began.
"""

from __future__ import annotations

import re

import numpy as np

LETTERS = 7  # spelling differences of a word that are told apart
_SPELLED = 32  # leading letters that are compared
_BLOCK = 20_000  # words of text filled in at once
LONGEST = 100_000  # wanted words; longer texts are not looked for

_WORD = re.compile(r"\S+")


def _spelling(word: str, others: list[str]) -> np.ndarray:
    """Edit distance of the first letters of ``word`` to those of each other word, up to ``LETTERS``."""
    heads = [w[:_SPELLED] for w in others]
    sizes = np.array([len(h) for h in heads])
    width = int(sizes.max(initial=0))
    letters = np.array([h.ljust(width, "\0") for h in heads], dtype=f"<U{max(1, width)}").view("<U1").reshape(len(heads), -1)[:, :width]
    row = np.broadcast_to(np.arange(width + 1), (len(heads), width + 1)).astype(np.int16)
    steps = np.arange(width + 1, dtype=np.int16)
    for count, letter in enumerate(word[:_SPELLED], 1):
        new = np.empty_like(row)
        new[:, 0] = count
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != letter))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return np.minimum(row[np.arange(len(heads)), sizes], LETTERS).astype(np.int64)


def _near(found: np.ndarray, sought: np.ndarray, edits: int) -> np.ndarray:
    """Which places of the text lie in a stretch that holds enough of the wanted words.

    ``found`` and ``sought`` number words alike. A stretch has at most ``edits`` words more than
    are wanted and shares all but ``edits`` of them, repeats counted.
    """
    reach = len(sought) + edits
    held = np.zeros(max(1, len(found) - reach + 1), dtype=np.int64)
    for word, wanted in zip(*np.unique(sought, return_counts=True)):
        sums = np.concatenate([[0], np.cumsum(found == word)])
        ahead = sums[np.minimum(np.arange(len(held)) + reach, len(found))] - sums[: len(held)]
        held += np.minimum(ahead, wanted)
    marks = np.zeros(len(found) + 1, dtype=np.int64)
    starts = np.flatnonzero(held >= len(sought) - edits)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + reach, len(found)), -1)
    return np.cumsum(marks[:-1]) > 0


def _closest(found: np.ndarray, sought: np.ndarray, words: list[str], wanted: list[str]) -> tuple[int, int, int, int]:
    """(word edits, spelling, start, end) of the best stretch of some words of a text."""
    size, span = len(sought), len(found)
    weight = (LETTERS + 1) * (size + span + 1)  # of a word edit, more than all spelling together
    distinct, place = np.unique(found, return_inverse=True)
    vocabulary = [words[i] for i in np.unique(found, return_index=True)[1]]
    lengths = np.minimum([len(w) for w in vocabulary], LETTERS)
    base = span + 1  # a cell is cost * base + start
    insert = (weight + lengths[place]) * base
    sums = np.concatenate([[0], np.cumsum(insert)])
    row = np.arange(span + 1, dtype=np.int64)
    costs: dict[int, np.ndarray] = {}
    for number, word in zip(sought.tolist(), wanted):
        if number not in costs:
            change = weight + _spelling(word, vocabulary)
            change[distinct == number] = 0
            costs[number] = change * base
        new = row + (weight + min(len(word), LETTERS)) * base
        new[1:] = np.minimum(new[1:], row[:-1] + costs[number][place])
        row = np.minimum.accumulate(new - sums) + sums
    end = int(np.argmin(row))
    cost, start = divmod(int(row[end]), base)
    return cost // weight, cost % weight, start, end


def closest_span(text: str, wanted: str, threshold: float = 0.5) -> dict | None:
    """The run of words of ``text`` that becomes ``wanted`` by the fewest changed, missing and extra words.

    Case is ignored. Among equals the spelling of changed words decides (see ``LETTERS``),
    then the first start, then the shorter run. None if fewer than a share ``threshold`` of the
    wanted words is left unchanged, or if more than ``LONGEST`` words are wanted.
    """
    sought = wanted.lower().split()
    words = list(_WORD.finditer(text))
    edits = int(len(sought) * (1 - threshold) + 1e-9)
    if not sought or not words or len(sought) > LONGEST:
        return None
    lowered = [w.group().lower() for w in words]
    numbers: dict[str, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in sought])
    found = np.array([numbers.setdefault(w, len(numbers)) for w in lowered])
    near = _near(found, code, edits)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
    reach = len(sought) + edits
    best = None
    for first, past in edges.reshape(-1, 2).tolist():
        for at in range(first, max(first + 1, past - reach + 1), max(_BLOCK, 3 * reach)):
            stop = min(past, at + max(_BLOCK, 3 * reach) + reach)
            changed, spelling, start, end = _closest(found[at:stop], code, lowered[at:stop], sought)
            key = (changed, spelling, at + start, at + end)
            if changed <= edits and end > start and (best is None or key < best):
                best = key
    if best is None:
        return None
    return {"start_pos": words[best[2]].start(), "end_pos": words[best[3] - 1].end()}
