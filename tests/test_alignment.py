import random
import re
import time

import pytest

from reportlake.operators.alignment import LETTERS, closest_span


def letters(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(LETTERS, row[-1])


def plain(text, wanted, threshold=0.5):
    """Every stretch of the text against the wanted words."""
    words = list(re.finditer(r"\S+", text))
    sought = wanted.lower().split()
    best = None
    for start in range(len(words) if sought else 0):
        row = [(0, 0)]
        for w in sought:
            row.append((row[-1][0] + 1, row[-1][1] + min(len(w), LETTERS)))
        for end in range(start, len(words)):
            v = words[end].group().lower()
            extra = min(len(v), LETTERS)
            new = [(row[0][0] + 1, row[0][1] + extra)]
            for i, w in enumerate(sought):
                change = (0, 0) if w == v else (1, letters(w[:32], v[:32]))
                new.append(
                    min(
                        (row[i + 1][0] + 1, row[i + 1][1] + extra),
                        (new[-1][0] + 1, new[-1][1] + min(len(w), LETTERS)),
                        (row[i][0] + change[0], row[i][1] + change[1]),
                    )
                )
            row = new
            key = (*row[-1], start, end + 1)
            if row[-1][0] <= int(len(sought) * (1 - threshold) + 1e-9) and (best is None or key < best):
                best = key
    return best and {"start_pos": words[best[2]].start(), "end_pos": words[best[3] - 1].end()}


VOCABULARY = "ab abc abd b bc lung lungs liver Left RIGHT clear no x yy é " + "long" * 20


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [20_000, 2])
def test_the_span_of_all_stretches_compared(seed, block, monkeypatch):
    monkeypatch.setattr("reportlake.operators.alignment._BLOCK", block)
    rng = random.Random(seed)
    vocabulary = VOCABULARY.split()
    hits = 0
    for _ in range(150):
        text = rng.choice([" ", "  ", "\n"]).join(rng.choice(vocabulary[: rng.choice([3, 8, 20])]) for _ in range(rng.randint(0, 30)))
        wanted = [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))]
        if text and rng.random() < 0.6:
            at = rng.randrange(len(text.split()))
            wanted = text.split()[at : at + rng.randint(1, 9)]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(wanted) + 1)
                if k < len(wanted) and rng.random() < 0.5:
                    wanted[k] += "q"
                elif len(wanted) > 1 and k < len(wanted):
                    wanted.pop(k)
                else:
                    wanted.insert(k, "zz")
        found = closest_span(text, " ".join(wanted))
        assert found == plain(text, " ".join(wanted)), (text, wanted)
        hits += found is not None
    assert hits > 30


@pytest.mark.parametrize("kinds, size", [(3000, 8), (3000, 300), (20, 40)])
def test_a_long_text_takes_little_time(kinds, size):
    rng = random.Random(kinds)
    words = [f"w{rng.randrange(kinds)}" for _ in range(100_000)]
    wanted = words[70_000 : 70_000 + size]
    wanted[size // 2] = "oops"
    began = time.time()
    found = closest_span(" ".join(words), " ".join(wanted))
    assert time.time() - began < 5
    before = len(" ".join(words[:70_000])) + 1
    assert found == {"start_pos": before, "end_pos": before + len(" ".join(words[70_000 : 70_000 + size]))}
