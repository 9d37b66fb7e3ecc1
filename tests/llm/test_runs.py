import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from reportlake.llm import runs
from reportlake.llm.queries import QUERIES
from reportlake.llm.recompression import common_extension, grammar, mirrored


def plain_runs(words):
    """Runs by comparing every place with the one a period on, for every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def odd_words(rng, k, most):
    out = []
    while len(out) < most:
        if rng.random() < 0.4:
            out += ([rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8))[: rng.randint(1, 60)]
        else:
            out += [rng.randrange(k) for _ in range(rng.randint(1, 10))]
    return out


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(300):
        documents = [odd_words(rng, rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 3, 8, 30, 120])) for _ in range(rng.randint(1, 6))]
        found = runs.find_runs([np.array(d, dtype=np.int64) for d in documents])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(d) for d in documents]


def test_extensions_from_the_grammar():
    rng = random.Random(2)
    for _ in range(200):
        words = [-1, *odd_words(rng, rng.choice([1, 2, 3, 8]), rng.randint(1, 90)), -2]
        ahead = grammar(np.array(words))
        pairs = [sorted(rng.sample(range(1, len(words) - 1), 2)) for _ in range(40)] if len(words) > 3 else []
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        forward = common_extension(ahead, a, b).tolist()
        behind = common_extension(mirrored(ahead), len(words) - a, len(words) - b).tolist()
        for (x, y), f, g in zip(pairs, forward, behind):
            assert words[x : x + f] == words[y : y + f] and words[x + f] != words[y + f]
            assert words[x - g : x] == words[y - g : y] and words[x - g - 1] != words[y - g - 1]


def test_the_grammar_is_small_and_made_of_rules():
    levels = grammar(np.concatenate([[-1], np.tile(np.arange(777), 300), [-2]]))
    assert len(levels) < 40 and len(levels[-1].symbols) == 3
    assert len(grammar(np.array([-1] + [5] * 100_000 + [-2]))) == 2


ODD = [(None, None), (1, ""), (1, ""), (2, " \t\n"), (3, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a\x0bb\x0ca\rb a b a b x"), (None, "u v " * 9), (6, "w " * 60_000), (7, "x" * 200_000), (8, "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é"), (9, "A a A a A a A a")]


@pytest.mark.parametrize("plant", [False, True])
def test_rows_equal_the_plain_way(docs_of, plant):
    rng = random.Random(3)
    rows = [(100 + i, " ".join(f"w{x}" for x in odd_words(rng, rng.choice([2, 4, 30]), rng.choice([1, 20, 200])))) for i in range(80)]
    short = [r for r in ODD + rows if len(r[1] or "") < 50_000 or plant is False and r[0] == 7]
    got = runs.periodic_runs(docs_of(short), plant).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(*r, plant) for r in short), key=repr)
    long = {r.doc_id: r for r in runs.periodic_runs(docs_of(ODD)).collect()}
    assert (long[6].start, long[6].length, long[6].period, long[6].exponent_milli) == (0, 60_000, 1, 60_000_000)
    assert runs.periodic_runs(docs_of([])).count() == 0


def test_the_query_equals_the_plain_way(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = QUERIES["op11_runs"](spark, folder)
    assert got.columns[:2] == ["doc_id", "n_runs"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5
