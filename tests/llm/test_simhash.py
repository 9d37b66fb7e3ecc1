import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reportlake.llm import simhash
from reportlake.llm.common import Area


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_documents_against_all_pairs(docs_of, spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a B c dd É".split()) for _ in range(rng.choice([0, 1, 2, 3, 5, 40])))) for i in range(150)]
    long = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)]
    rows += [(200 + i, " ".join(long[:i] + ["zz"] + long[i + 1 :])) for i in range(40)]
    rows += [(500, None), (501, "  x y"), (None, "a B c"), (3, rows[3][1]), (502, "w" * 50_000)]
    got = simhash.near_groups(docs_of(rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    groups = {}
    for (i, _), root in zip(rows, roots(prints)):
        groups.setdefault(root, []).append(i)
    lowest = {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}
    want = sorted([(i, f"{p:016x}", lowest[r]) for (i, _), p, r in zip(rows, prints, roots(prints))], key=repr)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == want
    assert simhash.near_groups(docs_of([])).count() == 0
    kept = simhash.drop_near_copies(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert kept.count() == len(groups)


def test_the_registered_query_equals_all_pairs(spark):
    from reportlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(t) for _, t in rows]
    root = roots(prints)
    lowest = {}
    for (i, _), r in zip(rows, root):
        lowest[r] = min(i, lowest.get(r, i))
    got = QUERIES["op3_simhash"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", lowest[r]) for (i, _), p, r in zip(rows, prints, root))


@pytest.mark.parametrize("group", [2, 5, 48])
def test_links_of_dense_fingerprints(spark, monkeypatch, group):
    """Chains, stars and full balls, also where most variants are too full to compare."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(group)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(50):
            flips = rng.choice(64, size=rng.integers(0, 6), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
        chain = centre
        for b in rng.permutation(64)[:30].reshape(-1, 3):
            chain ^= sum(1 << int(x) for x in b)
            prints.add(chain)
    prints = sorted(prints)
    area = Area(spark)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print bigint")
    found = {r.node: r.root for r in simhash.components(simhash.link(df, area), area).collect()}
    signed = [simhash._signed(p) for p in prints]
    want = {}
    for p, r in zip(signed, roots(prints)):
        want.setdefault(r, set()).add(p)
    got = {}
    for p in signed:
        got.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
