import random

import pytest

from reportlake.llm import near, simhash


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(rows):
    """Positions of the rows that stay, of all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for k, g in enumerate(group):
        best[g] = min(best.get(g, k), k, key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    return sorted(rows[k] for k in best.values() if rows[k][0] is not None)


def family(rng, size, words, most):
    base = [rng.choice("abcdefghijkl") * rng.randint(1, 5) for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(words)] = f"z{rng.randrange(1000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [near.BLOCK, 16])
def test_the_stage_against_jaccard_of_all_pairs(docs_of, monkeypatch, block):
    """A few texts of a family, families with strays, and bands dealt out in blocks."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(4)
    texts = [t for words, most in ((60, 2), (150, 3), (150, 6), (400, 20)) for t in family(rng, 40, words, most)]
    texts += ["one two", "One  two", "one two three four five six", "x " * 3000]
    rows = list(enumerate(texts)) + [(900, None), (901, " "), (902, "")]
    rng.shuffle(rows)
    found = near.drop_near_copies(docs_of(rows))
    assert found.columns == docs_of(rows).columns
    assert sorted((r.doc_id, r.text) for r in found.collect()) == kept_by_all_pairs(rows)
    assert near.drop_near_copies(docs_of([])).count() == 0


def test_fingerprints_link_as_well(docs_of):
    """A group goes on through links of either kind, also through rows that go themselves."""
    rng = random.Random(9)
    words = [" ".join(f"v{rng.randrange(10_000)}" for _ in range(60)) for _ in range(3)]
    texts = ["w " * 100, "w " * 100 + words[0], "w " * 8 + words[0], words[1], words[1] + " end", words[2], "", " "]
    rows = [(k, t) for k, t in enumerate(texts)] + [(20 + k, t) for k, t in enumerate(family(rng, 20, 60, 30))] + [(None, None)]
    prints = simhash.fingerprints_of([(t or "").encode() for _, t in rows]).tolist()
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) or (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    kept = {min(k for k, g in enumerate(group) if g == own) for own in group}
    found = near.drop_near_copies(docs_of(rows), fingerprints=True)
    assert sorted(r.doc_id for r in found.collect()) == sorted(rows[k][0] for k in kept)
    assert {0, 3, 5, 6} <= kept and not {1, 2, 4, 7} & kept
    assert {r.doc_id for r in near.drop_near_copies(docs_of(rows)).collect()} >= {0, 1}
    assert near.drop_near_copies(docs_of([]), fingerprints=True).count() == 0


def test_the_pipeline_links_by_fingerprints(spark, docs_of):
    import corpus_pipeline

    docs = docs_of([(1, "w " * 100 + "a b"), (2, "w " * 100 + "c d"), (3, "quite another text of some words")])
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {1, 3}


def test_the_stage_finds_the_near_copies_of_the_documents(spark):
    from corpus_pipeline import exact
    from corpus_pipeline import near as stage

    folder = "/root/testdata/sf0.01"
    docs = exact(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = {r.doc_id for r in stage(spark, docs, folder).collect()}
    assert left == {i for i, _ in kept_by_all_pairs(rows)} and len(left) < len(rows)
