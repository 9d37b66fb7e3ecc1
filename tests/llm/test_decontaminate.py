import itertools
import math
import random
import re

from pyspark.sql import functions as F

from reportlake.llm import decontaminate as d
from reportlake.llm.queries import QUERIES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlap(doc, item):
    """Whether aligned words of any window are equal often enough, tried everywhere."""
    size = min(len(item), d.WINDOW)
    need = math.ceil(size * d.SHARE - 1e-9)
    for a in range(-size, len(doc)) if item else ():
        for b in range(len(item) - size + 1):
            if sum(0 <= a + k < len(doc) and doc[a + k] == item[b + k] for k in range(size)) >= need:
                return True
    return False


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, seed string")


def test_every_window_with_two_substitutions_holds_a_seed():
    for gone in itertools.combinations(range(d.WINDOW), 2):
        assert any(
            not {at + k for k in mask} & set(gone) for mask in d.MASKS for at in range(d.WINDOW - d.SPAN + 1)
        )


def test_overlaps_against_brute_force(docs_of, spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([13, 14, 20, 45])))) for k in range(25)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "too short to say"), (None, " ".join(rng.choices(vocabulary, k=15)))]
    rows = []
    for k in range(160):
        body = rng.choices(vocabulary, k=rng.choice([5, 12, 60, 300]))
        part = words(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            if part:
                part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(body))
        rows.append((k, "! ".join(body[:at] + [w.upper() for w in part] + body[at:])))
    rows += [(500, None), (501, ""), (None, items[3][1]), (3, rows[3][1]), (502, "x " * 30_000 + items[5][1])]
    want = sorted(((i, j) for i, t in rows for j, u in items if overlap(words(t)[-400:], words(u))), key=repr)
    table = benchmark(spark, [(i, t, "x") for i, t in items])
    for most in (d.BLOCK_SEEDS, 100):  # in one block, and in several
        monkeypatch.setattr(d, "BLOCK_SEEDS", most)
        found = d.overlaps(docs_of(rows), table)
        assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr) == want
    kept = d.drop_contaminated(docs_of(rows), table)
    hit = {i for i, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in hit), key=repr)
    assert kept.columns == docs_of(rows).columns
    assert d.overlaps(docs_of([]), table).count() == 0
    assert d.overlaps(docs_of(rows), benchmark(spark, [])).count() == 0


def test_every_admitted_substitution_is_found_in_items_of_any_size(docs_of, spark, monkeypatch):
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 21)]
    rows = []
    for n, text in items:
        item = text.split()
        size = min(n, d.WINDOW)
        for gone in range(size - d.needed(size) + 2):  # one more than is admitted as well
            for places in itertools.combinations(range(size), gone):
                shift = rng.randrange(n - size + 1)
                own = [f"q{k}" if k - shift in places else w for k, w in enumerate(item)]
                own = own[shift : shift + size] if n >= d.WINDOW else own
                rows.append((len(rows), " ".join([*rng.choices("abc", k=rng.randrange(4)), *own, *rng.choices("abc", k=rng.randrange(3))])))
    table = benchmark(spark, [(i, t, "x") for i, t in items] + [(50, items[14][1], "x"), (60, "", None), (61, None, None)])
    split = {i: t.split() for i, t in items} | {50: items[14][1].split()}
    want = sorted((i, j) for i, t in rows for j, u in split.items() if overlap(t.split(), u))
    assert len(want) > 700
    for most in (d.BLOCK_SEEDS, 60):
        monkeypatch.setattr(d, "BLOCK_SEEDS", most)
        assert sorted((r.doc_id, r.item_id) for r in d.overlaps(docs_of(rows), table).collect()) == want
        kept = {r.doc_id for r in d.drop_contaminated(docs_of(rows), table).collect()}
        assert kept == {i for i, _ in rows} - {i for i, _ in want}


def test_a_passage_in_half_of_the_items_is_one_seed_row(docs_of, spark, monkeypatch):
    common = " ".join(f"c{k}" for k in range(20))
    items = [(i, (common + " " if i % 2 else "") + " ".join(f"i{i}x{k}" for k in range(15))) for i in range(60)]
    rows = [(i, f"start {common} end" if i % 3 == 0 else f"clean {i} text " * 6) for i in range(30)]
    table = benchmark(spark, [(i, t, "x") for i, t in items])
    shared = d.benchmark_seeds(table).where(F.array_contains("item_words", "c2"))
    assert shared.drop("item_id").distinct().count() < shared.count() / 3
    monkeypatch.setattr(d, "BLOCK_SEEDS", 500)
    kept = {r.doc_id for r in d.drop_contaminated(docs_of(rows), table).collect()}
    assert kept == {i for i in range(30) if i % 3}
    found = d.overlaps(docs_of(rows), table).groupBy("doc_id").count().collect()
    assert {tuple(r) for r in found} == {(i, 30) for i in range(0, 30, 3)}


def test_short_items_are_found_without_substitution(docs_of, spark):
    item = "one two three four five six seven eight"
    found = d.overlaps(docs_of([(1, f"a {item} b"), (2, "one two")]), benchmark(spark, [(1, item, None)]))
    assert [(r.doc_id, r.item_id, r.first_word, r.equal_words) for r in found.collect()] == [(1, 1, 1, 8)]


def test_the_registered_query_finds_whole_passages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    want = set()
    for item_id, text in items:
        item = words(text)
        runs = {tuple(item[k : k + 11]) for k in range(len(item) - 10)}
        for doc_id, body in docs:
            doc = words(body)
            if any(tuple(doc[k : k + 11]) in runs for k in range(len(doc) - 10)):
                want.add((doc_id, item_id))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"](spark, folder).collect()}
    assert want and got >= want


def test_the_plan_is_native_and_leaves_texts_in_place(docs_of, spark, plan_of):
    folder = "/root/testdata/sf0.001"
    plan = plan_of(QUERIES["op2_decontaminate"](spark, folder))
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "words" not in exchange
