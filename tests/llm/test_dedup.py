import hashlib

import xxhash
from pyspark.sql import functions as F

from reportlake.llm import dedup
from reportlake.llm.common import Area, id_and_text, with_row


def plain(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(5, "Abc É"), (7, "aBC É"), (9, "abc é"), (1, None), (2, ""), (3, "x" * 200_000), (4, "X" * 200_000), (None, "abc É"), (7, "ABC É"), (None, "only"), (8, " ")]


def test_groups_equal_the_plain_way(docs_of):
    for rows in (ROWS, ROWS[:1], []):
        for largest in (True, False):
            got = dedup.exact_groups(docs_of(rows), largest).collect()
            assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got], key=repr) == plain(rows, largest)


def test_one_row_of_each_text_stays_with_all_columns(docs_of):
    docs = docs_of(ROWS)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    seven = max(("aBC É", "ABC É"), key=xxhash.xxh64_intdigest)
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in kept.collect()), key=repr) == sorted(
        [(7, seven), (9, "abc é"), (2, ""), (4, "X" * 9), (None, "only"), (8, " ")], key=repr
    )
    assert sum(r.kept for r in dedup.exact_groups(docs).collect()) == 6


def test_a_text_in_most_rows_moves_once_a_run(docs_of):
    docs = docs_of([(i, "same" if i % 3 else f"text {i}") for i in range(600)]).repartition(8)
    got = dedup.exact_groups(docs).where("doc_id % 3 <> 0").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(599, 400)]


def test_runs_end_sorted_in_the_partition_of_their_digest(docs_of, spark):
    docs = docs_of([(i, f"text {i % 400}") for i in range(3000)]).repartition(7)
    area = Area(spark)
    entries = dedup.digests(id_and_text(*with_row(docs, area)), area)
    found = dedup.merged_runs(entries, True)
    runs = dedup.FAN ** dedup.exchanges(spark)
    rows = found.withColumn("partition", F.spark_partition_id()).select("partition", "run", "digest", "size", "keep.doc_id").collect()
    assert len(rows) == 400 and sum(r["size"] for r in rows) == 3000
    assert all(r.partition == r.run == int.from_bytes(r.digest[:4], "big") % runs for r in rows)
    assert [(r.run, r.digest) for r in rows] == sorted((r.run, r.digest) for r in rows)
    assert {r.doc_id for r in rows} == set(range(2600, 3000))


def test_a_leaf_is_sorted_with_one_entry_a_text(docs_of, spark, monkeypatch):
    rows = [(i, t) for i in range(50) for t in ("a", "A", f"b{i % 3}")] + [(None, "a")]
    area = Area(spark)
    entries = dedup.digests(id_and_text(*with_row(docs_of(rows).coalesce(1), area)), area)
    batches = entries.toArrow().to_batches(max_chunksize=7)
    for largest, ends in ((True, {49, 48, 47}), (False, {0, 1, 2})):
        (whole,) = dedup._leaves(largest)(iter(batches))
        assert whole["digest"].to_pylist() == sorted(set(entries.toPandas()["digest"].map(bytes)))
        assert sum(whole["size"].to_pylist()) == len(rows)
        assert set(whole["doc_id"].to_pylist()) == ends | {49 if largest else 0}
    assert list(dedup._leaves(True)(iter([]))) == []
    monkeypatch.setattr(dedup, "LEAF", 20)
    assert sum(sum(b["size"].to_pylist()) for b in dedup._leaves(True)(iter(batches))) == len(rows)
