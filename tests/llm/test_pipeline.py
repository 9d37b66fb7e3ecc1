import pytest

import corpus_pipeline
from reportlake.llm.common import Area

from tests.llm.test_near import kept_by_all_pairs
from tests.llm.test_packing import check_packed

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_stages_against_the_plain_way(spark):
    """Every stage's rows from its own input, and the columns it must return."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, area, seen = docs.columns, Area(spark), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = area.keep(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= {r.doc_id for r in before}
        seen.append(name)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            known = [r.doc_id for r in before if r.doc_id in labels]
            assert sum((i in after) == labels[i] for i in known) / len(known) > 0.97
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), -1))
            assert after == set(last.values())
        if name == "near_dedup":
            assert after == {i for i, _ in kept_by_all_pairs([(r.doc_id, r.text) for r in before])}
    assert seen == ["quality", "exact_dedup", "near_dedup", "decontaminate"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packed(corpus_pipeline.run(spark, FOLDER).collect(), rows)


ODD = [(None, None), (1, ""), (1, ""), (2, "Same text here"), (3, "same TEXT here"), (None, "same text here"), (4, "w " * 60_000), (5, "é" * 50_000), (6, " ")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_an_empty_table(spark, docs_of, name, stage):
    docs = docs_of(ODD)
    found = stage(spark, docs, FOLDER)
    assert stage(spark, docs_of([]), FOLDER).count() == 0
    if name == "pack":
        check_packed(found.collect(), ODD)
        return
    rows = found.collect()
    assert found.columns == docs.columns
    texts = [r.text for r in rows]
    assert set(texts) <= {t for _, t in ODD}
    if name == "exact_dedup":
        assert sorted(map(lower, texts)) == sorted({lower(t) for _, t in ODD})
        assert {r.doc_id for r in rows if lower(r.text).startswith("same")} == {3}
    if name == "near_dedup":
        assert len([t for t in texts if not (t or "").strip()]) == 1
    if name == "decontaminate":
        assert len(rows) == len(ODD)
