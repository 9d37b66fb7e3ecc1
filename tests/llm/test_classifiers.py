import zlib

import numpy as np
import pytest

from reportlake.llm import grams, language, quality
from reportlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_codes_are_those_of_each_text_alone():
    texts = [b"", b"a", b"abcdef", "é漢".encode() * 50]
    together = grams.codes(texts, (1, 2, 3), 12)
    assert [len(c) for c in together] == [sum(max(0, len(t) - n + 1) for n in (1, 2, 3)) for t in texts]
    for text, own in zip(texts, together):
        assert np.array_equal(own, grams.codes([text], (1, 2, 3), 12)[0])


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(3), r) for r in x]
    w, b = grams.dual_coordinate_descent(rows, y, 3, cost=0.5, epochs=400)

    def loss(w, b):
        return (w @ w + b * b) / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + 0.02 * rng.normal(size=3), b + 0.02 * rng.normal()) + 1e-4


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language"](spark, FOLDER).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) / len(unseen) > 0.98


def test_quality_of_held_out_documents(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in unseen) / len(unseen) > 0.97


ODD = [(1, None), (2, ""), (3, "12 34 !!"), (None, "with no id"), (4, "x" * 200_000), (4, "x" * 200_000), (5, "é"), (6, "²")]


def test_odd_rows_and_nothing_to_learn_from(docs_of, spark):
    rows = language.identify(docs_of(ODD)).collect()
    assert len(rows) == len(ODD) and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, text string")
    assert {(r.score, r.predicted) for r in quality.score_quality(docs_of(ODD), none).collect()} == {(0.5, 1)}
    assert language.identify(docs_of([])).count() == quality.score_quality(docs_of([]), none).count() == 0
    k = next(i for i in (1, 2, 3, 6) if not held_out(i))
    one = spark.createDataFrame([(k, 0, None, "x"), (k, 0, None, "x"), (99, 0, 1, "x"), (5, None, 1, "x"), (None, 0, 0, "x")], none.schema)
    assert {r.predicted for r in quality.score_quality(docs_of(ODD), one).collect()} == {0}
    assert quality.keep_good(docs_of(ODD), none).columns == docs_of(ODD).columns


def test_family_first_then_pairs(spark):
    text = {"en": "the and of with", "de": "der die und mit", "fr": "le la des avec", "es": "el los con que", "xx": "qo qa qi qu"}
    rows = [(i, text[x] * (1 + i % 3), x) for i, x in enumerate(list(text) * 30)]
    docs = spark.createDataFrame(rows + [(900, "12", "en"), (901, None, "de"), (902, "the of", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert all(got[i] == x for i, _, x in rows)
    assert (got[900], got[901], got[902]) == ("und", "und", "en")
    assert language.family_of("en-GB") == language.family_of("de") != language.family_of("fr")


@pytest.mark.parametrize("limit", [3, 50])
def test_the_sample_is_bounded(docs_of, spark, limit):
    docs = docs_of([(i, "good words here" if i % 2 else "$$$ ### !!!") for i in range(900)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(900)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels, limit).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_the_sample_is_of_the_texts_that_are_there(docs_of, spark):
    """Few of many labelled ids have documents, and some stand on many rows."""
    docs = docs_of([(i, f"good words here {i}" if i % 2 else f"$$$ ### !!! {i}") for i in range(60)] + [(i, f"good words here {i}" if i % 2 else f"$$$ ### !!! {i}") for i in range(10)] * 200)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20_000)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels, 10).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_a_repeated_row_is_one_training_text(docs_of, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Model", lambda rows, labels, shares: seen.append((len(rows), shares.tolist())))
    learned = [i for i in range(30) if not held_out(i)]
    docs = docs_of([(i, f"text {i}") for i in range(30)] + [(learned[0], f"text {learned[0]}")] * 300)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    quality.train(docs, labels)
    odd = sum(i % 2 for i in learned)
    assert seen == [(len(learned), [len(learned) - odd, odd])]


def test_ids_of_another_whole_type(spark):
    from reportlake.llm import language, multiset, pii, runs, secret_scan

    docs = spark.createDataFrame([(i, "one two three " * 5, "en") for i in range(6)], "doc_id int, text string, lang string")
    for operator in (language.identify, runs.periodic_runs, multiset.fingerprints, secret_scan.find_secrets, pii.find_personal):
        found = operator(docs)
        assert dict(found.dtypes)["doc_id"] == "bigint"
        assert sorted(r.doc_id for r in found.collect()) == list(range(6))


def test_places_come_back_from_bytes_of_bounded_number():
    rng = np.random.default_rng(1)
    size = quality._PLACES
    for n in (0, 1, 4000, 4096, 4097, 5000, size):
        places = np.sort(rng.choice(size, n, replace=False)).astype(np.int32)
        data = grams.packed(places, size)
        assert np.array_equal(grams.unpacked(data, size), places) and len(data) <= size // 8


def test_many_labels_share_the_sample(spark):
    rows = spark.createDataFrame([(i, f"l{i % 20}") for i in range(4000)], "row int, label string")
    from pyspark.sql import functions as F

    drawn = {r.label: r["count"] for r in grams.labelled_sample(rows, "label", F.col("row"), 150, 400).groupBy("label").count().collect()}
    assert len(drawn) == 20 and max(drawn.values()) <= 60 and sum(drawn.values()) < 700
    assert grams.labelled_sample(rows, "label", F.col("row"), 150, 5).count() > 0


def plain_buckets(text, sizes, bits):
    """The bucket of every n-gram, one at a time."""
    primes = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
    out = []
    for n in sizes:
        for at in range(len(text) - n + 1):
            mixed = sum(text[at + k] * primes[k] for k in range(n)) % 2**32
            mixed ^= mixed >> 15
            out.append(mixed * (0x2C1B3C6D + 2 * n) % 2**32 >> (32 - bits))
    return out


def plain_machine(rows, signs, cost):
    """Hinge-loss weights of dense rows by cyclic dual ascent over the whole Gram matrix."""
    x = np.hstack([np.array(rows), np.ones((len(rows), 1))])
    gram = (x @ x.T) * np.outer(signs, signs)
    alpha = np.zeros(len(rows))
    for _ in range(3000):
        before = alpha.copy()
        for i in range(len(rows)):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0.0), cost)
        if np.abs(alpha - before).max() < 1e-10:
            break
    return x.T @ (alpha * signs)


def test_quality_scores_equal_the_plain_way(docs_of, spark):
    rng = np.random.default_rng(3)
    words = [["report", "clear", "method", "result"], ["buy", "cheap", "click", "win"], ["the", "of", "and", "to"]]
    rows = [(i, " ".join(rng.choice(words[i % 2] + words[2] * 2, 12))) for i in range(70)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(70)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(rows + [(99, ""), (98, None)]), labels).collect()}

    def flags(text):
        row = np.zeros(quality._PLACES)
        row[plain_buckets(text.encode(), quality.SIZES, quality.BITS)] = 1
        own = text.split()
        again = sum(own[k] == own[k - 1] for k in range(1, len(own)))
        if again:
            row[2**quality.BITS : 2**quality.BITS + int(16 * again / len(own)) + 1] = 1
        return row

    learned = [(flags(t), int(i % 2 == 0)) for i, t in rows if not held_out(i)]
    of = [1 + sum(f for f, y in learned if y == c) for c in (0, 1)]
    ratio = np.log(of[1] / of[1].sum()) - np.log(of[0] / of[0].sum())

    def scaled(row):
        length = np.linalg.norm(row * ratio)
        return row * ratio / (length or 1)

    y = np.array([c for _, c in learned])
    weights = plain_machine([scaled(f) for f, _ in learned], np.where(y == 1, 1.0, -1.0), quality.COST)
    margin = {i: scaled(flags(t or "")) @ weights[:-1] + weights[-1] for i, t in rows + [(99, ""), (98, None)]}
    slope, shift = quality.logistic(np.array([margin[i] for i, _ in rows if not held_out(i)]), y, np.ones(len(y)))
    for i, m in margin.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * m + shift))), abs=0.02)


def test_languages_equal_the_plain_way(spark):
    rng = np.random.default_rng(4)
    text = {"en": "the and of with was that", "de": "der die und mit war dass", "fr": "le la des avec que dans", "es": "el los con que para una"}
    rows = [(i, " ".join(rng.choice(text[x].split(), 8)), x) for i, x in enumerate(list(text) * 20)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}

    def vector(t):
        row = np.log1p(np.bincount(plain_buckets(t.lower().encode(), language.SIZES, language.BITS), minlength=2**language.BITS))
        return row / (np.linalg.norm(row) or 1)

    learned = [(vector(t), x) for i, t, x in rows if not held_out(i)]

    def machine(used, positive):
        own = [(v, 1.0 if x in positive else -1.0) for v, x in learned if x in used]
        return plain_machine([v for v, _ in own], np.array([s for _, s in own]), 10.0)

    families = [("en", "de"), ("fr", "es")]
    first = [machine(text, f) for f in families]
    pairs = [machine(f, f[:1]) for f in families]
    for i, t, _ in rows:
        v = np.append(vector(t), 1.0)
        k = int(np.argmax([v @ w for w in first]))
        assert got[i] == families[k][0 if v @ pairs[k] >= 0 else 1]
