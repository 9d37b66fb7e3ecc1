import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from reportlake.llm import pii
from reportlake.llm.queries import QUERIES

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text or "") if good(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        base = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(joined(base).split(",")) - {""} <= set(spans)
        key = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)


@pytest.fixture(scope="module")
def decoder():
    return pii.Decoder(pii.Field().train())


def test_patterns_equal_the_plain_ones():
    rng = random.Random(1)
    alphabet = "ab@@..--__%++0011255 4(()é\n"
    for _ in range(30000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)
    text = "a" * 300_000 + "@" * 1000 + "1" * 300_000 + "." * 1000 + "+1" + "(" * 1000
    assert pii.base_spans(text) == []


def test_odd_rows(docs_of):
    texts = [None, "", " \n", "é🙂 a@b.cc, 10.0.0.1 +49 30 1234567", "4111 1111 1111 1111\n" * 3000, "x" * 200_000]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]).coalesce(1)
    check(pii.find_personal(docs).collect(), [*texts, texts[3], texts[3]])
    assert pii.find_personal(docs_of([])).count() == 0


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_pii"](spark, folder).collect()
    check(rows, [text[r.doc_id] for r in rows])
    assert sum(r.n_email for r in rows) > 0 and sum(r.n_card for r in rows) > 0


def test_decoding_is_the_best_of_all_labellings(decoder):
    for text in ("call (555) 010-2345 now", "a 1.2.3.4 b\n+1 555 0100"):
        start, _, line, shape = pii.words_and_shapes(text)
        got = decoder.states(shape, line)
        for number in set(line.tolist()):
            own = np.flatnonzero(line == number)
            s = shape[own]
            before, after = [pii.SHAPES, *s[:-1]], [*s[1:], pii.SHAPES]
            score = decoder.own[s] + decoder.before[before] + decoder.after[after]

            def value(states):
                return decoder.first[states[0]] + sum(score[t, q] for t, q in enumerate(states)) + sum(decoder.moves[a, b] for a, b in zip(states, states[1:]))

            best = max(value(q) for q in itertools.product(range(len(pii.STATES)), repeat=len(own)))
            assert value(got[own].tolist()) == pytest.approx(best, abs=1e-3)


def test_the_field_adds_forms_it_was_not_shown(decoder):
    texts = ["please dial (555) 0177-2299 today", "card 4111.1111.1111.1111 is gone", "nothing 1234 in 2020", "mail josé@büro.example now"]
    found = [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts, pii.field_spans(texts, decoder))]
    assert found[0] == [("phone", "(555) 0177-2299")]
    assert found[1] == [("card", "4111.1111.1111.1111")]
    assert found[2] == []
    assert found[3] == [("email", "josé@büro.example")]


def test_training_fits_the_table(decoder):
    wrong = sum(
        [x for x in pii.field_spans([text], decoder)[0]] != [x for x in spans if pii._checked(x[0], text[x[1] : x[2]])]
        for text, spans in pii.labelled_lines()
    )
    assert wrong <= 1


def test_spans_apart_from_others_in_a_text_of_many():
    rng = random.Random(2)
    for _ in range(300):
        cut = lambda n: [("x", a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, n))]
        more, base = cut(12), cut(6)
        assert pii._apart(more, base) == [x for x in more if all(x[2] <= a or b <= x[1] for _, a, b in base)]
    text = " ".join(f"person{k}@example.org lives at Main Street {k}" for k in range(20_000))
    began = time.time()
    pii._apart([("x", k, k + 3) for k in range(0, len(text), 5)], pii.base_spans(text))
    assert time.time() - began < 5
