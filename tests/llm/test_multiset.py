import hashlib
import random

import numpy as np
import pytest

from reportlake.llm import multiset
from reportlake.llm.multiset import decoded, deleted, encoded, inserted, likeness, vector
from reportlake.llm.queries import QUERIES


def plain_vector(text):
    """Digest lanes as numbers, window lanes by counting one window at a time."""
    sums, counts = [0] * multiset.DIGESTS, {}
    for line in text.encode().split(b"\n"):
        digest = hashlib.blake2b(line).digest()
        for k in range(multiset.DIGESTS):
            sums[k] = (sums[k] + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64
        padded = b"\0" * multiset.WINDOW + line
        for end in range(multiset.WINDOW + 1, len(padded) + 1):
            if padded[end - 1]:
                window = padded[end - multiset.WINDOW : end]
                counts[window] = counts.get(window, 0) + 1
    lanes = [0] * multiset.LANES
    for window, n in counts.items():
        low, high = (int.from_bytes(window[k : k + 8], "little") for k in (0, 8))
        m = low * 0x9E3779B97F4A7C15 % 2**64
        m = ((m ^ m >> 32) + high) * 0xBF58476D1CE4E5B9 % 2**64
        m = (m ^ m >> 29) * 0x94D049BB133111EB % 2**64
        lanes[m >> 56] += -n if m >> 55 & 1 else n
    return sums + [x % 2**32 for x in lanes]


TEXTS = ["", "\n", "a", "one line of words", "two\nlines", "é\n\n\n" + "long " * 50, "tab\t\0nul\nend\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_the_vector_by_hand(text):
    assert vector(text.encode()).tolist() == plain_vector(text)


def test_chunks_give_the_same_vector(monkeypatch):
    text = "\n".join("word%d " % (i % 97) * (i % 30) for i in range(300)).encode()
    whole = vector(text)
    monkeypatch.setattr(multiset, "_CHUNK", 50)
    assert (vector(text) == whole).all()


def test_order_insertion_and_deletion():
    rng = random.Random(5)
    lines = [f"paragraph {rng.randrange(40)} says {rng.random()}" for _ in range(60)]
    of = lambda part: vector("\n".join(part).encode())
    mixed = rng.sample(lines, len(lines))
    assert (of(lines) == of(mixed)).all()
    assert (inserted(of(lines[:20]), of(lines[20:])) == of(lines)).all()
    assert (deleted(of(lines), of(lines[20:])) == of(lines[:20])).all()
    assert (of(lines + lines[:1]) != of(lines)).any()
    assert (decoded(encoded(of(lines))) == of(lines)).all()


def test_likeness_follows_the_share_of_equal_windows():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(500))
    for share in (0.1, 0.25, 0.5, 0.9, 1.0):
        cut = int(len(text) * (1 - share))
        other = text[:cut] + " ".join(rng.choice(words) for _ in range(500))[: len(text) - cut]
        near = likeness(vector(text.encode()), vector(other.encode()))
        assert abs(near - (1 - share)) < 0.15, (share, near)
    assert likeness(vector(b""), vector(b"\n")) == 1.0
    assert likeness(vector(b"abc"), vector(b"")) == 0.0


def plain_rows(rows):
    """(doc_id, n_chars, edited_sha256, edited text, text, next text), in the order of ids, nulls first."""
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (doc_id, text) in enumerate(ranked):
        text, after = text or "", ranked[(k + 1) % len(ranked)][1] or ""
        share = len(text) // 4
        new = text[: len(text) - share] + after[:share]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), new, text, after))
    return out


def check_rows(got, rows):
    wanted = plain_rows(rows)
    assert len(got) == len(wanted)
    print_of = lambda t: encoded(vector(t.encode()))
    want = []
    for doc_id, n, digest, new, text, after in wanted:
        a, b, c = (vector(t.encode()) for t in (text, new, after))
        want.append((doc_id, n, digest, print_of(text), print_of(new), likeness(a, b), likeness(a, c)))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((tuple(bytes(r[c]) if "finger" in c else r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)


ODD = [(7, "x\ny" * 40), (None, None), (3, ""), (9, "last one\nis here, and longer than others"), (-5, "é" * 30_000), (4, " "), (2**62 + 1, "big"), (2**62, "bigger\n")]


@pytest.mark.parametrize("count", [0, 1, 2, 8, 200])
def test_rows_equal_the_plain_way(docs_of, count):
    rng = random.Random(count)
    rows = ODD[:count] + [(100 + 3 * i, "\n".join("ab cd\n" * rng.randint(0, 9) + str(i) for _ in range(rng.randint(0, 9)))) for i in range(count - len(ODD))]
    rng.shuffle(rows)
    check_rows(multiset.fingerprints(docs_of(rows)).collect(), rows)


def test_repeated_ids_and_rows_follow_each_other(docs_of):
    rows = [(1, "same text"), (1, "same text"), (None, "n"), (None, "n"), (1, "same text")]
    check_rows(multiset.fingerprints(docs_of(rows).coalesce(1)).collect(), rows)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_the_query_equals_the_plain_way(spark, partitions):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = QUERIES["op13_fingerprint"](spark, folder)
        assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        got = [{**r.asDict(), **{c: bytes.fromhex(r[c]) for c in ("fingerprint", "edited_fingerprint")}} for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check_rows(got, rows)
    usual = [r for r in got if r["n_chars"] > 200]
    assert sum(r["near_edited"] > 0.4 for r in usual) > 0.95 * len(usual)
    assert sum(r["near_next"] < 0.3 for r in usual) > 0.9 * len(usual)
    print(np.mean([r["near_edited"] for r in usual]), np.mean([r["near_next"] for r in usual]))
