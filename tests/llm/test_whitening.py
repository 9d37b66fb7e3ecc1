import math

import numpy as np
import pytest

from reportlake.llm import whitening
from reportlake.llm.bidiagonal import leading_components, squared_singular_values
from reportlake.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, n string"
RNG = np.random.default_rng(4)
TURN = np.linalg.qr(RNG.normal(size=(30, 30)))[0]
MATRICES = {
    "random": RNG.normal(size=(3000, 64)),
    "fewer rows than columns": RNG.normal(size=(10, 24)),
    "one row": RNG.normal(size=(1, 5)),
    "zeros": np.zeros((4, 5)),
    "equal values": np.eye(6),
    "equal values in blocks": np.diag([5.0, 5, 5, 3, 3, 1]),
    "equal values, turned": np.diag([3.0] * 10 + [1.0] * 20) @ TURN,
    "graded": np.diag(10.0 ** -np.arange(30)) @ TURN,
    "graded, rising": np.diag(10.0 ** np.arange(-30, 0)) @ TURN,
    "close values": np.diag(1 + 1e-9 * np.arange(30)) @ TURN,
    "one column": RNG.normal(size=(50, 1)),
    "equal columns": np.ones((30, 16)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_the_solver(name):
    a = MATRICES[name]
    width = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((width - len(r), width))])
    values, top, vectors = leading_components(r, min(4, width))
    want = np.zeros(width)
    want[: len(r)] = np.linalg.svd(r, compute_uv=False) ** 2
    most = want.max() or 1.0
    assert np.abs(values - want).max() <= 1e-13 * most
    assert np.abs(a.T @ a @ vectors.T - vectors.T * top).max() <= 1e-13 * most * (1e3 if name == "close values" else 1)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-11


def test_small_singular_values_keep_their_digits():
    diagonal, upper = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(1.0, 12.0) / 3
    from fractions import Fraction

    # the inverse of B is triangular with entries known exactly: its largest value is the least of B
    inverse = [[Fraction(0)] * 12 for _ in range(12)]
    for j in range(12):
        inverse[j][j] = 1 / Fraction(diagonal[j])
        for i in range(j - 1, -1, -1):
            inverse[i][j] = -Fraction(upper[i]) * inverse[i + 1][j] / Fraction(diagonal[i])
    least = 1 / np.linalg.norm(np.array([[float(v) for v in row] for row in inverse]), 2) ** 2
    assert abs(squared_singular_values(diagonal, upper)[-1] / least - 1) < 1e-13


def plain(rows):
    """By whole numbers and the eigenvectors of the covariance itself."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in good]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    if not width:
        return []
    mean = np.array([s / n for s in sums])
    centred = np.array(distinct, dtype=float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for (i, _), row in zip(good, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        for k in range(1, min(4, width) + 1):
            value = values[-k]
            real = value > 1e-12 * max(values[-1], 1e-300)
            whitened = (np.array(row) - mean) @ vectors[:, -k] / math.sqrt(value) if real else None
            out.append((i, k, n, deviation if deviation < 1 << 63 else None, whitened, value / values.sum() if values[-1] > 0 else None, real))
    return out


def check(got, rows):
    want = sorted(plain(rows), key=lambda r: (repr(r[:4])))
    got = sorted(map(tuple, got), key=lambda r: (repr(r[:4])))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = ([r for r in side if r[1] == k] for side in (got, want))
        if not b[0][6]:
            assert all(r[4] is None for r in a)
            continue
        mine, theirs = (np.array(sorted([(repr(r[:4]), r[4]) for r in side]), dtype=object)[:, 1].astype(float) for side in (a, b))
        sign = 1 if mine @ theirs > 0 else -1
        assert np.abs(mine * sign - theirs).max() < 1e-8
        assert max(abs(r[5] - s[5]) for r, s in zip(a, b)) < 1e-12
        assert all(r[6] < 1e-9 for r in a)


def vectors(rng, size, width):
    spread = np.linspace(2, 0.1, width)
    return [(i, (rng.normal(size=width) * spread).astype(float).tolist()) for i in range(size)]


CASES = {
    "mixed": [*vectors(np.random.default_rng(1), 400, 9), (1, None), (2, [0.5, None] + [0.0] * 7), (3, [math.nan] * 9), (4, [math.inf] * 9), (None, [-0.0] * 9), (7, [0.25] * 9), (7, [0.25] * 9)],
    "repeated": [(i % 5, v) for i, (_, v) in enumerate(vectors(np.random.default_rng(2), 12, 3) * 20)],
    "shorter ones": [*vectors(np.random.default_rng(3), 60, 5), (90, []), (91, [1.0, 2.0])],
    "one": [(1, [1.0, 2.0, 3.0, 4.0, 5.0])],
    "equal": [(1, [1.0, 2.0])] * 3,
    "one dimension": [(i, [float(i % 7)]) for i in range(50)],
    "no dimension": [(1, []), (2, [])],
    "nothing left": [(1, None), (2, [math.nan])],
    "empty": [],
    "large": [(i, [3e9 * v[0], 1e12 * v[1]]) for i, v in vectors(np.random.default_rng(5), 40, 2)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("partitions", [1, 40])
def test_rows_equal_the_plain_way(spark, case, partitions):
    rows = CASES[case]
    df = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], VECTORS).repartition(partitions)
    check(whitening.whiten(df).collect(), [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])


def test_triangles_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = vectors(np.random.default_rng(6), 500, 6)
    df = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], VECTORS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(whitening.whiten(df).collect(), rows)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_the_query_equals_the_plain_way(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = QUERIES["op12_whitening"](spark, folder)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), rows)
