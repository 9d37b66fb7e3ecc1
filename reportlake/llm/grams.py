"""Hashed n-grams of bytes, and linear support vector machines over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def codes(texts: list[bytes], sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each text the buckets of its n-grams of all ``sizes``, repeats included."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    found = []
    for n in sizes:
        mixed = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
        for k in range(n):
            mixed += data[k : k + len(mixed)] * _PRIMES[k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
        found.append((n, (mixed >> np.uint32(32 - bits)).astype(np.int32)))
    out, start = [], 0
    for end in ends.tolist():
        own = [code[start : end - n + 1] for n, code in found if end - n + 1 > start]
        out.append(np.concatenate(own) if own else np.array([], dtype=np.int32))
        start = end
    return out


def dual_coordinate_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model of sparse rows (places, values).

    Minimises |w|^2 / 2 + cost * sum(hinge) through its dual, one row's multiplier at a
    time; the bias is the weight of a constant 1.
    """
    weights, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            places, values = rows[i]
            slope = signs[i] * (float(weights[places] @ values) + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            step = (new - alpha[i]) * signs[i]
            if step:
                largest = max(largest, abs(step))
                alpha[i] = new
                weights[places] += step * values
                bias += step
        if largest < 1e-3:
            break
    return weights, bias


def packed(places: np.ndarray, size: int) -> bytes:
    """Sorted places below ``size`` as 32-bit numbers or as bits, whichever are fewer bytes."""
    if 4 * len(places) < size // 8:
        return places.astype(np.int32).tobytes()
    flags = np.zeros(size, dtype=bool)
    flags[places] = True
    return np.packbits(flags).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    if len(data) < size // 8:
        return np.frombuffer(data, dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=size)).astype(np.int32)


def labelled_sample(rows: DataFrame, label: str, key: Column, limit: int, total: int | None = None) -> DataFrame:
    """About ``limit`` rows of each label at most, by a hash of ``key``, the same at every run.

    With ``total`` labels share that many rows evenly if there are many labels, and have at
    least one each. Only the counts per label come to the driver. The column ``draw`` orders
    the rows.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if total is not None and counts:
        limit = min(limit, max(1, total // len(counts)))
    whole = 1 << 30
    few = F.lit(False)
    for value, count in counts.items():
        few = few | ((F.col(label) == value) & (F.col("draw") < min(whole, int(1.15 * limit / count * whole))))
    return rows.withColumn("draw", F.pmod(F.xxhash64(key), F.lit(whole))).where(few)
