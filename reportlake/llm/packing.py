"""Packing of tokenized documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences and a rest. The rests are
dealt to blocks of bounded size. Several islands evolve packings of each block, a row a
(block, island); between epochs each island's elite moves to its neighbour through a join.

A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent
into the other, removes the bins there that hold the same documents, and puts what they
displace back by best fit. The fewest bins win, then the fullest.
"""

from __future__ import annotations

import heapq
import random
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportlake.llm.common import Area, pieces

SEQUENCE = 2048
VOCABULARY = "word_bpe_49k.json"
BLOCK = 16_000  # pieces an island packs at once, on average
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 4
WELL_FILLED = 0.98
PIECES = "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_TAIL = b".,!?;:$&%#*|"  # ASCII signs: a run of them is one token of the pre-tokenizer
# UTF-8 of a-z and ß to ÿ without the sign ÷: one token of the pre-tokenizer, already normal
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# How a byte-level vocabulary writes bytes that aren't printable: signs from 256 on, in order.
BYTE_SIGNS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
KEPT = 400_000  # words in each of the two generations of the cache


class _Cores(dict):
    """Ids of words of plain letters, from their UTF-8 in lower case.

    These are normal already, and one token each for the pre-tokenizer, so their byte signs
    go to the merges as they are.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.merge, self.older = tokenizer.model.tokenize, {}

    def __missing__(self, core: bytes) -> bytes:
        ids = self.older.get(core)
        if ids is None:
            signs = core.decode("latin-1")
            if not core.isascii():  # letters are their own signs
                signs = signs.translate(BYTE_SIGNS)
            found = [t.id for t in self.merge(signs)]
            ids = struct.pack(f"<{len(found)}I", *found)
        self[core] = ids
        return ids


class _Words(dict):
    """Ids of words as they stand; one that is missing is found when it is looked up."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.older = tokenizer, {}
        self.cores, self.tails = _Cores(tokenizer), {b"": b""}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(_TAIL)
            low = core.lower()
            simple = low.isalpha() or _SIMPLE.fullmatch(low)
            if not simple:  # capitals beyond ASCII
                low = low.decode().lower().encode()
                simple = _SIMPLE.fullmatch(low)
            ids = self.cores[low] + self.tail(word[len(core) :]) if simple else self.encode(word.decode())
        self[word] = ids
        return ids

    def tail(self, tail: bytes) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self.encode(tail.decode())
        return self.tails[tail]


class WordIds:
    """Ids of words between ASCII blanks as little-endian bytes.

    The pre-tokenizer never joins across a blank, so the ids of a text are those of its
    words in turn. Words are looked up in two bounded generations of a cache. What is
    missing goes through the tokenizer; words of plain letters, with or without signs
    behind them, go to its merges directly.
    """

    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        self.words = _Words(Tokenizer.from_file(path))
        self.cores = self.words.cores

    @property
    def older(self) -> dict[bytes, bytes]:
        return self.words.older

    @property
    def older_cores(self) -> dict[bytes, bytes]:
        return self.cores.older

    def texts(self, texts: list[bytes]) -> list[bytes]:
        for cache in (self.words, self.cores):
            if len(cache) > self.kept:
                cache.older = dict(cache)
                cache.clear()
        find = self.words.__getitem__
        return [b"".join(map(find, t.split())) for t in texts]


_encoders: dict[tuple[str, int], WordIds] = {}


def _cut(path: str, most: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, kept) not in _encoders:
            _encoders[path, kept] = WordIds(path, kept)
        encoder = _encoders[path, kept]
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in pieces(batch, "text", 20 * kept):
                out = {n: [] for n in ("item", "doc_id", "piece", "start", "length", "ids_crc32")}
                for k, own in enumerate(encoder.texts(texts)):
                    own += b"\0\0\0\0"
                    for number, at in enumerate(range(0, len(own), 4 * most)):
                        part = own[at : at + 4 * most]
                        for name, value in zip(out, (item, ids[first + k].as_py(), number, at // 4, len(part) // 4, zlib.crc32(part))):
                            out[name].append(value)
                        item += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


class Bins:
    """Bins and what is used in each; finds the fullest that takes a length."""

    def __init__(self, capacity: int, lengths: list[int], held: list[list[int]] | None = None, used: list[int] | None = None):
        self.capacity, self.lengths, self.held, self.used = capacity, lengths, held or [], used or []
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: a bin has r free
        for number, amount in enumerate(self.used):
            self.free[capacity - amount].append(number)
            self.mask |= 1 << (capacity - amount)

    def put(self, items: Iterable[int]) -> Bins:
        """Each item by best fit, in the order given."""
        lengths, held, used, free, mask = self.lengths, self.held, self.used, self.free, self.mask
        for i in items:
            size = lengths[i]
            rooms = mask >> size
            if rooms:
                room = size + (rooms & -rooms).bit_length() - 1
                number = free[room].pop()
                if not free[room]:
                    mask ^= 1 << room
                held[number].append(i)
                used[number] += size
            else:
                room, number = self.capacity, len(held)
                held.append([i])
                used.append(size)
            free[room - size].append(number)
            mask |= 1 << (room - size)
        self.mask = mask
        return self

    @property
    def fitness(self) -> tuple[int, float]:
        return -len(self.held), sum(x * x for x in self.used) / self.capacity**2


def longest_first(items: Iterable[int], lengths: list[int]) -> list[int]:
    return sorted(sorted(items), key=lengths.__getitem__, reverse=True)


def cross(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``b`` in ``a``, and what they displace by best fit."""
    good = WELL_FILLED * a.capacity
    injected = [k for k, amount in enumerate(b.used) if amount >= good and rng.random() < 0.5]
    held, used = [list(b.held[k]) for k in injected], [b.used[k] for k in injected]
    there = {i for own in held for i in own}
    displaced = []
    for own, amount in zip(a.held, a.used):
        if there.isdisjoint(own):
            held.append(list(own))
            used.append(amount)
        else:
            displaced += [i for i in own if i not in there]
    return Bins(a.capacity, a.lengths, held, used).put(longest_first(displaced, a.lengths))


def mutate(bins: Bins, rng: random.Random) -> Bins:
    """Empties the least filled bins and a few others, and puts their documents back."""
    few = max(1, len(bins.held) // 50)
    out = set(heapq.nsmallest(few, range(len(bins.held)), key=bins.used.__getitem__))
    out |= {rng.randrange(len(bins.held)) for _ in range(few)}
    loose = [i for k in out for i in bins.held[k]]
    stay = [k for k in range(len(bins.held)) if k not in out]
    held, used = [bins.held[k] for k in stay], [bins.used[k] for k in stay]
    return Bins(bins.capacity, bins.lengths, held, used).put(longest_first(loose, bins.lengths))


def evolve(lengths: list[int], start: list[list[list[int]]], capacity: int, seed: int) -> list[Bins]:
    """The population after some generations, the fittest first; ``start`` takes part."""
    rng = random.Random(seed)
    everyone = range(len(lengths))
    population = [Bins(capacity, lengths, held, [sum(lengths[i] for i in own) for own in held]) for held in start]
    if not population:
        population = [Bins(capacity, lengths).put(longest_first(everyone, lengths))]
    while len(population) < POPULATION:
        rough = [-x * rng.uniform(0.8, 1) for x in lengths]
        population.append(Bins(capacity, lengths).put(sorted(everyone, key=rough.__getitem__)))
    for _ in range(GENERATIONS):
        for _ in range(POPULATION // 2):
            a, b = rng.sample(population[:POPULATION], 2)
            population.append(mutate(cross(a, b, rng), rng))
        population = sorted(population, key=lambda x: x.fitness, reverse=True)[:POPULATION]
    return population


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for number, own in enumerate(bins):
        for i in own:
            out[i] = number
    return out


def _bins(labels) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, number in enumerate(labels):
        out.setdefault(number, []).append(i)
    return list(out.values())


def _epoch(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for block, island, lengths, come in zip(frame["block"], frame["island"], frame["lengths"], frame["come"]):
                lengths = [int(x) for x in lengths]
                start = [] if come is None else [_bins(x) for x in come]
                best = evolve(lengths, start, capacity, int(block) * 1000 + int(island) * 10 + epoch)
                labels = [_labels(bins.held, len(lengths)) for bins in best[:2]]
                rows.append((block, island, labels, len(best[0].held), best[0].fitness[1]))
            yield pd.DataFrame(rows, columns=["block", "island", "best", "bins", "fill"])

    return run


def _places(bins, lengths) -> list[int]:
    """Where each document starts in its bin."""
    used: dict[int, int] = {}
    out = []
    for number, size in zip(bins, lengths):
        out.append(used.get(number, 0))
        used[number] = out[-1] + size
    return out


def _offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["offsets"] = [_places(b, [x["length"] for x in own]) for b, own in zip(frame["labels"], frame["own"])]
        yield frame


def pack(cut: DataFrame, area: Area, capacity: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """``cut`` (columns of ``PIECES``) with sequence_id and offset."""
    whole = cut.where(F.col("length") == capacity)
    whole = whole.select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    problem = area.keep(
        rest.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("item", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("own")
        )
    )
    islands = problem.select("block", F.col("own.length").alias("lengths"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    # a number of its own: a row is small, but minutes of work are in a few of them
    islands = area.keep(islands.repartition(blocks * ISLANDS, "block", "island"))
    come = islands.select("*", F.lit(None).cast("array<array<int>>").alias("come"))
    for epoch in range(EPOCHS):
        found = area.keep(come.select("block", "island", "lengths", "come").mapInPandas(_epoch(capacity, epoch), "block bigint, island int, best array<array<int>>, bins int, fill double"))
        elite = found.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("best")[0].alias("elite"))
        come = islands.join(found.select("block", "island", "best"), ["block", "island"]).join(elite, ["block", "island"])
        come = come.select("block", "island", "lengths", F.array_append("best", F.col("elite")).alias("come"))
    best = found.groupBy("block").agg(F.max(F.struct(-F.col("bins"), "fill", "island", F.col("best")[0].alias("labels")))["labels"].alias("labels"))
    schema = "block bigint, own array<struct<item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint>>, labels array<int>, offsets array<bigint>"
    placed = problem.join(best, "block").select("block", "own", "labels").mapInPandas(_offsets, schema)
    each = placed.select("block", F.explode(F.arrays_zip("own", "labels", "offsets")).alias("x"))
    packed = each.select("x.own.*", (F.col("block") * (1 << 24) + F.col("x.labels")).alias("sequence_id"), F.col("x.offsets").alias("offset"))
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE, kept: int = KEPT) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and id 0; null text is empty and gives the single id 0. Only
    longer documents are cut. Repeated rows and null ids are packed as rows of their own.
    An empty table gives an empty result. Other columns are ignored. ``kept`` words are in
    each generation of a task's cache; it decides on time and memory alone.
    """
    area = Area(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    cut = area.keep(narrow.mapInArrow(_cut(path, capacity, kept), PIECES))
    return pack(cut, area, capacity).drop("item")
