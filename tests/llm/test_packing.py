import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reportlake.llm import packing
from reportlake.llm.common import Area
from reportlake.llm.queries import QUERIES


def plain_pieces(rows, most=packing.SEQUENCE):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for number, at in enumerate(range(0, len(ids), most)):
            part = ids[at : at + most]
            out.append((i, number, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_packed(found, rows, most=packing.SEQUENCE):
    assert sorted([tuple(r)[:5] for r in found], key=repr) == plain_pieces(rows, most)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for at, size in sorted(own):
            assert at == end
            end += size
        assert end <= most
    return len(bins)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Don't STOP!!! it's  we'll"), (5, "a b c\x1cd\u0085e"),
    (6, "İstanbul İ é École Straße ﬁ"), (7, "x" * 3000 + " 12345 ½²"), (8, "<|endoftext|> a<|startoftext|>b"),
    (9, "漢字 かな 한국어 🙂🙂"), (None, "no id"), (4, "Don't STOP!!! it's  we'll"), (10, "word, " * 9000), (11, "ΣΑΣ Ǆ ŉ a. b.c. $$$ &&& a%%% '"),
]


def test_pieces_equal_the_tokenizer(docs_of):
    check_packed(packing.pack_documents(docs_of(ODD)).collect(), ODD)
    assert packing.pack_documents(docs_of([])).count() == 0


def test_a_small_cache_gives_the_same_ids_and_stays_small(docs_of):
    words = [[f"w{n}x{k}".encode() for k in range(500)] for n in range(20)]
    words = [[w.translate(bytes(c + 49 if 48 <= c < 58 else c for c in range(256))) for w in own] for own in words]
    path = public_tokenizers.path(packing.VOCABULARY)
    small, large = packing.WordIds(path, kept=100), packing.WordIds(path)
    for own in words:
        assert small.texts([b" ".join(own)]) == large.texts([b" ".join(own)])
        assert max(map(len, (small.words, small.older, small.cores, small.older_cores))) <= 100 + 500
    check_packed(packing.pack_documents(docs_of(ODD), kept=2).collect(), ODD)


def test_the_registered_query_packs_closely(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op10_pack"](spark, folder).collect()
    used = check_packed(found, rows)
    assert used <= math.ceil(sum(r.length for r in found) / packing.SEQUENCE) * 1.02 + 1


@pytest.mark.parametrize("seed", range(3))
def test_evolution_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 99) for _ in range(300)]
    best = packing.evolve(lengths, [], 100, seed)[0]
    plain = packing.Bins(100, lengths).put(packing.longest_first(range(300), lengths))
    assert sorted(i for own in best.held for i in own) == list(range(300))
    assert all(sum(lengths[i] for i in own) == used <= 100 for own, used in zip(best.held, best.used))
    assert best.fitness >= plain.fitness


def test_many_blocks(spark):
    rng = random.Random(1)
    rows = [(k, k, 0, 0, rng.choice([1, 30, 64, rng.randint(1, 64)]), 0) for k in range(2000)]
    found = packing.pack(spark.createDataFrame(rows, packing.PIECES), Area(spark), capacity=64, block=150).collect()
    assert sorted(r.item for r in found) == list(range(2000))
    used = len({r.sequence_id for r in found})
    assert used <= sum(r[4] for r in rows) / 64 * 1.03 + 2


def test_a_word_is_merged_once_whatever_its_case_and_signs():
    encoder = packing.WordIds(public_tokenizers.path(packing.VOCABULARY))
    merge, merged = encoder.cores.merge, []
    encoder.cores.merge = lambda signs: merged.append(signs) or merge(signs)
    texts = [b"Liver, liver LIVER! spleen", "Fígado fÍgado. liver%".encode()]
    for text, ids in zip(texts, encoder.texts(texts)):
        assert ids == encoder.words.encode(text.decode())
    assert len(merged) == 3
