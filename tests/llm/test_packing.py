import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marlpit.llm import packing
from marlpit.llm.byte_bpe import ByteBPE
from marlpit.llm.packing import DEFAULT_TOKENIZER, best_fit_decreasing, cut, lower_bound, pack_documents

PATH = public_tokenizers.path(DEFAULT_TOKENIZER)
TEXTS = ["", " ", "a  b   c \n d\t\n\n e ", "don't <|endoftext|> x<|endoftext|>", "日本語 ünï 🎉  ", "x" * 500, "  lead", "1234 56,78 !! ?", "a  b 　c \x1c d", "tail \n"]


def test_ids_match_the_library():
    own, library = ByteBPE(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "the", "'s", "9", "!", "é", " ", "<|endoftext|>", "\x1c", "　"]
    for text in TEXTS + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(3000)]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def optimum(lengths, capacity):
    for bins in range(1, len(lengths) + 1):
        for place in itertools.product(range(bins), repeat=len(lengths)):
            if max(np.bincount(place, weights=lengths, minlength=bins)) <= capacity:
                return bins
    return 0


def test_bound_never_passes_the_optimum_and_packing_is_sound():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 17, 20])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 6))])
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        best = optimum(lengths, capacity)
        assert lower_bound(lengths, capacity) <= best <= len(room)
        for b in range(len(room)):
            inside = sorted((int(o), int(n)) for o, n in zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
            assert sum(n for _, n in inside) == capacity - room[b]


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(20, 8) == [(0, 4), (4, 8), (12, 8)]


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEQUENCES_A_PART", 32)
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randint(0, 90)), 1) for i in range(300)] + [(7, "again", 1), (7, "again", 1), (None, None, 1)]
    rows += [(1000 + i, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    got = pack_documents(docs, 64).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in sequences.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        assert sum(n for _, n in inside) <= 64
    assert len(sequences) <= 2 + -(-sum(n for *_, n, _ in want) // 64)
    assert pack_documents(docs.limit(0)).count() == 0


def test_ids_stay_exact_beside_null_ones(spark):
    ids = [2**60 + 1, 2**60 + 3, 2**60 + 5, None]
    docs = spark.createDataFrame([(i, "word") for i in ids], "doc_id long, text string")
    assert sorted((r.doc_id for r in pack_documents(docs).collect()), key=str) == sorted(ids, key=str)
    named = spark.createDataFrame([("a", "word"), (None, "word")], "doc_id string, text string")
    assert {r.doc_id for r in pack_documents(named).collect()} == {"a", None}
