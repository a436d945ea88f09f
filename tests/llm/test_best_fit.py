import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marlpit.llm import best_fit
from marlpit.llm.best_fit import best_fit_decreasing, in_powers, pack, pack_windows
from marlpit.llm.packing import DEFAULT_TOKENIZER


def rooms_by_search(lengths, capacity):
    """Best fit decreasing that looks at every window."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        enough = [r for r in rooms if r >= n]
        if enough:
            rooms.remove(min(enough))
        rooms.append((min(enough) if enough else capacity) - n)
    return sorted(rooms)


def test_segment_tree_finds_the_tightest_window():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([1, 7, 10, 16, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        windows = best_fit_decreasing([(i, 0, n) for i, n in enumerate(lengths)], capacity)
        assert sorted(capacity - sum(p[2] for p in w) for w in windows) == rooms_by_search(lengths, capacity)
        assert sorted(p[0] for w in windows for p in w) == list(range(len(lengths)))


def check_pieces(windows, lengths, capacity):
    seen = {}
    for window in windows:
        total = sum(p[2] for p in window)
        assert 0 < total <= capacity and (total == capacity or total & (total - 1) == 0)
        for doc, start, length in window:
            seen.setdefault(doc, []).append((start, length))
    for doc, pieces in seen.items():
        pieces.sort()
        assert all(n > 0 for _, n in pieces) and [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) == lengths[doc]
    assert sorted(seen) == list(range(len(lengths)))


def test_nothing_is_padded_and_every_id_is_in_one_piece():
    rng = random.Random(2)
    for _ in range(1500):
        capacity = rng.choice([6, 8, 16, 64])
        lengths = [rng.randint(1, rng.choice([3, capacity - 1, 3 * capacity])) for _ in range(rng.randint(0, 40))]
        check_pieces(pack(lengths, capacity), lengths, capacity)
    assert pack([], 8) == []
    assert [sum(p[2] for p in w) for w in in_powers([(0, 0, 5), (1, 0, 6)])] == [8, 2, 1]


def test_few_documents_are_cut():
    rng = random.Random(3)
    lengths = [1 + int(rng.expovariate(1 / 600)) % 2047 for _ in range(5000)]
    windows = pack(lengths, 2048)
    assert len(windows) <= -(-sum(lengths) // 2048) + 11
    assert sum(map(len, windows)) < 1.03 * len(lengths)


def test_pack_windows(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "WINDOWS_A_BLOCK", 16)
    rng = random.Random(6)
    texts = ["", None, " ", "a  b   c \n d", "<|endoftext|> x", "日本語 🎉", "x" * 5000, "tail \n"]
    rows = [(i, " ".join(["word"] * rng.randint(0, 150)), 1) for i in range(400)] + [(7, "again", 1), (7, "again", 1), (None, "none", 1), (None, None, 1)]
    rows += [(1000 + i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = pack_windows(docs, 64).collect()
    library = Tokenizer.from_file(public_tokenizers.path(DEFAULT_TOKENIZER))
    ids_of = {}
    for i, text, _ in rows:
        ids_of.setdefault(i, []).append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    assert sum(r.length for r in got) == sum(len(ids) for held in ids_of.values() for ids in held)
    by_doc, sequences = {}, {}
    for r in got:
        assert any(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for ids in ids_of[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids_of.keys()
    for i, pieces in by_doc.items():
        if len(ids_of[i]) == 1:
            pieces.sort()
            assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
            assert sum(n for _, n in pieces) == len(ids_of[i][0])
    for inside in sequences.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        total = sum(n for _, n in inside)
        assert total == 64 or total < 64 and total & (total - 1) == 0
    assert pack_windows(docs.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    named = spark.createDataFrame([("a", "word"), (None, "word")], "doc_id string, text string")
    assert {r.doc_id for r in pack_windows(named).collect()} == {"a", None}
    large = spark.createDataFrame([(2**60 + 1, "word"), (None, "word")], "doc_id long, text string")
    assert {r.doc_id for r in pack_windows(large).collect()} == {2**60 + 1, None}
