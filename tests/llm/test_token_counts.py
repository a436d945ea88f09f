import public_tokenizers
import pytest
import sentencepiece

from marlpit.llm.token_counts import DEFAULT_MODEL, PrefixCounter, longest_within, prefix_counts, token_counts

PATH = public_tokenizers.path(DEFAULT_MODEL)
TEXTS = ["", " ", "   ", "a", "Hello world, don't  panic.\n\nx\ty ", "<s> </s> <unk> <0x0A>", "日本語 ünïcode 🎉🎉 é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "▁▁x ▁ y", "The end\x00.\r\n" * 3, "0123456789abcdef" * 5]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_every_prefix_matches_the_library(library):
    counter = PrefixCounter(PATH)
    for text in TEXTS:
        assert counter.counts(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_longest_within_budget(library):
    counts = PrefixCounter(PATH).counts(TEXTS[4])
    for budget in range(int(counts[-1]) + 1):
        assert longest_within(counts, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_rows_nulls_repeats_and_clashing_names(spark, library):
    rows = [(i, text, "x", 1) for i, text in enumerate(TEXTS)] + [(3, "a", "x", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens long")
    got = sorted(map(tuple, token_counts(docs, 5).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 5) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    sizes = prefix_counts(docs).selectExpr("doc_id", "size(prefix_counts) n").collect()
    assert sorted(r.n for r in sizes) == sorted(len(t or "") + 1 for _, t, *_ in rows)
    assert token_counts(docs.limit(0), 5).count() == 0
