import hashlib
import random

import numpy as np
import pytest

from marlpit.llm import fingerprints as fp
from marlpit.llm.fingerprints import Tree, edits, equal_share, fingerprints, levels, likeness, number_of_edits, parsed, place_of, tree_likeness

rng = random.Random(7)


def words(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_roots_follow_texts_and_edits_are_located():
    text = "\n".join(words(30) for _ in range(60))
    lines = text.split("\n")
    lines[41] = lines[41].replace(lines[41].split(" ")[3], "changed")
    a, b = Tree(text).fingerprint(), Tree("\n".join(lines)).fingerprint()
    assert a == Tree(text).fingerprint() and a.partition(":")[0] != b.partition(":")[0]
    changed = edits(b, a)
    sections = [paragraphs for _, paragraphs in parsed(b)[2]]
    assert len(sections) > 3 and sum(map(len, sections)) == 60 and len(changed) == 1
    s, p = changed[0]
    assert sum(map(len, sections[:s])) + p == 41
    assert likeness(a, a) == 1.0 and 0.97 < likeness(a, b) < 1.0 and likeness(a, Tree(words(500)).fingerprint()) < 0.1
    assert number_of_edits(Tree(text), Tree("\n".join(lines))) == 1 and edits(a, a) == []
    moved = "\n".join(lines[30:] + lines[:30])
    assert edits(Tree(moved).fingerprint(), b) == [] and likeness(Tree(moved).fingerprint(), b) > 0.95  # a move is no edit


@pytest.mark.parametrize("n", range(10, 31))
def test_one_more_word_or_character_changes_little(n):
    """At every length, also around those where other levels of runs begin."""
    near = []
    for _ in range(20):
        own = words(n).split(" ")
        at = rng.randrange(n + 1)
        near.append(likeness(Tree(" ".join(own)).fingerprint(), Tree(" ".join([*own[:at], "another", *own[at:]])).fingerprint()))
        text = "".join(rng.choice("abcdefgh ijk") for _ in range(n))
        near.append(likeness(Tree(text).fingerprint(), Tree(text[: at % n] + "x" + text[at % n :]).fingerprint()))
    assert min(near) > 0.75 and sum(near) / len(near) > 0.88, near


def test_likeness_has_no_step_at_any_length():
    text = words(900)
    for n in [*range(2, 200), *range(200, 5000, 37)]:
        assert abs(sum(levels(n).values()) - 1) < 1e-9
        assert likeness(Tree(text[:n]).fingerprint(), Tree(text[: n + 1]).fingerprint()) > (0.75 if n < 10 else 0.85), n


@pytest.mark.parametrize("n", [100, 300, 1000, 3000])
def test_likeness_follows_the_overlap_of_unlike_lengths(n):
    """A text against itself with more after it, from 1.1 to 8 times as long: near the share that they have in common."""
    ratios, near = [k / 10 for k in range(11, 81)], []
    for trial in range(10):
        text = (" " if trial % 2 else "\n").join(words(rng.randrange(2, 12)) for _ in range(n))
        near.append([likeness(Tree(text[:n]).fingerprint(), Tree(text[: int(n * r)]).fingerprint()) for r in ratios])
    for row in near:
        assert max(abs(x - 2 / (1 + r)) for x, r in zip(row, ratios, strict=True)) < 0.2
        assert max(abs(a - b) for a, b in zip(row, row[1:])) <= 0.11
    means = np.mean(near, 0)
    assert max(abs(x - 2 / (1 + r)) for x, r in zip(means, ratios, strict=True)) < 0.1


def test_trees_and_fingerprints_have_one_likeness():
    texts = ["", "a", "\n\n", words(3), words(40), "\n".join(words(6) for _ in range(50)), words(3000), "on " * 400, "x" * 9000, "é🎉" * 30]
    for one in texts:
        for other in texts:
            near = likeness(Tree(one).fingerprint(), Tree(other).fingerprint())
            assert near == pytest.approx(tree_likeness(Tree(one), Tree(other))) and 0 <= near <= 1 and (near == 1) == (one == other)
    longer = "\n".join(words(12) for _ in range(200))
    assert len(Tree(longer).fingerprint()) < 0.25 * len(longer) and len(Tree(words(9000)).fingerprint()) < 0.1 * 54_000


def test_hot_and_null_ids_are_split(spark):
    """A third of all rows have one id, a third none: no range holds much more than its share."""
    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else k, f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(text) AS key")
    cuts = docs.selectExpr(f"percentile_approx(id, array({', '.join(str(k / 30) for k in range(1, 30))}), 200)").first()[0]
    place, number = place_of(3000, 1000, cuts, 30)
    sizes = [r["count"] for r in docs.select(place.alias("range")).groupBy("range").count().collect()]
    assert max(sizes) < 250 and number < 80
    order = docs.select("id", "key", place.alias("range")).collect()
    order.sort(key=lambda r: (r.id is None, -(r.id or 0), r.key))
    assert [r.range for r in order] == sorted(r.range for r in order)


def test_small_differences_change_the_root():
    texts = ["", " ", "  ", "\n", "a", "a ", " a", "a\nb", "a b", "b a", "a\n\nb", "A", "é", "é", "a\tb", "\r\n", "abcdefghijklm", "a b c d e f g h i j k l m", "a " * 40, "a " * 41, "x" * 9000, "x" * 9001]
    assert len({Tree(t).root for t in texts}) == len({Tree(t).fingerprint() for t in texts}) == len(texts)


def test_equal_share_counts_repeats():
    assert equal_share(np.array([1, 1, 2]), np.array([1, 3])) == 2 * 1 / 5


def test_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rows = [(i * 3, words(rng.randrange(40)), "x") for i in range(80)]
    rows += [(500, None, "x"), (501, "", "x"), (30, "same id", "x"), (30, "same id", "x"), (None, "no id", "x"), (10**15, words(9), "x"), (-7, "x" * 50_000, "x"), (700, "é" * 10, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    key = {r.t: r.key for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS key").collect()}
    own = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), key[x[1]], x[1]))
    want = []
    for k, (i, text) in enumerate(own):
        after = own[(k + 1) % len(own)][1]
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        a, b, c = (Tree(x).fingerprint() for x in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 12), round(likeness(a, c), 12)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    one = fingerprints(docs.filter("doc_id = 700")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(docs.limit(0)).count() == 0
