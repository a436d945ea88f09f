import random
import re
from itertools import permutations

from marlpit.llm.filter_audit import audit


def plain_audit(docs, labels):
    """Every document through every order, filter by filter. docs: (id, text, part); labels: (id, quality, toxic)."""
    found = {}
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        good = i is not None and any(j == i and q == 1 for j, q, _ in labels)
        toxic = i is not None and any(j == i and x == 1 for j, _, x in labels)
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = found.setdefault((part or "", "".join(order), step), [0] * 6)
                row[0] += not gone and not failed[letter]
                row[1] += not gone and failed[letter]
                row[2] += gone and failed[letter]
                row[3] += failed[letter] and sum(failed.values()) == 1
                row[4] += not gone and failed[letter] and good
                row[5] += not gone and failed[letter] and toxic
                gone |= failed[letter]
    sums = {}
    for (part, order, step), row in found.items():
        sums[part, order[step - 1]] = sums.get((part, order[step - 1]), 0) + row[1]
    return sorted((*key, *row, sums[key[0], key[1][key[2] - 1]]) for key, row in found.items())


def test_every_order_document_by_document(spark):
    rng = random.Random(4)
    many = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n", "Word", "a\x0bb\x0cc\x1cd\xa0e", "A" * 9, " ".join(many), " ".join(many[:199]), " ".join(many[:200]), " ".join(["a", "b"] * 150), " ".join(many) + " $", " ".join(many) + " ÄÖ" * 30, " ".join(["x"] * 100 + many[:100]), " ".join(["x"] * 101 + many[:99]), "W" + "x" * 49, "W" + "x" * 48, "é" * 49 + "W"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(120)]
    docs += [(99, "copy", "s3")] * 30 + [(k, "copy", "s3") for k in range(200, 230)]
    labels = [(rng.choice([None, *range(45), 99]), rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for _ in range(60)]
    rows = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, mask int, n int")
    said = spark.createDataFrame([(*x, "odd") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted(tuple(r) for r in audit(rows, said).collect()) == plain_audit(docs, labels)
    assert audit(rows.limit(0), said).count() == 0
    without = audit(rows, said.limit(0)).collect()
    assert sum(r.good_lost + r.toxic_lost for r in without) == 0 and len(without) == 600 * 4


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("b", "same", "x"), ("a", "same", "x"), (None, "same", "x")], "doc_id string, text string, source string")
    said = spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in audit(rows, said).collect()}
    first = got["EABCD", 1]
    assert (first.kept, first.removed, first.good_lost, first.toxic_lost) == (2, 1, 1, 1)
