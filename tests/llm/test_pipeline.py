"""Each stage of the pipeline on its own input, against a plain version of its rule."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marlpit.llm.packing import DEFAULT_TOKENIZER
from test_near_dedup import brute_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
rng = random.Random(17)
WORDS = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(800)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join([rng.choice(WORDS).upper() + "!!" for _ in range(15)]) if bad else sentence(rng.randint(3, 80))
        if i % 4 == 1 and i % 8 == 1:
            text += " password = hunter2" + "x" * (i % 5)
        rows.append((i, text, "en", f"s{i % 5 if i % 2 else 0}", len(text)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    base = sentence(100)
    rows += [(1000 + k, base.replace(".", f" {WORDS[k]}."), "en", "s0", 0) for k in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (9, rows[9][1], "en", "s4", rows[9][4]), (None, sentence(30), "en", None, None)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        after = spark.read.parquet(f"{folder}/out{k}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_quality(stages):
    before, after, columns = stages[0]
    assert columns == COLUMNS
    bad = [r for r in before if r.text and r.text.endswith("!!")]
    gone = Counter(map(tuple, before)) - Counter(map(tuple, after))
    assert sum(gone[tuple(r)] for r in bad) > 0.97 * len(bad) and sum(gone.values()) <= len(bad) + 2


def test_one_of_each_group_stays(stages):
    before, after, columns = stages[1]
    assert columns == COLUMNS
    sets = {tuple(r): brute_set(r.text, 5) for r in before}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    left = [sets[tuple(r)] for r in after]
    assert not any(near(left[i], left[j]) for i in range(len(left)) for j in range(i))
    assert all(tuple(r) in set(map(tuple, after)) or any(near(sets[tuple(r)], x) for x in left) for r in before)
    assert len([r for r in after if r.doc_id is not None and 1000 <= r.doc_id < 2000]) == 1


def test_secrets_are_gone(stages):
    before, after, columns = stages[2]
    assert columns == COLUMNS and len(before) == len(after)
    own = {r.doc_id: r for r in before}
    for r in after:
        old = own[r.doc_id].text
        if old and "password" in old:
            assert "hunter2" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == old


def test_mix(stages):
    before, after, columns = stages[3]
    assert columns == COLUMNS
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = sum(map(size, before))
    assert abs(sum(map(size, after)) - 1.5 * total) <= 2 * len({r.source for r in before})
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_packing(stages):
    before, after, _ = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path(DEFAULT_TOKENIZER))
    want = Counter()
    for r in before:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in after) == want
    assert len({r.sequence_id for r in after}) == -(-sum(r.length for r in after) // 2048)


def test_run_gives_the_last_stage(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(stages[4][1])


CLASHING = ["row", "key", "its", "first", "carried", "copy", "copies", "size", "target", "id", "k", "component_id", "kept", "marlpit_id", "marlpit_text", "sequence_id", "score", "item", "part"]


def test_columns_of_any_name_pass_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is null or doc_id < 80 or doc_id > 1020")
    docs = docs.selectExpr("*", *[f"concat('{name}', doc_id) AS {name}" for name in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(r[name] == (None if r.doc_id is None else f"{name}{r.doc_id}") for r in rows for name in CLASHING)
        docs = spark.createDataFrame(rows, after.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_empty_tables_pass_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == COLUMNS and after.count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
