"""Membership filters of stored tables against plain joins."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marlpit.sources import membership, tables


def digest(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def rows(spark, pairs):
    own = spark.createDataFrame([(f"d{k:05d}", digest(h) if h is not None else None) for k, h in pairs], "document_id string, sha256 string")
    others = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in tables.SCHEMAS["documents"].split(", ")) if name not in own.columns]
    return own.select("*", *others)


def asked_of(spark, ks):
    return spark.createDataFrame([(digest(k),) for k in ks], "sha256 string")


def found(spark, folder, ks):
    got = tables.members(spark, folder, "documents", asked_of(spark, ks)).collect()
    return sorted((r.document_id, r.sha256) for r in got)


def plain(spark, folder, ks):
    wanted = {digest(k) for k in ks}
    return sorted((r.document_id, r.sha256) for r in tables.stored(spark, folder, "documents").collect() if r.sha256 in wanted)


def test_a_filter_passes_all_members_and_few_others(spark):
    keys = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    own = keys.unionByName(keys.limit(1000)).unionByName(spark.createDataFrame([(None,)], "k string"))
    held = membership.build(own, "k", 1, 40_000).unionByName(membership.build(own.limit(10), "k", 2, 10))
    assert held.filter("version = 1").count() <= 1250
    assert membership.possible(own, "k", held).count() == 40_000
    others = spark.range(40_000, 140_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert membership.possible(others, "k", held).count() < 400
    assert membership.possible(own, "k", held.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_members_follow_replaced_rows_compaction_and_lost_filters(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(membership, "BROADCAST_BLOCKS", bound)
    monkeypatch.setattr(tables, "BROADCAST_HITS", bound)
    folder = str(tmp_path)
    assert found(spark, folder, [1, 2]) == []
    tables.store(spark, folder, "documents", rows(spark, [(k, k % 300) for k in range(400)] + [(900, None)]))
    tables.store(spark, folder, "documents", rows(spark, [(k, k + 5000) for k in range(50)]))
    tables.store(spark, folder, "documents", rows(spark, []))
    asked = [*range(100), *range(5000, 5100), 7, 7, 99999]
    want = plain(spark, folder, asked)
    assert len(want) == 50 + 50 + 100 and found(spark, folder, asked) == want
    assert (digest(3) in {h for _, h in want}) and ("d00003", digest(3)) not in want

    target, fs = tables._files(spark, tables._filter_path(tables.versions_of(spark, folder, "documents")[0][1], "documents"))
    assert fs.exists(target)
    fs.delete(target, True)  # a crash between a version and its filter
    assert found(spark, folder, asked) == want
    tables.compact(spark, folder, "documents")
    left, fs = tables._files(spark, f"{folder}/documents_filter")
    assert [x.getPath().getName() for x in fs.listStatus(left)] == ["00000004-full"] and found(spark, folder, asked) == want


def test_only_possible_hits_are_shuffled(spark, tmp_path, monkeypatch):
    """Of 20,000 stored and 5,000 asked hashes, 3 of which are stored, what is read after an exchange is a few rows."""
    folder, kept = str(tmp_path), []
    tables.store(spark, folder, "documents", rows(spark, [(k, k) for k in range(20_000)]))
    monkeypatch.setattr(tables, "written", lambda df, own=tables.written: kept.append(own(df)) or kept[-1])
    got = tables.members(spark, folder, "documents", asked_of(spark, [1, 2, 3, *range(30_000, 34_997)]))
    assert {r.document_id for r in got.collect()} == {"d00001", "d00002", "d00003"}
    hits, keys = (x.count() for x in kept)
    assert 3 <= hits <= 30 and keys == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
