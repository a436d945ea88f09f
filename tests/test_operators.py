import math
import os
import random
import re
import zipfile
from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions import scoring
from marlpit.functions import text as T
from marlpit.functions.vectors import cosine
from marlpit.operators import agents, chunking, graph, identity, index, ingest, lexical, memory, processing, retrieval, substrings
from marlpit.sources import tables
from marlpit.sources.pages import docx_pages, read_pages
from marlpit.streaming.ingest import ingest_stream

# The mock document that queries were once scored on, and the scores that follow from the formulas.
MOCK = "This is a sample document content that matches the query: {}. It contains information about SPM processes and documentation."
DOCX = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>The </w:t></w:r><w:r><w:t>plan</w:t></w:r></w:p><w:p><w:r><w:t>of</w:t><w:tab/><w:t>all</w:t></w:r></w:p></w:body></w:document>"""
GOLDEN = (
    ("How to handle G3 RMS decision upload failures?", 2),
    ("project documentation", 3),
)


def loop_chunks(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        out.append((len(out) + 1, start, end, text[start:end]))
        if end == len(text):
            break
        start = end - overlap
    return out


def test_chunks_match_a_loop(spark):
    rng = random.Random(1)
    lengths = [0, 1, 150, 151, 999, 1000, 1001, 1849, 1850, 1851, 5000]
    texts = ["".join(rng.choice("aé🎉 \n") for _ in range(n)) for n in lengths]
    docs = spark.createDataFrame([(f"DOC-{i:06d}", t) for i, t in enumerate(texts)] + [("DOC-000099", None)], "document_id string, text string")
    for size, overlap in ((1000, 150), (7, 3), (5, 0)):
        got = sorted((r.document_id, r.sequence, r.char_start, r.char_end, r.text) for r in chunking.chunk(docs, size=size, overlap=overlap).collect())
        assert got == sorted((f"DOC-{i:06d}", *c) for i, t in enumerate(texts) for c in loop_chunks(t, size, overlap))
    with pytest.raises(ValueError):
        chunking.chunk(docs, size=10, overlap=10)
    parts = [chunking.chunk(docs.filter(f"document_id = 'DOC-00000{k}'")) for k in (1, 6, 6)]
    assert chunking.accumulated(parts).count() == sum(p.count() for p in parts) == 5


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6000), st.integers(1, 900), st.integers(0, 899))
def test_closed_form_of_chunks(n, size, overlap):
    if overlap >= size:
        return
    number = 0 if n == 0 else max(1, math.ceil((n - overlap) / (size - overlap)))
    assert number == len(loop_chunks("x" * n, size, overlap))


def test_clean(spark):
    rows = ["", "  \n\t ", "a \t b\n\n\nc", "CARE Knowledge\n Base x", "Enter a search term\r and more\nnext", "ALL ARTICLES to the end too\nz", " x ", "a\n \nb", "📝Recent postsCategories"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.clean("t").alias("c")).collect()]

    def want(t):
        for form in T.BOILERPLATE:
            t = re.sub(form, "", t, flags=re.IGNORECASE)
        return re.sub("\n{2,}", "\n", re.sub("[ \t]+", " ", t)).strip()

    assert got == [want(t) for t in rows]


def plain_blast(text, keywords):
    places = {}
    for k in (k.lower() for k in keywords):
        at = text.lower().find(k)
        while at >= 0:
            places.setdefault(k, []).append(at)
            at = text.lower().find(k, at + 1)
    total = 0.0
    for k in (k.lower() for k in keywords):
        p = places.get(k, [])
        if len(p) > 1:
            gap = sum(b - a for a, b in zip(p, p[1:])) / (len(p) - 1)
            total += 0.0 if gap > 35_000 else 1 / (1 + math.exp(gap / 50))
    return min(1.0, total / len(keywords)) if keywords else 0.0


def test_scores(spark):
    texts = ["", "aa aaa aa", "the THE then the", "é the? the", "x" * 80_000 + " the end the", "the " + "y" * 75_000 + " the", "Failures? failures?"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for keywords in (["the"], ["aa", "the", "The"], ["failures?", "zz"], []):
        got = [r.b for r in docs.select(scoring.blast_radius(F.col("t"), keywords).alias("b")).collect()]
        assert got == pytest.approx([plain_blast(t, keywords) for t in texts]), keywords
    hits = [r.h for r in docs.select(scoring.keyword_hits(F.col("t"), ["the", "failures?"]).alias("h")).collect()]
    assert hits == [len(re.findall(r"\bthe\b", t.lower())) + len(re.findall(r"\bfailures\?\b", t.lower())) for t in texts]
    assert docs.select(scoring.matching_keywords(F.col("t"), ["THE", "aa", "the"]).alias("m")).collect()[2].m == ["THE", "the"]
    with pytest.raises(ValueError):
        scoring.blast_radius(F.col("t"), [""])


@pytest.mark.parametrize("query,level", GOLDEN)
def test_levels_of_a_mock_document(spark, query, level):
    row = spark.createDataFrame([(MOCK.format(query),)], "t string").select(scoring.scored(F.col("t"), scoring.query_keywords(query)).alias("s")).first()
    assert row.s.confidence_level == level and row.s.contextual_relevance == 0.5


def test_halves_round_to_even(spark):
    rows = spark.createDataFrame([(x / 100,) for x in (5, 15, 25, 35, 45, 120)], "x double").select(scoring.confidence_level(F.col("x")).alias("l")).collect()
    assert [r.l for r in rows] == [0, 2, 2, 4, 4, 10]


def test_routes_types_and_ids(spark):
    got = spark.createDataFrame([("Show catalogs",), ("Tracker logs",), ("hotel",), ("x",), ("",)], "q string").select(T.route("q").alias("p")).collect()
    assert [r.p.tool for r in got] == ["datadog", "smartsheet", "sql", "knowledge", "knowledge"]
    names = ["/a.b/c.PDF", "x.docx", "n", ".txt", "a.tar.gz", "a..txt", "..a.txt", "...", "a.", "/d.x/", "a\nb.doc"]
    files = spark.createDataFrame([(x,) for x in names], "p string").select(T.document_type("p").alias("t"), T.extension("p").alias("e"), T.mime_type("p").alias("m")).collect()
    assert [r.e for r in files] == [os.path.splitext(os.path.basename(x))[1].lower() for x in names]
    assert [r.t for r in files] == ["report", "project", "other", "other", "other", "meeting_notes", "meeting_notes", "other", "other", "other", "project"]
    assert files[1].m.endswith("wordprocessingml.document") and files[2].m == "application/octet-stream"
    ids = spark.createDataFrame([(1,), (999_999,), (1_234_567,)], "n long").select(T.document_id("n").alias("d")).collect()
    assert [r.d for r in ids] == ["DOC-000001", "DOC-999999", "DOC-1234567"]
    with pytest.raises(Exception, match="1 or more"):
        spark.createDataFrame([(0,)], "n long").select(T.document_id("n")).collect()


def test_search_repeats_absent_terms_and_ties(spark):
    texts = ["a b b", "b c", "c c c c", "", "a b b"]
    chunks = spark.createDataFrame([(f"D{i}-1", f"D{i}", 1, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, sequence int, text string")
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(own, query):
        total = 0.0
        for term in query.split():
            df, tf = sum(term in w for w in words), own.count(term)
            if df:
                total += math.log((5 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / max(mean, 1)))
        return total

    for query in ("b", "b b c", "zz", "a zz B"):
        got = [(r.chunk_id, r.score) for r in lexical.search(chunks, query, 10).collect()]
        want = sorted(((f"D{i}-1", round(score(w, query.lower()), 6)) for i, w in enumerate(words) if score(w, query.lower()) > 0), key=lambda x: (-x[1], x[0]))
        assert got == want
        batch = index.batch_search(chunks, spark.createDataFrame([(1, query)], "q int, text string"), "q", "text", 10).collect()
        assert sorted((r.rank, r.chunk_id, r.score) for r in batch) == [(k + 1, *w) for k, w in enumerate(want)]
    assert lexical.search(chunks, " ", 3).count() == 0 and lexical.search(chunks.limit(0), "a", 3).count() == 0


def test_dense_fusion_and_answer(spark):
    vectors = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 0.0]), ("C", [1.0, 1.0]), ("D", [2.0, 0.0])], "chunk_id string, embedding array<double>")
    assert [(r.chunk_id, r.score) for r in retrieval.dense_search(vectors, [3.0, 0.0], 3).collect()] == [("A", 1.0), ("D", 1.0), ("C", 0.707107)]
    rows = "chunk_id string, document_id string, sequence int, text string, score double"
    words = spark.createDataFrame([("A", "d1", 1, "one", 5.0), ("X", "d2", 1, "two", 1.0)], rows)
    near = spark.createDataFrame([("A", "d9", 9, "other", 0.5), ("Y", "d3", 2, "three", 1.0)], rows)
    assert {r.chunk_id: (r.document_id, r.text, r.score) for r in retrieval.fuse(words, near).collect()} == {"A": ("d1", "one", 2.3), "X": ("d2", "two", 0.4), "Y": ("d3", "three", 0.6)}
    titles = spark.createDataFrame([("d2", "t2")], "document_id string, title string")
    best = retrieval.answer(words, titles).collect()
    assert len(best) == 1 and best[0].answer == "one" and best[0].title is None and best[0].success
    nothing = retrieval.answer(words.limit(0), titles).collect()
    assert len(nothing) == 1 and nothing[0].answer == retrieval.NOTHING and not nothing[0].success


def test_upserts_registry_and_files(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "id string, v string, w string")
    new = spark.createDataFrame([("b", None, "z"), ("c", "n", "n")], "id string, v string, w string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [("a", "x", "y"), ("b", None, "z"), ("c", "n", "n")]
    files = spark.createDataFrame([(3, "h1"), (1, "h2"), (2, "h1"), (9, "h3"), (10**12, "h4")], "n long, sha256 string")
    known = spark.createDataFrame([("h3", "DOC-000001")], "sha256 string, document_id string")
    got = sorted(tuple(r) for r in identity.register(files, known, order_col="n").select("n", "document_id", "known").collect())
    assert got == [(1, "DOC-000002", False), (2, "DOC-000003", False), (3, "DOC-000003", False), (9, "DOC-000001", True), (10**12, "DOC-000004", False)]
    for name, text in (("b.txt", "two"), ("a.txt", "one"), ("c.pdf", "x")):
        (tmp_path / name).write_text(text)
    found = tables.read_files(spark, str(tmp_path), "*.txt").collect()
    assert [(r.file_name, r.file_size, r.document_type, bytes(r.content)) for r in found] == [("a.txt", 3, "meeting_notes", b"one"), ("b.txt", 3, "meeting_notes", b"two")]
    assert tables.read_files(spark, str(tmp_path), limit=0).count() == 3 and tables.read_files(spark, str(tmp_path), limit=2).count() == 2


def test_files_without_a_hash_are_kept(spark):
    files = spark.createDataFrame([(1, None), (2, "h1"), (3, None), (4, "h2"), (5, "h3")], "n long, sha256 string")
    known = spark.createDataFrame([("h3", "DOC-000001"), (None, "DOC-000009")], "sha256 string, document_id string")
    got = sorted(tuple(r) for r in identity.register(files, known, order_col="n").select("n", "sha256", "document_id", "known").collect())
    assert got == [(1, None, None, False), (2, "h1", "DOC-000003", False), (3, None, None, False), (4, "h2", "DOC-000004", False), (5, "h3", "DOC-000001", True)]


def test_memory(spark):
    entries = spark.createDataFrame([("User feedback: Positive", {"a": "x"}), ("note", {"k": "FEEDBACK"}), ("other", {"k": "True"}), ("none", None)], "content string, context map<string,string>")
    assert memory.remembered(entries, "Feedback").count() == 2 and memory.remembered(entries, "true").count() == 1 and memory.remembered(entries, "").count() == 4
    queries = spark.createDataFrame([(1, "What is the status of project documentation?"), (2, "nothing here"), (3, "note")], "id int, q string")
    queries = queries.unionByName(spark.createDataFrame([(4, "feedBACK"), (5, "tru"), (6, "feedBACK"), (7, None)], "id int, q string"))
    want = {1: (0, "Docs", "HIGH"), 2: (0, "none", "MEDIUM"), 3: (1, "none", "HIGH"), 4: (2, "none", "HIGH"), 5: (1, "none", "HIGH"), 6: (2, "none", "HIGH"), 7: (0, "none", "MEDIUM")}
    found = memory.thoughts(queries, "q", entries, [("Docs", ["documentation"]), ("None", [])], "id").collect()
    assert {r.id: (r.memories, r.patterns, r.confidence) for r in found} == want
    steps = next(r.intermediate_steps for r in found if r.id == 1)
    assert [tuple(s) for s in steps] == [("understanding", "Understanding query: 'What is the status of project documentation?'", None, None), ("memory_retrieval", "Retrieved 0 relevant memories", 0, None), ("pattern_analysis", "Identified 1 matching patterns: Docs", None, ["Docs"])]
    assert next(r.intermediate_steps for r in found if r.id == 3)[2].content == "Identified 0 matching patterns: none"
    kept = memory.stamped(memory.thoughts(queries, "q", entries, [], "id")).first()
    assert len(kept.thought_id) == 36 and kept.created_at.endswith("Z")
    assert [r.final_reasoning for r in found if r.id == 3] == ["Based on 1 relevant memories and 0 pattern matches, I can provide a confident response about 'note'"]
    rules = spark.createDataFrame([("p1", "a", "x", ["K", "k", "l"]), ("p2", "b", None, ["m"]), ("p3", "c", "x", [])], "pattern_id string, name string, regex string, keyword_list array<string>")
    assert sorted(r.keyword for r in memory.rule_keywords(memory.eligible(rules)).collect()) == ["K", "k", "l"]


def test_graph(spark):
    rows = "source_id string, target_id string, relation_type string, description string, confidence double, metadata string"
    edges = spark.createDataFrame([("a", "b", "uses", None, 1.0, "{}"), ("a", "a", "uses", None, 1.0, "{}"), ("a", "b", "contains", None, 1.0, "{}"), ("c", "d", "uses", None, 1.0, "{}")], rows)
    assert graph.neighbours(edges, "a").count() == 3 and graph.neighbours(edges, "b").count() == 2
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    assert graph.neighbours_of(edges, ids).count() == 4
    with pytest.raises(Exception, match="unknown type"):
        graph.upsert_relationships(edges, edges.withColumn("relation_type", F.lit("likes"))).collect()
    stored = spark.createDataFrame([(None,), ("",), ("null",), ('{"a": 1}',)], "m string").select(graph.metadata("m").alias("m")).collect()
    assert [r.m for r in stored] == [{}, {}, None, {"a": "1"}]


def test_cosine_of_unequal_lengths(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == pytest.approx(2 / (3 * 2))


def test_stream_of_files(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "document_id string, text string"
    spark.createDataFrame([("d1", "x" * 1200), ("d2", "Recent Posts same"), ("d3", "same")], schema).write.parquet(source)
    ingest_stream(spark, source, folder, str(tmp_path / "c")).awaitTermination()
    first = {r.chunk_id for r in tables.stored(spark, folder, "chunks").collect()}
    assert len(first) == 3 and {"d1-CH-000001", "d1-CH-000002"} < first
    spark.createDataFrame([("d1", "y"), ("d4", "same")], schema).write.mode("append").parquet(source)
    ingest_stream(spark, source, folder, str(tmp_path / "c")).awaitTermination()
    after = {r.chunk_id: r.text for r in tables.stored(spark, folder, "chunks").collect()}
    assert set(after) == first and after["d1-CH-000001"] == "y" and tables.stored(spark, folder, "agents").count() == 0
    spark.createDataFrame([("d5", "late"), ("d5", "late too")], schema).write.mode("append").parquet(source)
    ingest_stream(spark, source, folder, str(tmp_path / "c")).awaitTermination()
    known = {r.document_id: r.sha256 for r in tables.stored(spark, folder, "documents").collect()}
    assert set(known) >= {"d1", "d5"} and len(known) == 3 and len(set(known.values())) == 3


def test_stored_tables_survive_crashes(spark, tmp_path):
    folder, kind = str(tmp_path), tables.SCHEMAS["agents"]
    agent = lambda i, name: spark.createDataFrame([(i, name, None, None, None, None)], kind)
    tables.store(spark, folder, "agents", agent("a", "one"))
    tables.store(spark, folder, "agents", agent("b", "two"))
    before = sorted(map(tuple, tables.stored(spark, folder, "agents").collect()))
    assert len(before) == 2
    broken = agent("a", "bad").withColumn("name", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        tables.store(spark, folder, "agents", broken)
    assert sorted(map(tuple, tables.stored(spark, folder, "agents").collect())) == before
    os.makedirs(tmp_path / "agents" / "00000003-part", exist_ok=True)  # a version that was begun and never ended
    assert sorted(map(tuple, tables.stored(spark, folder, "agents").collect())) == before
    for k in range(tables.VERSIONS_MOST + 2):
        tables.store(spark, folder, "agents", agent("a", f"name {k}"))
    after = {r.agent_id: r.name for r in tables.stored(spark, folder, "agents").collect()}
    assert after == {"a": f"name {tables.VERSIONS_MOST + 1}", "b": "two"}
    assert len([x for x in os.listdir(tmp_path / "agents") if x.endswith("part")]) <= tables.VERSIONS_MOST


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_positions_of_any_ordered_column(spark, monkeypatch, rows):
    monkeypatch.setattr(identity, "SLICE_ROWS", 40)
    values = [f"dir {k * 7919 % 1000:03d}/é{k}" for k in range(rows)]
    got = {r.p: r.position for r in identity.positions(spark.createDataFrame([(v,) for v in values], "p string"), "p").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values, key=str.encode), 1)}


def test_folder_is_ingested_indexed_and_searched(spark, tmp_path):
    def failing(content):
        raise ValueError(f"broken at {len(content)} bytes")

    source, folder = tmp_path / "in", str(tmp_path / "store")
    os.makedirs(source)
    (source / "b.txt").write_text("Recent Posts the plan of the day " + "x" * 1200)
    (source / "a.txt").write_text("the plan")
    (source / "c.txt").write_text("the plan")
    (source / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (source / "d.pdf").write_text("page one")
    (source / "e.docx").write_text("word")
    with zipfile.ZipFile(source / "g.docx", "w") as packed:
        packed.writestr("word/document.xml", DOCX)
    (source / "h.tex").write_text("raises")
    with pytest.raises(FileNotFoundError):
        ingest.ingest_folder(spark, str(tmp_path / "nowhere"), folder)
    extractors = {".pdf": F.upper(F.col("content").cast("string")), ".tex": failing}
    rows = {r.file_name: r for r in ingest.ingest_folder(spark, str(source), folder, extractors=extractors).collect()}
    ids = {name: r.document_id for name, r in rows.items()}
    assert ids == {"a.txt": "DOC-000001", "b.txt": "DOC-000002", "c.txt": "DOC-000001", "d.pdf": "DOC-000003", "g.docx": "DOC-000004", "bad.txt": None, "e.docx": None, "h.tex": None}
    assert rows["bad.txt"].error == "not UTF-8" and rows["e.docx"].error.startswith("BadZipFile") and rows["a.txt"].error is None
    assert rows["h.tex"].error == "ValueError: broken at 6 bytes"
    documents = {r.document_id: r for r in tables.stored(spark, folder, "documents").collect()}
    assert set(documents) == {"DOC-000001", "DOC-000002", "DOC-000003", "DOC-000004"} and documents["DOC-000001"].title == "a.txt" and documents["DOC-000002"].team_owner == "UNKNOWN"
    chunks = tables.stored(spark, folder, "chunks")
    assert sorted(r.chunk_id for r in chunks.collect()) == ["DOC-000001-CH-000001", "DOC-000002-CH-000001", "DOC-000002-CH-000002", "DOC-000003-CH-000001", "DOC-000004-CH-000001"]
    assert chunks.filter("document_id = 'DOC-000004'").first().text == "The plan\nof all"  # cleaning makes tabs blanks
    assert chunks.filter("document_id = 'DOC-000003'").first().text == "PAGE ONE" and not chunks.filter("text like '%Recent Posts%'").count()

    (source / "f.txt").write_text("a new one")
    ingest.ingest_folder(spark, str(source), folder, "*.txt").collect()
    assert tables.stored(spark, folder, "documents").count() == 5 and tables.stored(spark, folder, "chunks").count() == 6

    chunks = {r.chunk_id: r.text for r in tables.stored(spark, folder, "chunks").collect()}
    for version in os.listdir(tmp_path / "store" / "chunks"):  # as if a run had failed before its chunks were complete
        os.remove(tmp_path / "store" / "chunks" / version / "_SUCCESS")
    os.makedirs(tmp_path / "other")
    (tmp_path / "other" / "0.txt").write_text("an earlier name")  # another folder's run makes good for the first one's
    ingest.ingest_folder(spark, str(tmp_path / "other"), folder).collect()
    again = {r.chunk_id: r.text for r in tables.stored(spark, folder, "chunks").collect()}
    assert again == chunks | {"DOC-000006-CH-000001": "an earlier name"}

    embed = lambda text: F.array(F.char_length(text), F.lit(1))
    ingest.index_stored(spark, folder, embed)
    assert ingest.index_vectors(tables.stored(spark, folder, "chunks"), tables.stored(spark, folder, "vectors"), embed).count() == 0
    vectors = tables.stored(spark, folder, "vectors")
    assert {r.chunk_id: r.embedding for r in ingest.from_json(ingest.to_json(vectors)).collect()} == {r.chunk_id: r.embedding for r in vectors.collect()}
    best = retrieval.hybrid_search(tables.stored(spark, folder, "chunks"), vectors, "the plan", [8.0, 1.0], 1).first()
    assert best.document_id == "DOC-000001"


def test_memory_is_appended_with_context(spark, tmp_path):
    rows = spark.createDataFrame([("one", {"k": "v"}), ("two", None)], "content string, context map<string,string>")
    memory.store_memory(spark, str(tmp_path), rows)
    memory.store_memory(spark, str(tmp_path), rows.limit(1))
    got = tables.stored(spark, str(tmp_path), "memory").collect()
    assert sorted((r.content, tuple(r.context.items())) for r in got) == [("one", (("k", "v"),)), ("one", (("k", "v"),)), ("two", ())]
    assert len({r.memory_id for r in got}) == 3 and {r.confidence for r in got} == {0.85}
    assert all(abs((datetime.now(UTC) - datetime.strptime(r.created_at + "+0000", "%Y-%m-%dT%H:%M:%SZ%z")).total_seconds()) < 300 for r in got)
    assert spark.range(1).select(T.prefix(F.lit("abcdef"), 3).alias("p")).first().p == "abc"


def test_feedback_context(spark):
    said = spark.createDataFrame([(7, "u", True, None, ["x", "y"]), (8, None, False, "bad", None)], "doc_id long, user_id string, is_correct boolean, comments string, suggested_tags array<string>")
    got = {r.doc_id: (r.content, r.context) for r in memory.feedback_memory(said).collect()}
    assert got[7] == ("User feedback: Positive for document 7", {"feedback_type": "user_feedback", "is_correct": "True", "doc_id": "7", "user_id": "u", "suggested_tags": "x, y"})
    assert got[8] == ("User feedback: Negative for document 8", {"feedback_type": "user_feedback", "is_correct": "False", "doc_id": "8", "comments": "bad"})


def test_processing(spark):
    docs = spark.createDataFrame([(1, "/a/x.PDF", "alpha beta alpha"), (2, "y.txt", None), (3, None, "beta")], "doc_id long, path string, text string")
    rules = [processing.Rule("one", "x", ("alpha", "Alpha", "alpha")), processing.Rule("no form", None, ("beta",)), processing.Rule("no words", "x", ())]
    got = {r.doc_id: r for r in processing.process_documents(docs, rules, ["doc_id"]).collect()}
    assert (got[1].title, got[1].document_type, got[1].patterns_found, got[1].metadata_confidence) == ("x.PDF", "report", ["one"], 0.85)
    words = ["alpha", "Alpha"]  # case tells keywords apart, so the score is that of two
    s = docs.filter("doc_id = 1").select(scoring.scored(F.col("text"), words).alias("s")).first().s
    assert (got[1].confidence_score, got[1].blast_radius, got[1].term_frequency) == (s.confidence_level / 10, s.blast_radius, s.term_frequency)
    assert (got[2].document_type, got[2].patterns_found, got[2].confidence_score, got[2].blast_radius, got[2].status) == ("other", [], 0.0, 0.0, "indexed")
    assert got[3].document_type == "other" and got[3].title is None
    plain = {r.doc_id: r for r in processing.process_documents(docs, rules[1:], ["doc_id"]).collect()}
    assert (plain[1].confidence_score, plain[1].blast_radius, plain[1].term_frequency, plain[2].confidence_score) == (0.85, 0.5, 0.5, 0.0)


def test_pages_of_files_are_rows_with_errors(spark):
    """Pages before a failure are kept, and other files go on."""

    def parser(content):
        for number, page in enumerate(content.decode().split("|")):
            if page == "bad":
                raise RuntimeError(f"page {number + 1}")
            yield page

    files = spark.createDataFrame([("a.x", b"one|two"), ("b.x", b"one|bad|three"), ("c.y", b"other"), ("d.X", b"bad")], "path string, content binary")
    got = sorted(tuple(r) for r in read_pages(files, {".x": parser}).collect())
    assert got == [("a.x", 1, "one", None), ("a.x", 2, "two", None), ("b.x", 1, "one", None), ("b.x", 2, None, "RuntimeError: page 2"), ("d.X", 1, None, "RuntimeError: page 1")]
    assert read_pages(files.limit(0), {".x": parser}).count() == 0 and docx_pages.__doc__


def test_substrings_match_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAé🎉 .") for _ in range(rng.randrange(0, 40))) for _ in range(150)] + ["", "aaaa", "A.*b", None]
    entries = [(k, t, {"k": rng.choice(texts)} if k % 3 else None) for k, t in enumerate(texts)]
    asked = sorted({t[i : i + n].lower() for t in texts[:60] if t for n in (1, 2, 3, 4, 7, 12) for i in [rng.randrange(len(t))]} | {"", "aaa", ".*", "zzz", "aaaaa"})
    rows = spark.createDataFrame(entries, "id int, content string, context map<string,string>")
    known = substrings.fields(rows, "id")
    got = sorted((r.asked, r.entry) for r in substrings.containing(spark.createDataFrame([(a,) for a in asked] + [(None,)], "asked string"), substrings.postings(known), known).collect())
    holds = lambda a, t: t is not None and a in t.lower()
    assert got == sorted((a, k) for a in asked for k, t, c in entries if holds(a, t) or any(holds(a, v) for v in (c or {}).values()))


def test_substring_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "text", {})], "id int, content string, context map<string,string>")
    known = substrings.fields(rows, "id")
    plan = substrings.containing(spark.createDataFrame([("ex",)], "asked string"), substrings.postings(known), known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stored_memory_is_searched_by_its_index(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"note {k} about topic {k % 7}", {"who": "Ann" if k % 5 else "BOB"}) for k in range(60)]
    for part in (rows[:40], rows[40:]):
        memory.store_memory(spark, folder, spark.createDataFrame(part, "content string, context map<string,string>"))
    entries = tables.stored(spark, folder, "memory")
    for query in ("topic 3", "bob", "NOTE 1", "o", "", "nothing"):
        want = sorted(r.content for r in memory.remembered(entries, query).collect())
        assert sorted(r.content for r in substrings.search_memory(spark, folder, query).collect()) == want
    count = tables.stored(spark, folder, "memory_grams").count()
    substrings.index_memory(spark, folder)
    assert tables.stored(spark, folder, "memory_grams").count() == count
    with pytest.raises(Exception, match="lost"):  # memory is stored, its postings aren't
        broken = F.when(F.length("content") > 0, F.raise_error(F.lit("lost")).cast("string"))
        tables.store(spark, folder, "memory_grams", entries.select(broken.alias("gram"), "memory_id", F.lit(0).alias("field"), F.lit(0).alias("place")))
    assert tables.stored(spark, folder, "memory_grams").count() == count


def test_columns_named_like_helpers_stay(spark):
    own = ["row", "by", "slice", "rank", "before", "key", "late", "s", "size", "tokens", "asked", "n", "mean", "tf0", "repeated"]
    extra = [F.lit(f"own {c}").alias(c) for c in own]
    kept = lambda df: all(r[c] == f"own {c}" for r in df.collect() for c in own if c in df.columns) and set(own) <= set(df.columns)
    chunks = spark.createDataFrame([("a", "d", 1, "the plan"), ("b", "d", 2, "plan of")], "chunk_id string, document_id string, sequence int, text string").select("*", *extra)
    assert kept(lexical.search(chunks, "plan the", 3)) and kept(identity.positions(chunks, "chunk_id")) and kept(tables.upsert(chunks, chunks, ["chunk_id"])) and kept(agents.without_repeats(chunks, ["chunk_id"], "chunk"))
    assert processing.query_documents(chunks, "plan", 2, ["chunk_id", "row"], "s", kind="rank").first().type == "own rank"
    done = processing.process_documents(chunks.withColumn("path", F.lit("a.txt")), [processing.Rule("p", "x", ("plan",))], ["s", "row"]).first()
    assert (done.s, done.row, len(done.process_id), done.created_at[-1]) == ("own s", "own row", 36, "Z")


def test_a_lookup_reads_the_pages_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PAGE_ROWS", 20)
    folder, kind = str(tmp_path), tables.SCHEMAS["agents"]
    agents_of = lambda ids, name: spark.createDataFrame([(f"a{k:04d}", name, None, None, None, None) for k in ids], kind)
    tables.store(spark, folder, "agents", agents_of(range(2000), "first"))
    tables.compact(spark, folder, "agents")
    tables.store(spark, folder, "agents", agents_of(range(0, 2000, 2), "second"))
    found = tables.lookup(spark, folder, "agents", ["a0003", "a0004", "zz"])
    assert sorted((r.agent_id, r.name) for r in found.collect()) == [("a0003", "first"), ("a0004", "second")]
    one = spark.read.parquet(tables.versions_of(spark, folder, "agents")[0][1]).filter("agent_id = 'a0003'")
    one.collect()
    leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.apply(0).metrics().get("numOutputRows").get().value() <= 100  # of 2,000; a page has 100 rows at least
    assert tables.lookup(spark, folder, "chunks", ["x"]).count() == 0


def test_term_frequencies_exchange_sums_alone(spark):
    chunks = spark.createDataFrame([("a", "x y x"), ("b", "Y z"), ("c", ""), ("d", None), ("e", " x ")], "chunk_id string, text string")
    got = lexical.term_frequencies(chunks)
    assert sorted(map(tuple, got.collect())) == [("x", 2, 3), ("y", 2, 2), ("z", 1, 1)] == sorted(map(tuple, lexical.term_statistics(lexical.term_counts(chunks)).collect()))
    assert got._jdf.queryExecution().toString().count("Exchange hashpartitioning") == 2  # one, in the first and the last plan


def test_contained_texts_are_tested_in_place(spark, monkeypatch):
    rows = [(1, 0, "the exam of the 🦊 fox"), (1, 1, "exa"), (2, 0, "ab"), (3, 0, ""), (4, 0, "aaaa"), (5, 0, "an example")]
    texts = spark.createDataFrame(rows, "entry long, field int, text string")
    asked = ["exam", "exa", "a", "ab", "", "🦊 f", "aaa", "none", "e", "f the", "the exam of the 🦊 fox and more"]
    table = spark.createDataFrame([(a,) for a in asked] + [(None,)], "asked string")
    want = sorted({(a, entry) for a in asked for entry, _, text in rows if a in text})
    got = substrings.contained(table, texts)
    assert sorted(map(tuple, got.collect())) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(substrings, "NEEDLES_MOST", 2)
    assert sorted(map(tuple, substrings.contained(table, texts).collect())) == want


def test_keyword_forms_have_the_same_hits(spark):
    texts = ["the theThe the", "aaaa", "_the the_ thé the-the", "éthe thé the", "a.a a.a.a", "", " x y "]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for key in ("the", "aa", "a.a", "é", "a"):
        found = table.select(scoring._hits(F.lower("text"), key), F.regexp_count(F.lower("text"), F.lit(f"(?={re.escape(key)})")), scoring.keyword_hits(F.col("text"), [key, key]), 2.0 * F.regexp_count(F.lower("text"), F.lit(rf"(?U)\b{re.escape(key)}\b")), T.n_tokens("text"), F.size(T.tokens("text"))).collect()
        assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in found), key
    assert "(?=" not in str(table.select(scoring.blast_radius(F.col("text"), ["the"]))._jdf.queryExecution().analyzed().toString())
