"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from marlpit.functions import text as T
from marlpit.plans import constants as C


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def doc_id(number: str) -> str:
    return f"printf('DOC-%06d', {number})"


DOCUMENTS = f"docs AS (SELECT doc_id, {doc_id('doc_id + 1')} AS document_id, source AS title, text, sha256(text) AS sha256, source || '/' || doc_id || '.txt' AS source_path FROM documents)"


def chunked(text: str = "text", name: str = "chunks", of: str = "docs") -> str:
    return f"""{name}_cut AS (
        SELECT document_id, {text} AS whole, unnest(range(1, 1 + greatest(1, ceil((length({text}) - 150) / 850.0)::BIGINT))) AS sequence FROM {of} WHERE length({text}) > 0
    ), {name} AS (
        SELECT document_id || '-CH-' || printf('%06d', sequence) AS chunk_id, document_id, sequence::INT AS sequence, ((sequence - 1) * 850)::INT AS char_start,
            least((sequence - 1) * 850 + 1000, length(whole))::INT AS char_end, substring(whole, ((sequence - 1) * 850 + 1)::BIGINT, 1000) AS text FROM {name}_cut)"""


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')"


CHUNKS = f"{DOCUMENTS}, {chunked()}"
VECTORS = f"vectors AS (SELECT {doc_id('vec_id + 1')} || '-CH-000001' AS chunk_id, embedding::DOUBLE[] AS embedding FROM embeddings), probe AS (SELECT embedding::DOUBLE[] AS asked FROM embeddings WHERE vec_id = {C.PROBE} LIMIT 1)"
COSINE = "round(list_cosine_similarity(embedding, asked), 6)"


def saturated(tf: str, size: str, mean: str) -> str:
    return f"({tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {size} / greatest({mean}, 1.0::DOUBLE))))"


def idf(n: str, df: str) -> str:
    return f"ln(({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE) + 1.0::DOUBLE)"


POSTINGS = f"""tokens AS (SELECT chunk_id, document_id, sequence, text, {words('text')} AS tokens FROM chunks),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens))::DOUBLE AS mean FROM tokens),
    postings AS (SELECT chunk_id, term, count(*)::DOUBLE AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL),
    frequency AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS cf FROM postings GROUP BY term)"""


def bm25(limit: int) -> str:
    asked = ", ".join(f"({quoted(w)})" for w in C.QUERY.lower().split())
    return f"""{POSTINGS}, asked AS (SELECT term, count(*)::DOUBLE AS times FROM (VALUES {asked}) AS v(term) GROUP BY term),
    lexical AS (
        SELECT chunk_id, document_id, sequence, any_value(t.text) AS text, round(sum(times * {idf('n', 'df')} * {saturated('tf', 'len(tokens)', 'mean')}), 6) AS score
        FROM asked JOIN frequency USING (term) JOIN postings USING (term) JOIN tokens AS t USING (chunk_id), stats GROUP BY chunk_id, document_id, sequence
        HAVING score > 0 ORDER BY score DESC, document_id, sequence LIMIT {limit})"""


HYBRID = f"""{CHUNKS}, {VECTORS}, {bm25(10)},
    dense AS (SELECT chunk_id, document_id, sequence, text, {COSINE} AS score FROM vectors JOIN chunks USING (chunk_id), probe WHERE NOT isnan({COSINE}) ORDER BY score DESC, chunk_id LIMIT 10),
    fused AS (
        SELECT chunk_id, coalesce(l.document_id, d.document_id) AS document_id, coalesce(l.sequence, d.sequence) AS sequence, coalesce(l.text, d.text) AS text,
            round(0.4::DOUBLE * coalesce(l.score, 0) + 0.6::DOUBLE * coalesce(d.score, 0), 6) AS score FROM lexical AS l FULL JOIN dense AS d USING (chunk_id))"""


def top_fused(n: int) -> str:
    return f"SELECT * FROM fused ORDER BY score DESC, document_id, sequence LIMIT {n}"


def total(parts: list[str]) -> str:
    return "(" + " + ".join(parts or ["0"]) + ")"


def blast(text: str, keywords: list[str]) -> str:
    t, parts = f"lower({text})", []
    for key in dict.fromkeys(k.lower() for k in keywords):
        times = sum(k.lower() == key for k in keywords)
        hits = f"({times} * ((length({t}) - length(replace({t}, {quoted(key)}, ''))) // {len(key)}))"
        first, last = f"instr({t}, {quoted(key)})", f"(length({t}) - {len(key)} + 2 - instr(reverse({t}), {quoted(key[::-1])}))"
        parts.append(f"CASE WHEN {hits} >= 2 THEN {times} / (1 + CASE WHEN ({last} - {first}) / ({hits} - 1)::DOUBLE > 35000 THEN 'inf'::DOUBLE ELSE exp(({last} - {first}) / ({hits} - 1)::DOUBLE / 50) END) ELSE 0 END")
    return f"least(1.0::DOUBLE, {total(parts)}::DOUBLE / {max(1, len(keywords))})"


def frequency(text: str, keywords: list[str]) -> str:
    split = f"string_split_regex(lower({text}), '[^\\pL\\pN\\pM_]+')"
    phrases = [f"len(list_filter({split}, lambda x: x = {quoted(k.lower())}))" for k in keywords]
    return f"least(1.0::DOUBLE, {total(phrases)}::DOUBLE / ({len(keywords)} * greatest(1.0::DOUBLE, sqrt(len({words(text)})::DOUBLE))))"


def relevance(text: str, terms: list[str]) -> str:
    terms = sorted({t.lower() for t in terms})
    return f"({total([f'contains(lower({text}), {quoted(t)})::INT' for t in terms])}::DOUBLE / {len(terms)})" if terms else "0.5::DOUBLE"


def score(text: str, keywords: list[str], terms: list[str] = ()) -> str:
    return f"({blast(text, keywords)} * 0.4::DOUBLE + {frequency(text, keywords)} * 0.3::DOUBLE + {relevance(text, terms)} * 0.3::DOUBLE)"


def level(x: str) -> str:
    return f"greatest(0, least(10, round_even({x} * 10.0::DOUBLE, 0)::INT))::INT"


def matching(text: str, keywords: list[str]) -> str:
    return f"list_filter([{', '.join(map(quoted, keywords))}], lambda k: contains(lower({text}), lower(k)))"


def cleaned(text: str) -> str:
    for form in T.BOILERPLATE:
        text = f"regexp_replace({text}, {quoted(form)}, '', 'gi')"
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), '\A[\s\pZ]+|[\s\pZ]+\z', '', 'g')"


def literal(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\n\t" else quoted(c) for c in text)


def routed(column: str, text: str) -> str:
    at = {"intent": 0, "tool": 1, "confidence": 2, "reason": 3}[column]
    show = (lambda x: f"{x}::DOUBLE") if at == 2 else quoted
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {quoted(w)})' for w in words)} THEN {show(head[at])}" for *head, words in T.ROUTES)
    return f"CASE {cases} ELSE {show(T.NO_ROUTE[at])} END AS {column}"


def rule_names(text: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({text}), {quoted(k.lower())})' for k in ks)} THEN {quoted(name)} END" for name, ks in C.RULES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def picked(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(map(quoted, values))}][(({key}) % {len(values)} + 1)::INT]"


def mapped(values: dict[str, str], default: str) -> str:
    return "CASE extension " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(default)} END"


FEEDBACK = """SELECT doc_id, 'User feedback: ' || CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END || ' for document ' || doc_id AS content,
    CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS is_correct, CASE WHEN toxic = 1 THEN 'toxic' END AS comments FROM labels"""
#: A memory is found by its content or by any value of its context.
REMEMBERED = "(contains(lower(f.content), asked) OR contains('user_feedback', asked) OR contains(lower(f.is_correct), asked) OR contains(f.doc_id::VARCHAR, asked) OR contains('u1', asked) OR coalesce(contains(f.comments, asked), false))"
ASKED = "SELECT item_id::BIGINT AS item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(t)})" for i, t in C.ASKED_OF_MEMORY) + ") AS v(item_id, text)"


def node(name: str, key: str, label: str, kind: str, owner: str) -> str:
    return f"SELECT '{name}-' || {key} AS id, {label} AS name, '{kind}' AS entity_type, '-' AS description, '{owner}' AS owner, 0 AS n_metadata FROM {name}"


NODES = "nodes AS (" + " UNION ALL ".join([node("region", "r_regionkey", "r_name", "system", "geo"), node("nation", "n_nationkey", "n_name", "process", "geo"), node("supplier", "s_suppkey", "s_name", "person", "sales")]) + ")"
EDGES = """edges AS (
    SELECT 'nation-' || n_nationkey AS source_id, 'region-' || n_regionkey AS target_id, 'depends_on' AS relation_type, 1.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'related_to', 1.0::DOUBLE FROM supplier)"""
WORDED = f"lower({picked(C.PREFIXES, 'conv_id')} || text)"
NAME = "list_last(string_split(path, '/'))"
EXTENSION = f"lower(regexp_extract({NAME}, '^[.]*[^.].*?([.][^.]*)$', 1))"
ELIGIBLE = [(name, words) for (name, words), form in zip(C.RULES, C.FORMS, strict=True) if form and words]
RULE_WORDS = list(dict.fromkeys(k for _, ks in ELIGIBLE for k in ks))
KNOWN = f"known AS (SELECT sha256, min(document_id) AS document_id FROM docs WHERE document_id <= {doc_id(str(C.KNOWN))} GROUP BY 1)"


def registered(order: str) -> str:
    """ids: document ids of all contents, new ones numbered on in the order of the first file that has them."""
    return f"""{KNOWN}, fresh AS (SELECT sha256, min({order}) AS first FROM docs WHERE sha256 NOT IN (SELECT sha256 FROM known) GROUP BY 1),
        ids AS (SELECT sha256, {doc_id('(SELECT count(*) FROM known) + row_number() OVER (ORDER BY first)')} AS document_id, false AS known FROM fresh UNION ALL SELECT sha256, document_id, true FROM known)"""


def phrase_frequency(text: str, phrases: list[str]) -> str:
    """Phrases of several words stand as whole words where the same words are neighbours across one blank."""
    spaced = f"regexp_replace(lower({text}), '([^\\pL\\pN\\pM_])', ' \\1 ', 'g')"
    hits = []
    for phrase in phrases:
        form = "   ".join(phrase.split(" "))
        padded = f"replace(' ' || {spaced} || ' ', {quoted(f' {form} ')}, {quoted(chr(1) + chr(1))})"
        hits.append(f"(length({padded}) - length(replace({padded}, chr(1) || chr(1), '')))// 2")
    return f"least(1.0::DOUBLE, {total(hits)}::DOUBLE / ({len(phrases)} * greatest(1.0::DOUBLE, sqrt(len({words(text)})::DOUBLE))))"


def processed(eligible: bool) -> str:
    """What is said of each document, of which every hundredth can't be read."""
    path = f"(source || '/' || doc_id || {picked(C.EXTENSIONS, 'doc_id')})"
    s = f"({blast('text', RULE_WORDS)} * 0.4::DOUBLE + {phrase_frequency('text', RULE_WORDS)} * 0.3::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE)"
    scores = (f"{level(f'round({s}, 9)')} / 10.0::DOUBLE", f"round({blast('text', RULE_WORDS)}, 6)", f"round({phrase_frequency('text', RULE_WORDS)}, 6)") if eligible else ("0.85::DOUBLE", "0.5::DOUBLE", "0.5::DOUBLE")
    names = "|".join(name for name, _ in ELIGIBLE) if eligible else ""
    unread = "doc_id % 100 = 0"
    values = [f"CASE WHEN {unread} THEN 0.0::DOUBLE ELSE {x} END AS {name}" for name, x in zip(("confidence_score", "blast_radius", "term_frequency", "metadata_confidence"), (*scores, "0.85::DOUBLE"), strict=True)]
    return f"""SELECT doc_id, {NAME} AS title, 'unknown' AS author, CASE WHEN {unread} THEN 'other' ELSE {mapped(T.DOCUMENT_TYPES, 'other')} END AS document_type, 'indexed' AS status,
        CASE WHEN {unread} THEN '' ELSE {quoted(names)} END AS patterns_found, {', '.join(values)} FROM (SELECT *, {EXTENSION} AS extension FROM (SELECT *, {path} AS path FROM documents))"""


#: Eligible rules have a form, which every third part has, and keywords, which every fifth lacks.
RULE_ROWS = "SELECT 'p' || p_partkey AS pattern_id, p_brand AS name, string_split(p_name, ' ') AS words FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0"


INDEXED = f"""WITH {CHUNKS}, {VECTORS} SELECT chunk_id, concat_ws(',', {', '.join(f"length(text) - length(replace(lower(text), '{v}', ''))" for v in 'aeiou')}) AS embedding
        FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors)"""

ORACLE_SQL = {
    "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
    "chunk_load_order": f"WITH {CHUNKS} SELECT chunk_id, document_id, sequence, char_start, char_end FROM chunks ORDER BY document_id, sequence",
    "clean_text": f"SELECT doc_id, {cleaned(f'({literal(C.FRAME_HEAD)} || text || {literal(C.FRAME_TAIL)})')} AS cleaned FROM documents",
    "fingerprint_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "register_dedup": f"""WITH {DOCUMENTS}, {registered('doc_id')}
        SELECT doc_id, sha256, ids.document_id, coalesce(ids.known, false) AS known FROM docs LEFT JOIN ids USING (sha256)""",
    "register_paths": f"""WITH {DOCUMENTS}, {registered('source_path')}
        SELECT source_path AS path, sha256, ids.document_id, coalesce(ids.known, false) AS known FROM docs LEFT JOIN ids USING (sha256)""",
    "ingest_documents": f"""WITH {DOCUMENTS}, {registered('source_path')}, rows AS (
            SELECT ids.document_id, min(source_path) AS source_path, sha256, {cleaned('arg_min(docs.text, source_path)')} AS text FROM docs JOIN ids USING (sha256) WHERE NOT known GROUP BY ids.document_id, sha256
        ), {chunked(of='rows')}, n AS (SELECT document_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY 1)
        SELECT document_id, list_last(string_split(source_path, '/')) AS title, 'UNKNOWN' AS team_owner, 'UNKNOWN' AS document_type, 'Internal' AS visibility, '1.0.0' AS version, sha256, source_path,
            coalesce(n_chunks, 0) AS n_chunks, coalesce(n_chars, 0) AS n_chars FROM rows LEFT JOIN n USING (document_id)""",
    "index_vectors": INDEXED,
    "index_vectors_model": INDEXED,
    "document_rows": f"WITH {DOCUMENTS} SELECT document_id, title, sha256, source_path, 'UNKNOWN' AS team_owner, 'UNKNOWN' AS document_type, 'Internal' AS visibility, '1.0.0' AS version FROM docs",
    "doc_term_frequency": f"WITH {CHUNKS}, {POSTINGS} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM frequency",
    "corpus_stats": f"WITH {CHUNKS}, {POSTINGS} SELECT n::BIGINT AS n_chunks, round(mean, 6) AS avg_tokens FROM stats",
    "bm25_topk": f"WITH {CHUNKS}, {bm25(10)} SELECT chunk_id, document_id, score FROM lexical",
    "batch_search_topk": f"""WITH {CHUNKS}, {POSTINGS}, asked AS (SELECT item_id, term, count(*)::DOUBLE AS times FROM (SELECT item_id, unnest({words('text')}) AS term FROM benchmark) GROUP BY ALL),
        scored AS (SELECT item_id, chunk_id, document_id, sequence, round(sum(times * {idf('n', 'df')} * {saturated('tf', 'len(tokens)', 'mean')}), 6) AS score
            FROM asked JOIN frequency USING (term) JOIN postings USING (term) JOIN tokens USING (chunk_id), stats GROUP BY ALL)
        SELECT item_id, rank, chunk_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, sequence))::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 5""",
    "index_search_topk": f"WITH {CHUNKS}, {bm25(10)} SELECT chunk_id, document_id, score FROM lexical",
    "index_statistics": f"""WITH {DOCUMENTS}, {chunked(name="old")}, {chunked("substring(text, 1, greatest(0, length(text) - 500))", "again")},
        chunks AS (SELECT * FROM (SELECT * FROM again UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM again)) WHERE sequence <> 2), {POSTINGS} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM frequency""",
    "vector_topk": f"WITH {VECTORS} SELECT chunk_id, {COSINE} AS score FROM vectors, probe WHERE NOT isnan({COSINE}) ORDER BY score DESC, chunk_id LIMIT 5",
    "vector_search_many": """SELECT vec_id, rank, chunk_id, score FROM (
        SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (
            SELECT q.vec_id, c.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
            FROM embeddings AS q, embeddings AS c WHERE q.vec_id % 20 = 0) WHERE NOT isnan(score)) WHERE rank <= 5""",
    "vector_chunk_join": f"WITH {CHUNKS}, {VECTORS} SELECT chunk_id, document_id, len(embedding)::INT AS dimensions, text FROM vectors JOIN chunks USING (chunk_id)",
    "vector_json": f"WITH {VECTORS} SELECT chunk_id, len(embedding)::INT AS dimensions, round(list_sum(embedding), 4) AS total FROM vectors",
    "hybrid_topk": f"WITH {HYBRID} SELECT chunk_id, document_id, score FROM ({top_fused(5)})",
    "rerank_topk": f"WITH {HYBRID} SELECT chunk_id, document_id, round({score('text', C.QUERY.split()[:10])}, 6) AS score FROM ({top_fused(10)}) ORDER BY score DESC, chunk_id LIMIT 3",
    "answer_best": f"""WITH {HYBRID}, best AS (SELECT document_id, text, chunk_id, round({score('text', C.QUERY.split()[:10])}, 6) AS s FROM ({top_fused(10)}) ORDER BY s DESC, chunk_id LIMIT 1)
        SELECT true AS success, best.text AS answer, title, best.document_id, best.chunk_id, s AS score FROM best LEFT JOIN docs USING (document_id)""",
    "blast_radius": f"SELECT doc_id, round({blast('text', C.KEYWORDS)}, 6) AS blast_radius FROM documents",
    "term_frequency_score": f"SELECT doc_id, round({frequency('text', C.KEYWORDS)}, 6) AS term_frequency FROM documents",
    "contextual_relevance": f"SELECT doc_id, round({relevance('text', C.KNOWN_TERMS)}, 6) AS relevance FROM documents",
    "matching_keywords": f"SELECT doc_id, array_to_string({matching('text', C.KEYWORDS)}, '|') AS keywords FROM documents",
    "score_documents": f"SELECT doc_id, round(s, 6) AS score, {level('round(s, 9)')} AS confidence_level, n::INT AS n_matching FROM (SELECT doc_id, {score('text', C.KEYWORDS, C.KNOWN_TERMS)} AS s, len({matching('text', C.KEYWORDS)}) AS n FROM documents)",
    "query_documents": f"""SELECT doc_id, title, level / 10.0::DOUBLE AS score, level AS confidence_level, blast_radius, term_frequency, type, matching_keywords FROM (
        SELECT doc_id, source AS title, lang AS type, {level('round(s, 9)')} AS level, round(s, 6) AS place, round({blast('text', C.QUERY.split()[:10])}, 6) AS blast_radius, round({frequency('text', C.QUERY.split()[:10])}, 6) AS term_frequency,
            array_to_string({matching('text', C.QUERY.split()[:10])}, '|') AS matching_keywords FROM (SELECT *, {score('text', C.QUERY.split()[:10])} AS s FROM documents)) ORDER BY place DESC, doc_id LIMIT 5""",
    "agent_confidence": f"SELECT 'SPM Agent' AS agent, {level('round(coalesce(avg(quality), 0)::DOUBLE, 9)')} AS confidence FROM labels",
    "agent_levels_stream": f"""SELECT agent, count(*) AS documents, {level('round(avg(score), 9)')} AS confidence
        FROM (SELECT d.source AS agent, doc_id, max(l.quality)::DOUBLE AS score FROM labels AS l JOIN documents AS d USING (doc_id) WHERE d.source IS NOT NULL AND l.quality IS NOT NULL GROUP BY ALL) GROUP BY agent""",
    "confidence_labels": f"""SELECT vec_id, CASE WHEN score >= 0.08 THEN 'HIGH' WHEN score >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS label, CASE WHEN score * 10 >= 7 THEN 'success' WHEN score * 10 >= 5 THEN 'primary' ELSE 'warning' END AS chip
        FROM (SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings AS e, (SELECT embedding FROM embeddings WHERE vec_id = {C.PROBE} LIMIT 1) AS p)""",
    "intent_route": f"SELECT conv_id, turn, {', '.join(routed(c, WORDED) for c in ('intent', 'tool', 'confidence', 'reason'))} FROM conversations",
    "memory_search": f"SELECT conv_id, turn FROM conversations WHERE contains(lower(text), {quoted(C.MEMORY_QUERY.lower())}) OR contains(lower(role), {quoted(C.MEMORY_QUERY.lower())})",
    "rule_match": f"SELECT conv_id, turn, array_to_string(names, ', ') AS patterns FROM (SELECT conv_id, turn, {rule_names('text')} AS names FROM conversations) WHERE len(names) > 0",
    "think_summary": f"""SELECT item_id, memories, CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'none' END AS patterns, CASE WHEN memories > 0 OR len(names) > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
            'Based on ' || memories || ' relevant memories and ' || len(names) || ' pattern matches, I can provide a confident response about ' || chr(39) || text || chr(39) AS final_reasoning,
            'understanding / Understanding query: ' || chr(39) || text || chr(39) || ' /  // memory_retrieval / Retrieved ' || memories || ' relevant memories / ' || memories
            || ' /  // pattern_analysis / Identified ' || len(names) || ' matching patterns: ' || CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'none' END || ' / ' || array_to_string(names, '+') AS intermediate_steps
        FROM (SELECT item_id, text, {rule_names('text')} AS names, (SELECT count(*) FROM ({FEEDBACK}) AS f WHERE {REMEMBERED}) AS memories FROM (SELECT *, lower(text) AS asked FROM ({ASKED})) AS b)""",
    "memory_index_search": f"""SELECT asked, count(*) AS memories FROM (SELECT DISTINCT asked FROM (SELECT lower(substring(text, 1, 12)) AS asked FROM benchmark UNION ALL SELECT * FROM (VALUES {', '.join(f'({quoted(x)})' for x in C.NEEDLES)}) AS v(asked))) AS a
        JOIN conversations AS c ON contains(lower(c.text), asked) OR contains(lower(c.role), asked) GROUP BY asked""",
    "feedback_memory": f"SELECT doc_id, content, 'user_feedback' AS feedback_type, is_correct, 'u1' AS user_id, coalesce(comments, '-') AS comments, (4 + (comments IS NOT NULL)::INT)::INT AS n_context, 0.85::DOUBLE AS confidence FROM ({FEEDBACK})",
    "rules_eligible": f"""SELECT DISTINCT pattern_id, unnest(words || [upper(words[1])]) AS keyword FROM ({RULE_ROWS})""",
    "graph_upsert": f"""WITH {NODES}, changed AS (SELECT 'nation-' || (n_nationkey + 3) AS id, n_name AS name, 'metric' AS entity_type, 'new' AS description, '-' AS owner, -1 AS n_metadata FROM nation WHERE n_nationkey >= 20)
        SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM changed) UNION ALL SELECT * FROM changed""",
    "graph_relationship_upsert": f"""WITH {EDGES} SELECT source_id, target_id, relation_type, CASE WHEN source_id LIKE 'nation-%' THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM edges
        UNION ALL SELECT source_id, target_id, 'uses', confidence FROM edges WHERE source_id LIKE 'nation-%'""",
    "graph_neighbors": f"WITH {EDGES} SELECT source_id, target_id, relation_type FROM edges WHERE source_id = '{C.NODE}' OR target_id = '{C.NODE}'",
    "graph_neighbors_many": f"WITH {EDGES} SELECT source_id, target_id, relation_type FROM edges WHERE source_id LIKE 'region-%' OR target_id LIKE 'region-%'",
    "graph_entities_by_type": f"WITH {NODES} SELECT id, name FROM nodes WHERE entity_type = 'process'",
    "graph_entity": f"WITH {NODES} SELECT id, name, entity_type, n_metadata FROM nodes WHERE id = '{C.NODE}'",
    "classify_extension": f"""SELECT page_id, file_name, {mapped(T.DOCUMENT_TYPES, 'other')} AS document_type, {mapped(T.MIME_TYPES, T.UNKNOWN_MIME)} AS mime_type FROM (
        SELECT page_id, {NAME} AS file_name, {EXTENSION} AS extension FROM (SELECT page_id, regexp_replace(url, '[?#].*', '') || {picked(C.EXTENSIONS, 'page_id')} AS path FROM pages))""",
    "page_texts": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY conv_id",
    "stored_lookup": f"WITH {DOCUMENTS} SELECT document_id, CASE WHEN document_id LIKE '%0' THEN upper(title) ELSE title END AS title, source_path FROM docs WHERE document_id IN ({', '.join(quoted(f'DOC-{k:06d}') for k in C.LOOKED_UP)})",
    "stored_membership": f"""WITH {DOCUMENTS}, kept AS (SELECT document_id, CASE WHEN document_id LIKE '%0' THEN sha256(sha256) ELSE sha256 END AS sha256 FROM docs)
        SELECT sha256, min(document_id) AS document_id, count(*) AS n_documents FROM kept WHERE sha256 IN (SELECT sha256 FROM docs UNION ALL SELECT sha256(text) FROM benchmark) GROUP BY sha256""",
    "point_lookup_document": f"WITH {DOCUMENTS} SELECT document_id, title, source_path FROM docs WHERE document_id = '{C.DOCUMENT}'",
    "chunk_upsert": f"""WITH {DOCUMENTS}, {chunked()}, {chunked("substring(text, 1, greatest(0, length(text) - 500))", "again")}
        SELECT chunk_id, char_end, length(text) AS n_chars FROM again UNION ALL SELECT chunk_id, char_end, length(text) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM again)""",
    "process_documents": processed(True),
    "process_documents_unruled": processed(False),
    "self_test": f"SELECT name, count(*) AS rules, true AS passed, (count(*) < 5)::INT AS n_issues, " + ", ".join(f"{v}::DOUBLE AS {k}" for k, v in C.SELF_TEST.items()) + f" FROM ({RULE_ROWS}) GROUP BY name",
}
