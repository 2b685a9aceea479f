"""The queries of catalog in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import QUERY_NOISE
from .catalog import BATCH, LOOKUP, QUERY, RARE

CHUNK = """SELECT 'd' || doc_id AS id, source AS api_id, CASE lang WHEN 'en' THEN 'guide' WHEN 'fr' THEN 'glossary' WHEN 'de' THEN 'use-case' ELSE 'overview' END AS type,
'' AS title, coalesce(text, '') AS content FROM documents"""
TOKS = f"SELECT id, api_id, type, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS toks FROM ({CHUNK})"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def _bm25(text: str, where: str = "true", k: int = 60) -> str:
    words = text.split()
    asked = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""(WITH tk AS ({TOKS}), q(phrase, term) AS (VALUES {asked}), n AS (SELECT count(*) AS nn, avg(len(toks)) AS avgdl FROM tk),
tf AS (SELECT id, phrase, count(*) AS f FROM (SELECT id, unnest(toks) AS term FROM tk) JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.id, count(*) AS hits, round(sum(CASE WHEN ln((nn - df + 0.5) / (df + 0.5)) > 0 THEN ln((nn - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tk.toks) / avgdl))), 6) AS score
FROM tf JOIN df USING (phrase) JOIN tk ON tk.id = tf.id CROSS JOIN n WHERE {where} GROUP BY tf.id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM sc WHERE hits = {len(words)} QUALIFY fts_rank <= {k})"""


def _knn(vec_id: int, k: int, where: str = "true") -> str:
    return f"""(SELECT 'd' || e.vec_id AS id, round(list_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})), 6) AS distance
FROM embeddings e JOIN ({CHUNK}) c ON c.id = 'd' || e.vec_id WHERE {where} ORDER BY distance, id LIMIT {k})"""


def _ranked(inner: str, k: int) -> str:
    return f"(SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS vec_rank FROM {inner} QUALIFY vec_rank <= {k})"


def _post(vec_id: int, types: str) -> str:
    return _ranked(f"(SELECT x.* FROM {_knn(vec_id, 300)} x JOIN ({CHUNK}) c USING (id) WHERE c.type = '{types}')", 60)


def _fuse(query_id: int, lexical: str, near: str) -> str:
    return f"""(WITH u AS (SELECT id, fts_rank, NULL::BIGINT AS vec_rank FROM {lexical} UNION ALL SELECT id, NULL, vec_rank FROM {near}),
s AS (SELECT id, sum(1.0::DOUBLE / (60 + coalesce(fts_rank, vec_rank))) AS score, min(fts_rank) AS fts_rank, min(vec_rank) AS vec_rank FROM u GROUP BY id)
SELECT {query_id}::BIGINT AS query_id, id, score, fts_rank, vec_rank, row_number() OVER (ORDER BY score DESC, fts_rank ASC NULLS LAST, vec_rank ASC NULLS LAST) AS position FROM s QUALIFY position <= 20)"""


def _told(inner: str) -> str:
    return f"SELECT query_id, id, round(score, 9) AS score, coalesce(fts_rank, 0) AS fts_rank, coalesce(vec_rank, 0) AS vec_rank, position FROM {inner}"


_PARSED = f"SELECT id, api_id, sha256(content) AS content_hash, '2024-01-01 00:00:00' AS created_at FROM ({CHUNK})"
_STORED = """SELECT 'd' || l.doc_id AS id, source AS api_id, sha256(CASE WHEN quality = 1 THEN coalesce(text, '') ELSE coalesce(text, '') || ' (old)' END) AS content_hash, '2020-01-01 00:00:00' AS created_at
FROM labels l JOIN documents d ON l.doc_id = d.doc_id UNION ALL SELECT 'b' || item_id, 'bench', sha256(coalesce(text, '')), '2020-01-01 00:00:00' FROM benchmark"""
_CDC = f"""SELECT coalesce(p.id, s.id) AS id, CASE WHEN p.id IS NULL THEN 'delete' WHEN s.id IS NULL THEN 'insert' WHEN p.content_hash = s.content_hash THEN 'skip' ELSE 'update' END AS action
FROM ({_PARSED}) p FULL JOIN ({_STORED}) s ON p.id = s.id"""
_NAME = "'/docs/' || CASE lang WHEN 'fr' THEN 'API-Glossary' WHEN 'de' THEN 'my_use_case' WHEN 'es' THEN 'Use-Cases' ELSE 'guide-glossy' END || '-' || doc_id || '.md'"
_PHRASE = f"""WITH tk AS ({TOKS}), n AS (SELECT count(*) AS nn, avg(len(toks)) AS avgdl FROM tk),
tf AS (SELECT id, count(*) AS f, any_value(len(toks)) AS dl FROM (SELECT id, toks, unnest(range(1, len(toks))) AS i FROM tk) WHERE toks[i] = 'of' AND toks[i + 1] = 'the' GROUP BY id),
c AS (SELECT count(*) AS df FROM tf),
sc AS (SELECT id, round(CASE WHEN ln((nn - df + 0.5) / (df + 0.5)) > 0 THEN ln((nn - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM tf, c, n)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM sc QUALIFY fts_rank <= 60"""


def _sql(text: str) -> str:
    """A text as an SQL expression, line ends as chr(10)."""
    return "(" + " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n")) + ")"


# What the chunks of catalog.SPEC say besides names, numbers and paths.
_OVERVIEW = _sql("\n\nVersion: 1.0\n\nNation "), _sql(".\n\n## Servers\n\n- https://api.example.com (main)\n- https://test.example.com")
_GET = _sql("\n\nList items\n\n## Parameters\n\n- **limit** [query] : integer\n\n## Responses\n\n### 200: ok\n\nContent-Type: application/json\n- type: array of object")
_POST = _sql("\n\n## Request Body\n\nContent-Type: application/json\n- type: object\n  properties:\n    - id (integer)\n    - name (string) - Shown name\n    - tag (string)\n\n## Responses\n\n### 201: made")
_ITEM = _sql("# Item\n\n## Properties\n\n- **id** (integer) (required)\n- **name** (string) - Shown name\n- **tag** (string)")

def _units(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _cut_sql(table: str, keys: str, text: str, size: int) -> str:
    """Tables for texts cut after every so many UTF-16 units, character by character; cut: the keys, part (from 0), p."""
    return f"""chars AS (SELECT {keys}, c, i, 1 + (unicode(c) > 65535)::INT AS u FROM (SELECT {keys}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {table} WHERE {text} <> '')),
placed AS (SELECT *, sum(u) OVER (PARTITION BY {keys} ORDER BY i)::BIGINT - u AS pos FROM chars),
halves AS (SELECT {keys}, i, (pos // {size})::BIGINT AS part, CASE WHEN u = 2 AND pos % {size} = {size - 1} THEN chr(65533) ELSE c END AS c FROM placed
UNION ALL SELECT {keys}, i, (pos // {size})::BIGINT + 1, chr(65533) FROM placed WHERE u = 2 AND pos % {size} = {size - 1}),
cut AS (SELECT {keys}, part, string_agg(c, '' ORDER BY i) AS p FROM halves GROUP BY {keys}, part UNION ALL SELECT {keys}, 0, '' FROM {table} WHERE {text} = '')"""


def _pack_sql(delimiter: str, size: int) -> str:
    """Tables for the greedy packing of l (id, ps)."""
    over = f"cur <> '' AND {_units('cur')} + {_units(delimiter)} + {_units('ps[i + 1]')} > {size}"
    return f"""w AS (SELECT id, ps, 1 AS i, 0 AS piece, ps[1] AS cur FROM l
UNION ALL SELECT id, ps, i + 1, CASE WHEN {over} THEN piece + 1 ELSE piece END, CASE WHEN cur = '' OR {over} THEN ps[i + 1] ELSE cur || {delimiter} || ps[i + 1] END FROM w WHERE i < len(ps)),
packed AS (SELECT id, piece, arg_max(cur, i) AS p FROM w GROUP BY id, piece HAVING p <> ''), {_cut_sql("packed", "id, piece", "p", size)}"""



ORACLE_SQL = {
    "list_sources": "SELECT source AS name, count(*) AS n_chunks FROM documents GROUP BY 1 ORDER BY 1",
    "chunks_by_source": f"SELECT id, type, length(content)::BIGINT AS size FROM ({CHUNK}) WHERE api_id = 'src3'",
    "chunks_by_source_type": f"SELECT id, type, length(content)::BIGINT AS size FROM ({CHUNK}) WHERE api_id = 'src3' AND type = 'guide'",
    "chunk_by_id": f"SELECT * FROM ({CHUNK}) WHERE id = 'd7'",
    "chunks_by_ids": f"SELECT id, api_id, type, content FROM ({CHUNK}) WHERE id IN {LOOKUP}",
    "content_hash": f"SELECT id, sha256(content) AS content_hash FROM ({CHUNK})",
    "source_uuid5": """SELECT name, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id
FROM (SELECT name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(name)) AS h FROM (SELECT DISTINCT source AS name FROM documents))""",
    "slugify": f"SELECT page_id, {_slug('url')} AS slug FROM pages",
    "chunk_type_from_name": f"""SELECT doc_id, CASE WHEN f LIKE '%glossary%' THEN 'glossary' WHEN f LIKE '%use-case%' OR f LIKE '%use\\_case%' ESCAPE '\\' THEN 'use-case' ELSE 'guide' END AS type, file
FROM (SELECT doc_id, split_part({_NAME}, '/', -1) AS file, lower(file) AS f FROM documents)""",
    "trim_text": "SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^[\\s\\x{FEFF}\\x{0B}\\p{Z}]+|[\\s\\x{FEFF}\\x{0B}\\p{Z}]+$', '', 'g')) AS trimmed FROM documents",
    "hard_split": f"""WITH t AS ({CHUNK}), {_cut_sql("t", "id", "content", 3000)}
SELECT id, part, md5(p) AS digest, length(p)::BIGINT AS size FROM cut""",
    "utf16_split": f"""WITH t AS (SELECT id, translate(content, 'aeo', '𝐚𝐞𝐨') AS content FROM ({CHUNK})), {_cut_sql("t", "id", "content", 101)}
SELECT id, part, md5(p) AS digest, length(p)::BIGINT AS size FROM cut""",
    "paragraph_pack": f"""WITH RECURSIVE l AS (SELECT id, string_split(content, chr(10)) AS ps FROM ({CHUNK})), {_pack_sql("chr(10)", 3000)}
SELECT id, row_number() OVER (PARTITION BY id ORDER BY piece, part) - 1 AS part, md5(p) AS digest, length(p)::BIGINT AS size FROM cut""",
    "utf16_pack": f"""WITH RECURSIVE l AS (SELECT id, string_split(translate(content, 'aeo', '𝐚𝐞𝐨'), '. ') AS ps FROM ({CHUNK})), {_pack_sql("'. '", 400)}
SELECT id, row_number() OVER (PARTITION BY id ORDER BY piece, part) - 1 AS part, md5(p) AS digest, {_units("p")}::BIGINT AS units FROM cut""",
    "metadata_json_roundtrip": """SELECT event_id, len(k)::BIGINT AS n_keys, coalesce(array_to_string(k, ','), '') AS keys, coalesce(array_to_string(list_transform(k, lambda x: json_extract_string(props, '$.' || x)), ','), '') AS vals
FROM (SELECT event_id, props, list_sort(json_keys(props)) AS k FROM events)""",
    "tokenize_counts": f"SELECT id, len(toks)::BIGINT AS n_tokens FROM ({TOKS})",
    "postings": f"SELECT term, id, count(*) AS tf, min(i) - 1 AS first_pos FROM (SELECT id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM ({TOKS})) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(toks) AS term FROM ({TOKS})) GROUP BY 1",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM ({TOKS})",
    "bm25_topk": f"SELECT * FROM {_bm25(QUERY)}",
    "bm25_rare": f"SELECT * FROM {_bm25(RARE)}",
    "bm25_filtered": f"SELECT * FROM {_bm25(QUERY, 'tk.api_id IN (' + repr('src0') + ',' + repr('src3') + ',' + repr('src5') + ') AND tk.type IN (' + repr('use-case') + ',' + repr('guide') + ')')}",
    "bm25_phrase": _PHRASE,
    "bm25_blocks": f"SELECT * FROM {_bm25(QUERY, k=10)}",
    "bm25_blocks_filtered": f"SELECT * FROM {_bm25(QUERY, 'tk.api_id IN (' + repr('src0') + ',' + repr('src3') + ',' + repr('src5') + ') AND tk.type IN (' + repr('use-case') + ',' + repr('guide') + ')')}",
    "bm25_repeated_term": f"SELECT * FROM {_bm25('ones the ones')}",
    "knn_topk": f"SELECT * FROM {_ranked(_knn(0, 60), 60)}",
    "knn_pivots": f"SELECT * FROM {_ranked(_knn(20, 10), 10)}",
    "knn_post_filter": f"SELECT * FROM {_post(0, 'use-case')}",
    "knn_pre_filter": f"SELECT * FROM {_ranked(_knn(0, 60, 'c.type = ' + repr('use-case')), 60)}",
    "rrf_hybrid": _told(_fuse(0, _bm25(QUERY), _ranked(_knn(20, 60), 60))),
    "rrf_hybrid_filtered": _told(_fuse(0, _bm25(QUERY, "tk.type = 'use-case'"), _post(20, "use-case"))),
    "rrf_batch": " UNION ALL ".join(_told(_fuse(i, _bm25(t), _ranked(_knn(v, 60), 60))) for i, t, v in BATCH),
    "cdc_classify": _CDC,
    "cdc_counts": f"SELECT action, count(*) AS n FROM ({_CDC}) GROUP BY 1",
    "orphans": f"SELECT id, content_hash FROM ({_STORED}) WHERE id NOT IN (SELECT id FROM ({_PARSED}))",
    "merge_upsert": f"""SELECT * FROM ({_STORED}) WHERE id NOT IN (SELECT id FROM ({_PARSED})) UNION ALL
SELECT p.id, coalesce(s.api_id, p.api_id), p.content_hash, coalesce(s.created_at, p.created_at) FROM ({_PARSED}) p LEFT JOIN ({_STORED}) s ON p.id = s.id""",
    "delete_by_source": f"SELECT id, api_id FROM ({_STORED}) WHERE api_id <> 'src3'",
    "duplicate_names": f"SELECT {_slug('coalesce(text, ' + repr('') + ')')} AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "last_of_each": f"SELECT {_slug('coalesce(source, ' + repr('') + ')')} AS id, max(doc_id) AS seq FROM documents GROUP BY 1",
    "api_list_markdown": "SELECT '## Indexed APIs' || chr(10) || chr(10) || string_agg('- **' || name || '**', chr(10) ORDER BY name) AS text FROM (SELECT DISTINCT source AS name FROM documents)",
    "endpoint_listing": """SELECT page_id, CASE WHEN p <> '' THEN '- **GET** `' || p || '` — ' || url ELSE '- ' || url END AS line
FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages)""",
    "search_markdown": f"""SELECT f.position, '### ' || c.title || chr(10) || '`' || c.type || '` · ' || 'API ' || c.api_id || chr(10) || chr(10) || c.content AS section
FROM {_fuse(0, _bm25(RARE), _ranked(_knn(3, 60), 60))} f JOIN ({CHUNK}) c USING (id)""",
    "sanitised_query": f"SELECT page_id, trim(regexp_replace(translate(coalesce(url, ''), {_sql(QUERY_NOISE)}, repeat(' ', {len(QUERY_NOISE)})), '\\s+', ' ', 'g')) AS query FROM pages",
    "openapi_chunks": f"""WITH c AS (SELECT 'supplier-' || s_suppkey AS api_id, '/suppliers/' || s_suppkey || '/items' AS p, s_name AS name, s_nationkey AS nation FROM supplier),
x AS (SELECT api_id, 0 AS seq, 'overview' AS type, ':overview' AS part, name AS title, '# ' || name || {_OVERVIEW[0]} || nation || {_OVERVIEW[1]} AS content, NULL AS metadata FROM c
UNION ALL SELECT api_id, 1, 'endpoint', ':endpoint:get:' || p, 'GET ' || p, '# GET ' || p || {_GET}, '{{"path":"' || p || '","method":"get","tags":["items"],"operationId":"listItems"}}' FROM c
UNION ALL SELECT api_id, 2, 'endpoint', ':endpoint:post:' || p, 'POST ' || p, '# POST ' || p || {_POST}, '{{"path":"' || p || '","method":"post","tags":[],"operationId":null}}' FROM c
UNION ALL SELECT api_id, 3, 'schema', ':schema:Item', 'Item', {_ITEM}, '{{"schemaName":"Item","propertyCount":3}}' FROM c)
SELECT api_id || part AS id, api_id, type, title, content, sha256(content) AS content_hash, metadata, seq FROM x""",
    "markdown_chunks": """WITH f AS (SELECT row_number() OVER () AS k, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
s AS (SELECT k, doc_id, source, i, regexp_replace(ls[i], '^[\\s\\x{FEFF}\\x{0B}\\p{Z}]+|[\\s\\x{FEFF}\\x{0B}\\p{Z}]+$', '', 'g') AS c FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM f)),
p AS (SELECT *, unnest(range(0, (length(c) + 2999) // 3000)) AS j FROM s WHERE c <> '')
SELECT source || ':doc:doc-' || doc_id || ':doc-' || doc_id || CASE WHEN i > 1 THEN '/section' ELSE '' END || CASE WHEN length(c) > 3000 THEN ':' || j ELSE '' END AS id,
'guide' AS type, CASE WHEN i > 1 THEN 'Section' ELSE 'Doc ' || doc_id END AS title, sha256(substr(c, 1 + 3000 * j, 3000)) AS content_hash, (row_number() OVER (PARTITION BY k ORDER BY i, j) - 1)::INT AS seq FROM p""",
}
