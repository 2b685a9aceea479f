"""The thin queries op1 to op13, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that op1 wrote, read back from its shards: null texts are end marks alone, null ids stay null, an empty table gives no rows."""
    from . import materialise, shared

    folder = shared.new_path(spark, "shards")
    index = materialise.materialise(_read(spark, sf_dir, "documents"), folder, size=1024)
    out = materialise.read_shards(spark, folder, index, size=1024)
    return out.select("slot", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents: null and empty texts score 0, equal rows score equally; with no labels all scores are 0."""
    from .toxicity import toxicity

    out = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 20: unusable vectors and null ids take no part, ties go to smaller ids."""
    from .ann import search

    return search(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows: null and empty texts have no words, equal rows count as two texts."""
    from .substring import drop_repeats

    out = drop_repeats(_read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of a document that is like an item: documents that are not listed are clean, null and short texts too; equal rows count once."""
    from .decontam import leaks

    out = leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("item").alias("item_id"), F.col("start").cast("long").alias("start"), F.round("similarity", 6).alias("similarity"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record was looked up in the archives: null html is an empty payload, a null URL or id is kept as such."""
    from . import shared, warc

    folder = shared.new_path(spark, "warc")
    pages = _read(spark, sf_dir, "pages")
    directory = warc.write_archives(pages, folder)
    out = warc.lookup(pages, folder, directory)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated bytes: null and empty texts have no bytes, equal rows count as two texts."""
    from .lpf import drop_repeated_bytes

    out = drop_repeated_bytes(_read(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece and its place: null and empty texts are one token, equal rows are packed each."""
    from .packing import pack

    out = pack(_read(spark, sf_dir, "documents"), capacity=4096)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its component: null and wordless texts have empty sets and stand alone, equal rows are linked."""
    from .neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), percent=85, size=5)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: null and empty pages have empty texts; pages without a host share one wrapper."""
    from .html import main_text

    return main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every row of documents: null fields, ids and sources have a place of their own, equal rows have equal leaves and two places."""
    from .merkle import manifest

    out = manifest(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


#: Rules of op12: verdict, host/path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page: null URLs have an empty host and path, null ids stay null, equal rows are judged alike.

    A URL is labelled by the document that it names (the number in its last segment): bad if that is of low quality or toxic.
    """
    from .urls import judge

    pages = _read(spark, sf_dir, "pages")
    bad = F.max(F.greatest(1 - F.col("quality"), F.col("toxic")))
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(bad.alias("bad"))
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]+)[^/?#]*/?([?#]|$)', 1), '') AS bigint)")
    labelled = pages.select("url", number.alias("doc_id")).filter("doc_id IS NOT NULL").join(labels, "doc_id").select("url", "bad")
    out = judge(pages, labelled, URL_RULES, carry=("page_id",))
    return out.select(F.col("carry0").alias("page_id"), "host", "path", "rule", "verdict", "template")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component: null and unusable vectors are left out, null and repeated ids stay, no rows without vectors."""
    from .whitening import whiten

    out = whiten(_read(spark, sf_dir, "embeddings"))
    at = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own")
    out = out.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", at)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "own.whitened", "own.explained", "identity_error")


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_toxicity": op2_toxicity,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_lpf_dedup": op7_lpf_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_filters": op12_url_filters,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: A field of a leaf, and the CRC-32 of a decimal number, bit by bit.
_FIELD = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_BITS = "list_reduce(range(0, 8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, {0})"
_CRC32 = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda r, x: xor(r >> 8, " + _BITS.format("xor(r & 255, x)") + "), 4294967295), 4294967295)"

def _template_sql() -> str:
    """op12 in SQL: each level of the tree as tables of its own."""
    s = "list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{n}', 'g'))"
    part = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {}), '')"
    host = f"translate({part.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    number = r"try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]+)[^/?#]*/?([?#]|$)', 1), '') AS BIGINT)"
    odd = "(lab >= 5 AND tl > lab AND tb > 0 AND tl > tb AND (bad * (tl - lab) - (tb - bad) * lab)::DOUBLE ** 2 * tl / (lab::DOUBLE * (tl - lab) * tb * (tl - tb)) >= 3.841)"
    out = [
        f"p AS (SELECT row_number() OVER () AS k, page_id, url, {host} AS host, {part.format(2)} AS path FROM pages)",
        f"m AS (SELECT k, max(greatest(1 - quality, toxic)) AS bad FROM p JOIN labels ON doc_id = {number} GROUP BY k)",
        f"r0 AS (SELECT p.k, host AS node, NULL::VARCHAR AS above, {s} AS segs, (m.bad IS NOT NULL)::BIGINT AS lab, coalesce(m.bad, 0)::BIGINT AS bad FROM p LEFT JOIN m ON m.k = p.k)",
        "q0 AS (SELECT node, (sum(bad) + 4 * coalesce((SELECT sum(bad) / sum(lab) FROM r0), 0)) / (sum(lab) + 4) AS rate FROM r0 GROUP BY node)",
    ]
    for k in range(4):
        out += [
            f"c{k} AS (SELECT node, node || '/' || segs[{k + 1}] AS link, count(*)::BIGINT AS n, sum(lab)::BIGINT AS lab, sum(bad)::BIGINT AS bad FROM r{k} WHERE len(segs) > {k} GROUP BY ALL)",
            f"d{k} AS (SELECT *, count(*) OVER w AS kids, (sum(n) OVER w)::BIGINT AS tn, (sum(lab) OVER w)::BIGINT AS tl, (sum(bad) OVER w)::BIGINT AS tb FROM c{k} WINDOW w AS (PARTITION BY node))",
            f"e{k} AS (SELECT node, link, lab, bad, CASE WHEN kids = 1 THEN link WHEN kids >= 8 AND 2 * kids > tn OR NOT {odd} THEN node || '/*' WHEN bad * tl > tb * lab THEN node || '/{{+}}' ELSE node || '/{{-}}' END AS next FROM d{k})",
            f"f{k} AS (SELECT *, count(*) OVER w AS kids, (sum(lab) OVER w)::BIGINT AS tl, (sum(bad) OVER w)::BIGINT AS tb FROM e{k} WINDOW w AS (PARTITION BY next))",
            f"g{k} AS (SELECT link, CASE WHEN next IN (node || '/{{+}}', node || '/{{-}}') AND (kids = 1 OR {odd}) THEN link ELSE next END AS next FROM f{k})",
            f"r{k + 1} AS (SELECT k, coalesce(next, node) AS node, CASE WHEN next IS NOT NULL THEN node END AS above, segs, lab, bad FROM r{k} LEFT JOIN g{k} ON link = node || '/' || segs[{k + 1}])",
            f"q{k + 1} AS (SELECT * FROM q{k} UNION ALL SELECT r.node, (sum(bad) + 4 * any_value(rate)) / (sum(lab) + 4) FROM r{k + 1} r JOIN q{k} q ON q.node = r.above GROUP BY r.node)",
        ]
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND path LIKE '/{r.partition('/')[2]}%'"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in rules) + " WHEN 1 - rate < 0.5 THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(out)} SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, r4.node || CASE WHEN len(segs) > 4 THEN '/**' ELSE '' END AS template FROM p JOIN r4 ON r4.k = p.k JOIN q4 ON q4.node = r4.node"


ORACLE_SQL = {
    "op4_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k, i FROM win WHERE h IN (SELECT h FROM rep)),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM hit),
word AS (SELECT k, w[i] AS x, i FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT word.k, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.k = gone.k AND word.i = gone.i GROUP BY word.k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.k = kept.k
""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS v, doc_id AS l FROM d UNION SELECT e.y, r.l FROM r JOIN e ON e.x = r.v),
m AS (SELECT v, min(l) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op5_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, w, len(w) AS len FROM (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, text FROM documents)),
b AS (SELECT row_number() OVER () AS j, item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5),
ds AS (SELECT k, doc_id, len, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS h FROM (SELECT k, doc_id, len, w, unnest(range(0, len - 4)) AS i FROM d WHERE len >= 5)),
bs AS (SELECT j, item_id, n, h, count(*) AS c FROM (SELECT j, item_id, n, md5(array_to_string(w[i + 1:i + 5], ' ')) AS h FROM (SELECT j, item_id, n, w, unnest(range(0, n - 4)) AS i FROM b)) GROUP BY ALL),
hit AS (SELECT k, doc_id, len, j, item_id, n, h, c, unnest(range(greatest(0, i - least(n, len) + 5), least(i, greatest(0, len - n)) + 1)) AS st FROM ds JOIN bs USING (h)),
x AS (SELECT k, doc_id, len, j, item_id, n, st, h, least(count(*), c) AS s FROM hit GROUP BY k, doc_id, len, j, item_id, n, st, h, c),
y AS (SELECT k, doc_id, j, item_id, st, sum(s)::DOUBLE / (least(n, len) - 4 + n - 4 - sum(s)) AS s FROM x GROUP BY k, doc_id, len, j, item_id, n, st)
SELECT doc_id, item_id, st::BIGINT AS start, round(s, 6) AS similarity FROM y WHERE s >= 0.8
""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes = g.payload_bytes
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, source, {_LEAF.format(text="text")} AS leaf,
CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad FROM documents),
l AS (SELECT k, doc_id, leaf, coalesce(bad, leaf) AS seen, coalesce('=' || source, '') AS s,
row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT 0 AS level, s, pos, n, leaf AS h FROM l UNION ALL
SELECT level + 1, s, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, s, pos // 16, n),
r AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY encode(s)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS h FROM r UNION ALL
SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
tower AS (SELECT 'in' || s AS tree, level, pos, n, h FROM t UNION ALL SELECT 'top', level, pos, n, h FROM u),
step AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS y
FROM tower a JOIN tower b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
walk AS (SELECT k, s, 'in' || s AS tree, 0 AS level, pos, n, seen AS h, '' AS proof FROM l UNION ALL
SELECT w.k, w.s, CASE WHEN w.n > 1 THEN w.tree ELSE 'top' END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // 16 ELSE r.pos END,
CASE WHEN w.n > 1 THEN (w.n + 15) // 16 ELSE r.n END, CASE WHEN w.n > 1 THEN sha256(x || w.h || y) ELSE w.h END, CASE WHEN w.n > 1 THEN w.proof || x || y ELSE w.proof END
FROM walk w JOIN r ON r.s = w.s LEFT JOIN step ON step.tree = w.tree AND step.level = w.level AND step.pos = w.pos WHERE w.n > 1 OR w.tree <> 'top'),
done AS (SELECT k, h, proof FROM walk WHERE n = 1 AND tree = 'top'),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root AS verified FROM l JOIN r ON r.s = l.s JOIN done ON done.k = l.k, top
""",
    "op12_url_filters": _template_sql(),
}
