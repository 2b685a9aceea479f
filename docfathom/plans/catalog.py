"""Every operator as a query over a folder of tables, where documents stand for chunks (source: API, language: type)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blockmax, fts, hybrid, merge, pivots, vector

#: Query texts, and the vector ids whose embeddings are their query vectors.
QUERY, RARE, PHRASE = "und von", "ones", "of_the"
BATCH = [(0, "und von", 20), (1, "ones", 3), (2, "du", 7), (3, "anat", 11)]
LOOKUP = ("d3", "d5", "d8", "d999999")
#: The specification that stands for a supplier in openapi_chunks.
SPEC = """openapi: 3.0.3
info: {title: "{name}", version: "1.0", description: Nation {nation}.}
servers: [{url: https://api.example.com, description: main}, {url: https://test.example.com}]
paths:
  /suppliers/{key}/items:
    get:
      summary: List items
      operationId: listItems
      tags: [items]
      parameters: [{name: limit, in: query, schema: {type: integer}}]
      responses: {"200": {description: ok, content: {application/json: {schema: {type: array, items: {$ref: "#/components/schemas/Item"}}}}}}
    post:
      requestBody: {content: {application/json: {schema: {$ref: "#/components/schemas/Item"}}}}
      responses: {"201": {description: made}}
components:
  schemas:
    Item:
      type: object
      required: [id]
      properties: {id: {type: integer}, name: {type: string, description: Shown name}, tag: {type: string}}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that spark.checkpoint.dir tells; on a local master it may be unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        top = tempfile.mkdtemp(prefix="docfathom-tables-")
    return f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"


def _type() -> F.Column:
    lang = F.col("lang")
    return F.when(lang == "en", "guide").when(lang == "fr", "glossary").when(lang == "de", "use-case").otherwise("overview")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("api_id"), _type().alias("type"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("content")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of documents: vec_id is doc_id."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), "embedding")
    return e.join(chunks(spark, sf_dir).select("id"), "id", "left_semi")


def _vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def _index(spark: SparkSession, sf_dir: str, places: bool = False) -> tuple[DataFrame, DataFrame]:
    toks = fts.tokenised(chunks(spark, sf_dir))
    index = fts.postings(toks) if places else fts.term_counts(toks).withColumn("positions", F.lit(None).cast("array<struct<col:int,pos:int>>"))
    return index, fts.corpus_stats(toks)


def _asked(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


# --- scans and lookups
def list_sources(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_chunks")).orderBy("name")


def chunks_by_source(spark, d):
    return chunks(spark, d).filter("api_id = 'src3'").select("id", "type", F.length("content").cast("long").alias("size")).orderBy("id")


def chunks_by_source_type(spark, d):
    return chunks(spark, d).filter("api_id = 'src3' AND type = 'guide'").select("id", "type", F.length("content").cast("long").alias("size")).orderBy("id")


def chunk_by_id(spark, d):
    return chunks(spark, d).filter("id = 'd7'").limit(1)


def chunks_by_ids(spark, d):
    return chunks(spark, d).filter(F.col("id").isin(*LOOKUP)).select("id", "api_id", "type", "content")


# --- scalar functions
def content_hash(spark, d):
    return chunks(spark, d).select("id", T.content_hash(F.col("content")).alias("content_hash"))


def source_uuid5(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("name")).distinct().select("name", T.source_id(F.col("name")).alias("id"))


def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


def chunk_type_from_name(spark, d):
    name = F.concat(F.lit("/docs/"), F.when(F.col("lang") == "fr", "API-Glossary").when(F.col("lang") == "de", "my_use_case").when(F.col("lang") == "es", "Use-Cases").otherwise("guide-glossy"), F.lit("-"), F.col("doc_id"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", T.chunk_type(name).alias("type"), T.basename(name).alias("file"))


def trim_text(spark, d):
    padded = F.concat(F.lit("  \t"), F.coalesce("text", F.lit("")), F.lit(" \n﻿"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.trim(padded)).alias("trimmed"))


def hard_split(spark, d):
    parts = chunks(spark, d).select("id", F.posexplode(T.hard_split(F.col("content"), 3000)).alias("part", "content"))
    return parts.select("id", F.col("part").cast("long").alias("part"), F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))


def utf16_split(spark, d):
    """Texts with vowels from beyond U+FFFF: such a letter counts twice, and one that a cut meets is half in either piece."""
    parts = chunks(spark, d).select("id", F.posexplode(T.hard_split(F.translate("content", "aeo", "𝐚𝐞𝐨"), 101)).alias("part", "content"))
    return parts.select("id", F.col("part").cast("long").alias("part"), F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))


def utf16_pack(spark, d):
    """Greedy packing of those texts, by sentences."""
    parts = chunks(spark, d).select("id", F.posexplode(T.pack_paragraphs(F.translate("content", "aeo", "𝐚𝐞𝐨"), 400, ". ")).alias("part", "content"))
    return parts.select("id", F.col("part").cast("long").alias("part"), F.md5("content").alias("digest"), T.utf16_length(F.col("content")).cast("long").alias("units"))


def paragraph_pack(spark, d):
    parts = chunks(spark, d).select("id", F.posexplode(T.pack_paragraphs(F.col("content"), 3000, "\n")).alias("part", "content"))
    return parts.select("id", F.col("part").cast("long").alias("part"), F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))


def metadata_json_roundtrip(spark, d):
    e = table(spark, d, "events")
    parsed = e.select("event_id", "event_type", "props", F.from_json("props", "map<string,string>").alias("m"))
    return parsed.select("event_id", F.size(F.map_keys("m")).cast("long").alias("n_keys"), F.concat_ws(",", F.sort_array(F.map_keys("m"))).alias("keys"), F.concat_ws(",", F.transform(F.sort_array(F.map_keys("m")), lambda k: F.element_at("m", k))).alias("vals"))


# --- full-text index
def tokenize_counts(spark, d):
    return fts.tokenised(chunks(spark, d)).select("id", F.col("dl").cast("long").alias("n_tokens"))


def postings(spark, d):
    index = fts.postings(fts.tokenised(chunks(spark, d)), by_chunk=True)
    return index.select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("positions")[0]["pos"].cast("long").alias("first_pos"))


def doc_freq(spark, d):
    return fts.document_frequency(fts.term_counts(fts.tokenised(chunks(spark, d))))


def corpus_stats(spark, d):
    s = fts.corpus_stats(fts.tokenised(chunks(spark, d)))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def _lexical(spark, d, text, sources=None, types=None, places=False):
    index, stats = _index(spark, d, places)
    found = fts.search(_asked(spark, text), index, stats, 60, sources, types)
    return found.select("id", "score", F.col("fts_rank").cast("long").alias("fts_rank"))


def bm25_topk(spark, d):
    return _lexical(spark, d, QUERY)


def bm25_rare(spark, d):
    return _lexical(spark, d, RARE)


def bm25_filtered(spark, d):
    return _lexical(spark, d, QUERY, ["src0", "src3", "src5"], ["use-case", "guide"])


def bm25_phrase(spark, d):
    return _lexical(spark, d, PHRASE, places=True)


def bm25_repeated_term(spark, d):
    return _lexical(spark, d, "ones the ones")


def _written(spark, df):
    """A table in the shared folder of the cluster, read again."""
    place = shared_folder(spark)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def _blocks(spark, d, text, sources=None, types=None, k=60):
    own = chunks(spark, d)
    stored = _written(spark, blockmax.build(fts.tokenised(blockmax.placed(own), "block")))
    found = blockmax.search(_asked(spark, text), stored, fts.corpus_stats(fts.tokenised(own)), k, sources, types)
    return found.select("id", "score", F.col("fts_rank").cast("long").alias("fts_rank"))


def bm25_blocks(spark, d):
    """bm25_topk by blocks with bounds; the ten best."""
    return _blocks(spark, d, QUERY, k=10)


def bm25_blocks_filtered(spark, d):
    return _blocks(spark, d, QUERY, ["src0", "src3", "src5"], ["use-case", "guide"])


# --- vectors
def _near(found):
    return found.select("id", "distance", F.col("vec_rank").cast("long").alias("vec_rank"))


def knn_topk(spark, d):
    return _near(vector.search(vectors(spark, d), _vector_of(spark, d, 0), 60))


def knn_pivots(spark, d):
    """The ten nearest to an embedding by distances to pivots."""
    own = vectors(spark, d)
    chosen, query = pivots.choose(own), _vector_of(spark, d, 20)
    order = Window.orderBy("distance", "id")  # of ten rows
    return _near(pivots.nearest(_written(spark, pivots.build(own, chosen)), chosen, query, 10).withColumn("vec_rank", F.row_number().over(order)))


def knn_post_filter(spark, d):
    kept = chunks(spark, d).filter("type = 'use-case'")
    return _near(vector.search(vectors(spark, d), _vector_of(spark, d, 0), 60, kept, "post"))


def knn_pre_filter(spark, d):
    kept = chunks(spark, d).filter("type = 'use-case'")
    return _near(vector.search(vectors(spark, d), _vector_of(spark, d, 0), 60, kept, "pre"))


# --- fusion
def _fused(found):
    return found.select(F.col("query_id"), "id", F.round("score", 9).alias("score"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("fts_rank", "vec_rank", "position")])


def _hybrid(spark, d, text, vec_id, options=hybrid.SearchOptions()):
    index, stats = _index(spark, d)
    return hybrid.search(text, _vector_of(spark, d, vec_id), chunks(spark, d), vectors(spark, d), index, stats, options)


def rrf_hybrid(spark, d):
    return _fused(_hybrid(spark, d, QUERY, 20))


def rrf_hybrid_filtered(spark, d):
    return _fused(_hybrid(spark, d, QUERY, 20, hybrid.SearchOptions(types=["use-case"])))


def rrf_batch(spark, d):
    index, stats = _index(spark, d)
    known = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    asked = spark.createDataFrame(BATCH, "query_id long, query string, vec_id long")
    queries = known.join(F.broadcast(asked), "vec_id").select("query_id", "query", "vector")
    return _fused(hybrid.search_batch(queries, vectors(spark, d), index, stats))


# --- merging: labelled documents are stored, those of quality 0 with an old text; benchmark items are stored but gone
def _stored(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    old = F.when(F.col("quality") == 1, F.coalesce("text", F.lit(""))).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" (old)")))
    one = lab.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("api_id"), T.content_hash(old).alias("content_hash"), F.lit("2020-01-01 00:00:00").alias("created_at"))
    gone = table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit("bench").alias("api_id"), T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.lit("2020-01-01 00:00:00").alias("created_at"))
    return one.unionByName(gone)


def _parsed(spark, d):
    return chunks(spark, d).select("id", "api_id", T.content_hash(F.col("content")).alias("content_hash"), F.lit("2024-01-01 00:00:00").alias("created_at"))


def cdc_classify(spark, d):
    return merge.classify(_parsed(spark, d), _stored(spark, d))


def cdc_counts(spark, d):
    return cdc_classify(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def orphans(spark, d):
    return merge.orphans(_parsed(spark, d), _stored(spark, d)).select("id", "content_hash")


def merge_upsert(spark, d):
    return merge.upsert(_stored(spark, d), _parsed(spark, d), keep=("created_at", "api_id"))


def delete_by_source(spark, d):
    return _stored(spark, d).filter("api_id != 'src3'").select("id", "api_id")


def duplicate_names(spark, d):
    names = table(spark, d, "documents").select(T.slugify(F.coalesce("text", F.lit(""))).alias("name"))
    return merge.duplicates(names)


def last_of_each(spark, d):
    rows = table(spark, d, "documents").select(T.slugify(F.coalesce("source", F.lit(""))).alias("id"), F.col("doc_id").alias("seq"))
    return merge.last_of_each(rows)


# --- listings as text
def api_list_markdown(spark, d):
    from ..sources.format import api_list

    names = table(spark, d, "documents").select(F.col("source").alias("name"), F.lit(None).cast("string").alias("version")).distinct()
    return api_list(names)


def endpoint_listing(spark, d):
    from ..sources.format import endpoint_lines

    pages = table(spark, d, "pages").select(F.col("page_id"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"), F.lit("get").alias("method"), F.col("url").alias("title"))
    return pages.select("page_id", endpoint_lines(F.col("method"), F.col("path"), F.col("title")).alias("line"))


def search_markdown(spark, d):
    from ..sources.format import result_sections

    found = hybrid.hydrate(_hybrid(spark, d, RARE, 3), chunks(spark, d))
    names = table(spark, d, "documents").select(F.col("source").alias("api_id"), F.concat(F.lit("API "), F.col("source")).alias("name")).distinct()
    return found.join(fts.held(names)[0], "api_id", "left").select(F.col("position").cast("long").alias("position"), result_sections().alias("section"))


def sanitised_query(spark, d):
    """Every URL as a full-text query: without the signs that queries may not hold."""
    return table(spark, d, "pages").select("page_id", F.array_join(T.sanitized(F.coalesce("url", F.lit(""))), " ").alias("query"))


def openapi_chunks(spark, d):
    """A specification for each supplier, through the parser on the executors."""
    from ..sources.openapi import split_frame

    text = F.lit(SPEC)
    for sign, column in (("{name}", "s_name"), ("{nation}", "s_nationkey"), ("{key}", "s_suppkey")):
        text = F.replace(text, F.lit(sign), F.col(column).cast("string"))
    specs = table(spark, d, "supplier").select(F.concat(F.lit("/specs/"), "s_suppkey", F.lit(".yaml")).alias("path"), text.alias("content"), F.concat(F.lit("supplier-"), "s_suppkey").alias("api_id"))
    return split_frame(specs).select("id", "api_id", "type", "title", "content", "content_hash", "metadata", "seq")


def markdown_chunks(spark, d):
    """Documents as markdown: a heading per line end, through the markdown splitter on the executors."""
    from ..sources.markdown import split_frame

    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n## Section\n\n")
    files = table(spark, d, "documents").select(F.concat(F.lit("/docs/doc-"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), body).alias("content"), F.col("source").alias("api_id"))
    return split_frame(files).select("id", "type", "title", "content_hash", "seq")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        list_sources, chunks_by_source, chunks_by_source_type, chunk_by_id, chunks_by_ids, content_hash, source_uuid5, slugify, chunk_type_from_name, trim_text, hard_split, paragraph_pack, utf16_split, utf16_pack,
        metadata_json_roundtrip, tokenize_counts, postings, doc_freq, corpus_stats, bm25_topk, bm25_rare, bm25_filtered, bm25_phrase, bm25_repeated_term, bm25_blocks, bm25_blocks_filtered, knn_topk, knn_pivots, knn_post_filter, knn_pre_filter,
        rrf_hybrid, rrf_hybrid_filtered, rrf_batch, cdc_classify, cdc_counts, orphans, merge_upsert, delete_by_source, duplicate_names, last_of_each, api_list_markdown, endpoint_listing, search_markdown,
        sanitised_query, openapi_chunks, markdown_chunks,
    )
}
