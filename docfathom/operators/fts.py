"""Full-text search: an inverted index and BM25, for one query or a table of queries.

An index row has a term, a chunk, the places of the term there, and what ranking and filtering need of the chunk (its length, source and
type), so a search reads the postings of its terms and joins nothing else but the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitized, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows (query terms, results) that are broadcast, at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Terms that a filter of the index lists, at most.
PUSHED_TERMS = 500


def length() -> Column:
    """The number of terms of a chunk, from its columns title and content."""
    return sum(F.size(tokens(F.coalesce(c, F.lit("")))) for c in ("title", "content"))


def tokenised(chunks: DataFrame, *more: str) -> DataFrame:
    """id, api_id, type, title_toks, content_toks and dl (their number) of each chunk, and what more of its columns is named."""
    toks = chunks.select("id", "api_id", "type", *more, tokens(F.coalesce("title", F.lit(""))).alias("title_toks"), tokens(F.coalesce("content", F.lit(""))).alias("content_toks"))
    return toks.withColumn("dl", F.size("title_toks") + F.size("content_toks"))


def _runs(items: Column, term: Callable[[Column], Column], made: Callable[[Column, Column, Column], Column]) -> Column:
    """An array sorted by term, a run of one term at a time: made(items, place of the first from 0, number). Null if there is none."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731: x is made once, not for each element

    def cut(own: Column) -> Column:
        first = lambda i: (i == 0) | (term(F.get(own, i)) != term(F.get(own, i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), first)
        return bound(starts, lambda s: F.transform(s, lambda at, j: made(own, at, F.coalesce(F.get(s, j + 1), F.size(own)) - at)))

    return F.when(F.size(items) > 0, bound(F.sort_array(items), cut))


def terms_of_row() -> Column:
    """The terms of a tokenised chunk with their numbers: an array of (term, tf), grouped inside the row."""
    words = F.concat("title_toks", "content_toks")
    return _runs(words, lambda t: t, lambda own, at, n: F.struct(F.get(own, at).alias("term"), n.cast("int").alias("tf")))


def postings(toks: DataFrame, by_chunk: bool = False) -> DataFrame:
    """term, id, api_id, type, dl, tf, positions (column 0 is the title, 1 the content).

    by_chunk: terms are grouped inside the row, without a shuffle; for a whole index. Ids have to be keys then. Without it a filter on
    terms goes below the shuffle.
    """

    def places_of(name: str, col: int) -> Column:
        return F.transform(name, lambda term, pos: F.struct(term.alias("term"), F.lit(col).alias("col"), pos.alias("pos")))

    every = F.concat(places_of("title_toks", 0), places_of("content_toks", 1))
    if by_chunk:
        place = lambda x: F.struct(x["col"].alias("col"), x["pos"].alias("pos"))
        made = lambda own, at, n: F.struct(F.get(own, at)["term"].alias("term"), n.cast("int").alias("tf"), F.transform(F.slice(own, at + 1, n), place).alias("positions"))
        rows = toks.select("id", "api_id", "type", "dl", F.inline(_runs(every, lambda x: x["term"], made)))
        return rows.select("term", "id", "api_id", "type", "dl", "tf", "positions")
    both = toks.select("id", "api_id", "type", "dl", F.inline(every))
    places = F.sort_array(F.collect_list(F.struct("col", "pos")))
    return both.groupBy("term", "id", "api_id", "type", "dl").agg(F.count("*").cast("int").alias("tf"), places.alias("positions"))


def term_counts(toks: DataFrame) -> DataFrame:
    """term, id, dl, tf: postings without places."""
    words = toks.select("id", "api_id", "type", "dl", F.explode(F.concat("title_toks", "content_toks")).alias("term"))
    return words.groupBy("term", "id", "api_id", "type", "dl").agg(F.count("*").cast("int").alias("tf"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: n (chunks) and avgdl."""
    return toks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, phrase, offset, term, n_terms (of the phrase), n_phrases: words without letters or digits are left out."""
    words = queries.select("query_id", F.posexplode(sanitized(F.col("query"))).alias("phrase", "word"))
    terms = words.withColumn("terms", tokens(F.col("word"))).filter(F.size("terms") > 0)
    per = Window.partitionBy("query_id")
    terms = terms.withColumn("n_phrases", F.count("*").over(per))
    return terms.select("query_id", "phrase", "n_phrases", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))


def _as_filter(api_ids: Sequence[str] | None, types: Sequence[str] | None) -> Column:
    keep = F.lit(True)
    if api_ids:
        keep = keep & F.col("api_id").isin(*api_ids)
    if types:
        keep = keep & F.col("type").isin(*types)
    return keep


def held(df: DataFrame) -> tuple[DataFrame, list | None]:
    """A frame that is asked for several times, broadcast if it is small, and its rows then."""
    few = df.limit(BROADCAST_TERMS + 1).collect()
    if len(few) > BROADCAST_TERMS:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(few, df.schema)), few


def bm25_scores(queries: DataFrame, index: DataFrame, stats: DataFrame, api_ids: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """query_id, id, score of every chunk that holds all phrases of the query; a repeated phrase counts again.

    Corpus statistics do not depend on the filters. A phrase of several terms has to stand in one column without a gap.
    """
    terms, few = held(query_terms(queries))
    if few is not None:
        known = sorted({r["term"] for r in few})
        if len(known) <= PUSHED_TERMS:  # reaches the scan of a stored index, and goes below the grouping of one that is made on the way
            index = index.filter(F.col("term").isin(*known)) if known else index.limit(0)
    hits = index.join(terms, "term")
    keep = ["query_id", "phrase", "n_phrases", "id", "api_id", "type", "dl"]
    single = hits.filter("n_terms = 1").select(*keep, F.col("tf").cast("long").alias("tf"))
    spread = hits.filter("n_terms > 1").select(*keep, "n_terms", "offset", F.explode("positions").alias("p"))
    starts = spread.groupBy(*keep, "n_terms", F.col("p.col").alias("col"), (F.col("p.pos") - F.col("offset")).alias("at")).agg(F.count("*").alias("k"))
    several = starts.filter("k = n_terms").groupBy(*keep).agg(F.count("*").alias("tf"))
    tf = single.unionByName(several)
    df = tf.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = tf.filter(_as_filter(api_ids, types)).join(df, ["query_id", "phrase"]).crossJoin(F.broadcast(stats))
    scored = weighed.groupBy("query_id", "n_phrases", "id").agg(F.count("*").alias("hits"), F.sum(part).alias("score"))
    return scored.filter("hits = n_phrases").select("query_id", "id", "score")


def search(queries: DataFrame, index: DataFrame, stats: DataFrame, limit: int, api_ids: Sequence[str] | None = None, types: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, fts_rank: the best chunks of each query; scores are rounded before they are ranked, ties go by id."""
    scored = bm25_scores(queries, index, stats, api_ids, types).withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("fts_rank", F.row_number().over(order)).filter(F.col("fts_rank") <= limit)
