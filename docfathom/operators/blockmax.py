"""BM25's best chunks by blocks of postings that tell the best they can give: blocks that cannot reach the k-th score are not decoded.

Chunks are dealt to blocks in the order of source and id, the same blocks for all terms. A row holds what a term has in a block: its
postings, and apart from them what bounds their scores (for each number of occurrences the shortest chunk with it, so the bound is exact
whatever the statistics are by then). A search reads the bounds of its terms, decodes the most promising blocks for a score that the k-th
reaches at least, and then only the blocks that may reach it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fts

#: Chunks of a block.
SIZE = 128
#: Blocks that a filter lists, at most; more are joined.
PUSHED_BLOCKS = 500
#: Words that are grouped at once, about; a block is not divided.
WORDS_AT_ONCE = 1 << 18
#: Sums depend on their order: bounds are raised by this before they are rounded as scores are.
SLACK = 1e-9


def placed(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks (any columns beside api_id and id) in the order of source and id, with the number of their block. A block lies in one partition.

    This is the only shuffle of an index: texts are best placed before they are tokenised.
    """
    n = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks.repartitionByRange(n, "api_id", "id").sortWithinPartitions("api_id", "id").withColumn("block", F.expr(f"monotonically_increasing_id() div {size}"))


def build(toks: DataFrame, size: int = SIZE) -> DataFrame:
    """term, block, n, first_id, impacts (tf, dl), apis, types, postings (id, api_id, type, tf, dl) of tokenised chunks; ids are keys.

    To be written before it is searched. Chunks that are not placed yet are placed. A group has at most `size` chunks, however common its
    term is, and is made where its block lies; a partition's groups are in the order of term and block, so a filter on terms skips
    most of each file. Chunks without terms have no postings.
    """
    if "block" not in toks.columns:
        toks = placed(toks, size)
    rows = toks.select("block", "id", "api_id", "type", "dl", F.concat("title_toks", "content_toks").alias("words"))
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    post = "struct<" + ",".join(f"{c}:{of.get(c, 'int')}" for c in ("id", "api_id", "type", "tf", "dl")) + ">"
    out = f"term string, block bigint, n int, first_id {of['id']}, impacts array<struct<tf:int,dl:int>>, apis array<{of['api_id']}>, types array<{of['type']}>, postings array<{post}>"
    return rows.mapInArrow(_groups, out).sortWithinPartitions("term", "block")


def _groups(batches):
    """The groups of a partition whose chunks come in the order of blocks; some whole blocks at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []  # the block that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        blocks = rows.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()]
        words = np.concatenate(([0], np.cumsum(rows.column("words").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))))
        begin = 0
        for i, cut in enumerate(cuts[1:], 2):
            if i == len(cuts) or words[cuts[i]] - words[begin] > WORDS_AT_ONCE:
                yield _group(rows.slice(begin, cut - begin))
                begin = cut
        held = rows.take(np.arange(begin, len(rows))).to_batches()  # a copy: the rest goes
        del batch, rows
        pa.default_memory_pool().release_unused()
    if held:
        yield _group(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()


def _group(rows):
    """The groups of some blocks, as a batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.combine_chunks()
    block, dl = (rows.column(c).to_numpy() for c in ("block", "dl"))
    own = {c: rows.column(c).combine_chunks() for c in ("id", "api_id", "type", "words")}
    words = own["words"].flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    chunk = np.repeat(np.arange(len(rows)), own["words"].value_lengths().to_numpy(zero_copy_only=False))
    key, tf = np.unique(rank[words.indices.to_numpy()] * len(rows) + chunk, return_counts=True)  # by term, then by chunk, so by block
    term, chunk = np.divmod(key, max(len(rows), 1))
    dl, tf = dl[chunk].astype(np.int32), tf.astype(np.int32)
    start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block[chunk], prepend=-1) != 0))
    group = np.repeat(np.arange(len(start)), np.diff(start, append=len(term)))
    lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(start) + 1)).astype(np.int32)), values)

    by_id = pc.sort_indices(own["id"]).to_numpy()
    place = np.empty(len(rows), np.int64)
    place[by_id] = np.arange(len(rows))
    first = by_id[np.minimum.reduceat(place[chunk], start)] if len(start) else start

    # of the chunks with so many occurrences or more, only those shorter than all with more
    best = np.lexsort((dl, -tf, group))
    span = int(dl.max(initial=0)) + 1
    shortest = np.minimum.accumulate(dl[best] - group[best] * span)  # each group starts below the one before it
    best = best[np.diff(shortest, prepend=1 + span) < 0]
    impacts = lists(group[best], pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(dl[best])], ["tf", "dl"]))

    def names(column: str):
        """The values that a group's chunks have, each once."""
        codes = own[column].dictionary_encode()
        code = codes.indices.fill_null(-1).to_numpy()[chunk]
        n = len(codes.dictionary)
        of, code = np.divmod(np.unique((group * n + code)[code >= 0]), max(n, 1))
        return lists(of, codes.dictionary.take(pa.array(code)))

    at = pa.array(chunk)
    posts = pa.StructArray.from_arrays([*(own[c].take(at) for c in ("id", "api_id", "type")), pa.array(tf), pa.array(dl)], ["id", "api_id", "type", "tf", "dl"])
    columns = {
        "term": words.dictionary.take(pa.array(order[term[start]])), "block": pa.array(block[chunk[start]]), "n": pa.array(np.diff(start, append=len(term)).astype(np.int32)),
        "first_id": own["id"].take(pa.array(first)), "impacts": impacts, "apis": names("api_id"), "types": names("type"), "postings": lists(group, posts),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _saturation(tf: Column, dl: Column) -> Column:
    return tf / (tf + fts.K1 * (1 - fts.B + fts.B * dl / F.col("avgdl")))


class Search:
    """A table of queries (query_id, query) over written blocks; every phrase of a query has to be one term."""

    def __init__(self, queries: DataFrame, blocks: DataFrame, stats: DataFrame, limit: int, api_ids: Sequence[str] | None = None, types: Sequence[str] | None = None, digits: int = 6):
        self.limit, self.api_ids, self.types, self.digits = limit, api_ids, types, digits
        terms = fts.query_terms(queries)
        if terms.filter("n_terms > 1").limit(1).count():
            raise ValueError("the blocks do not tell how many chunks hold a phrase of several terms: use fts.search")
        asked, few = fts.held(terms.groupBy("query_id", "term").agg(F.count("*").alias("times")))
        if few is not None and len(known := sorted({r["term"] for r in few})) <= fts.PUSHED_TERMS:
            blocks = blocks.filter(F.col("term").isin(*known)) if known else blocks.limit(0)
        self.blocks = blocks
        df = blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(fts.LEAST_IDF))
        weights = asked.join(df, "term", "left").crossJoin(F.broadcast(stats))
        weights = weights.select("query_id", "term", (F.col("times") * idf * (fts.K1 + 1)).alias("weight"), "avgdl", F.count("*").over(Window.partitionBy("query_id")).alias("n_asked"))
        self.weights, _ = fts.held(weights)

    def bounds(self) -> DataFrame:
        """query_id, block, bound, first_id: the blocks that hold all terms of a query, what no rounded score in them exceeds, and an id that
        none is before. Reads no postings."""
        heads = self.blocks.select("term", "block", "first_id", "impacts", "apis", "types").join(self.weights, "term")
        for column, wanted in (("apis", self.api_ids), ("types", self.types)):
            if wanted:
                heads = heads.filter(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
        best = F.array_max(F.transform("impacts", lambda x: F.col("weight") * _saturation(x["tf"], x["dl"])))
        found = heads.groupBy("query_id", "block", "n_asked").agg(F.count("*").alias("held"), F.round(F.sum(best) + SLACK, self.digits).alias("bound"), F.max("first_id").alias("first_id"))
        return found.filter("held = n_asked").select("query_id", "block", "bound", "first_id")

    def _scores(self, chosen: DataFrame) -> DataFrame:
        """query_id, id, score of the chunks of some blocks (query_id, block)."""
        rows, few = self.blocks.select("term", "block", "postings"), chosen.limit(PUSHED_BLOCKS + 1).collect()
        if len(few) <= PUSHED_BLOCKS:
            chosen = F.broadcast(chosen.sparkSession.createDataFrame(few, chosen.schema))
            rows = rows.filter(F.col("block").isin(*sorted({r["block"] for r in few}))) if few else rows.limit(0)
        rows = rows.join(self.weights, "term").join(chosen, ["query_id", "block"])
        rows = rows.select("query_id", "weight", "avgdl", "n_asked", F.inline("postings")).filter(fts._as_filter(self.api_ids, self.types))
        part = F.col("weight") * _saturation(F.col("tf"), F.col("dl"))
        found = rows.groupBy("query_id", "id", "n_asked").agg(F.count("*").alias("held"), F.round(F.sum(part), self.digits).alias("score"))
        return found.filter("held = n_asked").select("query_id", "id", "score")

    def _best(self, scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scores.withColumn("fts_rank", F.row_number().over(order)).filter(F.col("fts_rank") <= self.limit)

    def reached(self) -> DataFrame:
        """query_id, block: the blocks that may hold one of the best. Where the most promising blocks hold fewer than `limit` that pass the
        filters, these are all blocks with all terms."""
        bounds = self.bounds()
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "first_id", "block")
        first = bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= self.limit).select("query_id", "block")
        least = self._best(self._scores(first)).filter(F.col("fts_rank") == self.limit).select("query_id", F.col("score").alias("least"), F.col("id").alias("last_id"))
        least, _ = fts.held(least)
        may = F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col("first_id") <= F.col("last_id")))
        return bounds.join(least, "query_id", "left").filter(may).select("query_id", "block")

    def best(self) -> DataFrame:
        """query_id, id, score, fts_rank, as fts.search gives them."""
        return self._best(self._scores(self.reached()))


def search(queries: DataFrame, blocks: DataFrame, stats: DataFrame, limit: int, api_ids: Sequence[str] | None = None, types: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, fts_rank: the best chunks of each query; scores are rounded before they are ranked, ties go by id."""
    return Search(queries, blocks, stats, limit, api_ids, types, digits).best()
