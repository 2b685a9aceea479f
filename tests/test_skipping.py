"""Searches that skip: blocks of postings with bounds, and pivots, against the searches that read everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.operators import blockmax, fts, pivots, vector

CHUNKS = "id string, api_id string, type string, title string, content string"
QUERIES = ["common", "common often", "rare", "common common often", "missing common", "?", "often rare", "common often rare", "seldom", "seldom often w3"]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = ["common"] * int(rng.geometric(0.4)) + ["often"] * int(rng.integers(0, 3)) + ["rare"] * int(rng.random() < 0.01) + ["seldom"] * int(rng.random() < 0.4) * int(rng.geometric(0.3))
        words += [f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 60))]
        rows.append((f"k{i:05d}", f"s{i % 7}" if i % 3 else "s0", "guide" if rng.random() < 0.2 else "overview", "", " ".join(rng.permutation(words))))
    return rows + [("empty", "s0", "guide", "", ""), ("null", "s0", "guide", None, None)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    toks = fts.tokenised(spark.createDataFrame(corpus(4000), CHUNKS)).cache()
    place = str(tmp_path_factory.mktemp("blocks") / "b")
    blockmax.build(toks, 32).write.parquet(place)
    yield fts.postings(toks), fts.corpus_stats(toks), spark.read.parquet(place)
    toks.unpersist()


def asked(spark, queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def told(df):
    return sorted((r.query_id, r.fts_rank, r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("sources, types", [(None, None), (["s0", "s3"], None), (["s3"], ["guide"]), (["nowhere"], None)])
def test_blocks_give_what_a_search_gives(spark, made, sources, types):
    index, stats, blocks = made
    q = asked(spark, QUERIES)
    assert told(blockmax.search(q, blocks, stats, 10, sources, types)) == told(fts.search(q, index, stats, 10, sources, types))


def test_more_than_there_are(spark, made):
    index, stats, blocks = made
    q = asked(spark, ["rare"])
    assert told(blockmax.search(q, blocks, stats, 5000)) == told(fts.search(q, index, stats, 5000))


def test_most_blocks_of_a_common_term_are_not_decoded(spark, made):
    _, stats, blocks = made
    every = blocks.filter("term = 'common'").count()
    assert every >= 4000 // 32
    tied = blockmax.Search(asked(spark, ["common"]), blocks, stats, 10)  # a term of all chunks: all scores are about 0.000001, ids decide
    assert tied.reached().count() < every / 4
    often = blockmax.Search(asked(spark, ["seldom"]), blocks, stats, 10)
    assert often.reached().count() <= 12 < often.bounds().count() / 8
    two = blockmax.Search(asked(spark, ["common rare"]), blocks, stats, 10)
    assert two.bounds().count() < every / 2  # blocks without the rarer term


def test_bounds_hold_when_statistics_change(spark, made):
    index, _, blocks = made
    other = spark.createDataFrame([(1_000_000, 3.5)], "n long, avgdl double")
    q = asked(spark, QUERIES)
    assert told(blockmax.search(q, blocks, other, 7)) == told(fts.search(q, index, other, 7))


def test_blocks_are_bounded_and_hold_each_posting_once(made):
    index, _, blocks = made
    assert blocks.agg(F.max("n")).first()[0] <= 32
    mine = blocks.select("term", F.inline("postings")).select("term", "id", "tf", "dl")
    want = index.select("term", "id", "tf", "dl")
    assert not mine.exceptAll(want).count() and not want.exceptAll(mine).count()


def test_phrases_are_refused_and_nothing_comes_of_nothing(spark, made):
    _, stats, blocks = made
    with pytest.raises(ValueError, match="phrase"):
        blockmax.search(asked(spark, ["of_the"]), blocks, stats, 5)
    assert not blockmax.search(asked(spark, ["?"]), blocks, stats, 5).count()
    assert not blockmax.search(asked(spark, ["common"]), blocks.limit(0), stats, 5).count()


def test_postings_inside_the_row(spark):
    toks = fts.tokenised(spark.createDataFrame([(*r[:3], "w1 common Title", r[4]) for r in corpus(200, 1)], CHUNKS))
    names = ["term", "id", "api_id", "type", "dl", "tf", "positions"]
    every = lambda by: sorted(map(repr, fts.postings(toks, by).select(names).collect()))
    assert every(True) == every(False)
    assert "Exchange" not in fts.postings(toks, by_chunk=True)._jdf.queryExecution().executedPlan().toString()


def clusters(n, at, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(at, 16)) * 10
    x = (centres[rng.integers(0, at, n)] + rng.normal(size=(n, 16))).astype(np.float32)
    x[5] = x[6] = x[7]  # ties
    return [(f"v{i:05d}", [float(c) for c in r]) for i, r in enumerate(x)] + [("none", None)]


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    rows = clusters(5000, 20)
    frame = spark.createDataFrame(rows, "id string, embedding array<float>").cache()
    chosen = pivots.choose(frame)
    place = str(tmp_path_factory.mktemp("pivots") / "p")
    pivots.build(frame, chosen).write.parquet(place)
    yield rows, frame, chosen, spark.read.parquet(place)
    frame.unpersist()


@pytest.mark.parametrize("i", [7, 100, 4321])
def test_pivots_give_the_nearest(filed, i):
    rows, frame, chosen, table = filed
    query = [c + 0.25 for c in rows[i][1]] if i == 100 else rows[i][1]
    assert pivots.nearest(table, chosen, query, 10).collect() == vector.nearest(frame, query, 10).collect()
    assert pivots.reached(table, chosen, query, 10).count() < 5000 / 8


def test_pivots_filter_the_scan(spark, filed):
    rows, _, chosen, table = filed
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = pivots.reached(table, chosen, rows[3][1], 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(pivot_0" in pushed and len(chosen) == pivots.PIVOTS


def test_pivots_of_few_rows(spark, filed, tmp_path):
    rows, frame, chosen, table = filed
    assert pivots.nearest(table, chosen, rows[0][1], 6000).collect() == vector.nearest(frame, rows[0][1], 6000).collect()
    nothing = frame.limit(0)
    assert pivots.choose(nothing) == [] and not pivots.nearest(pivots.build(nothing, []), [], rows[0][1], 3).count()
    same = spark.createDataFrame([(f"e{i}", [1.0, 2.0]) for i in range(6)], "id string, embedding array<float>")
    pivots.build(same, pivots.choose(same)).write.parquet(f"{tmp_path}/same")
    got = pivots.nearest(spark.read.parquet(f"{tmp_path}/same"), pivots.choose(same), [1.0, 2.5], 3).collect()
    assert [tuple(r) for r in got] == [("e0", 0.5), ("e1", 0.5), ("e2", 0.5)]


def test_an_index_is_shuffled_once(spark):
    chunks = spark.createDataFrame(corpus(50), CHUNKS)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(blockmax.build(fts.tokenised(chunks), 32)) == 1
    whole = blockmax.build(fts.tokenised(blockmax.placed(chunks, 32), "block"), 32)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert "regexp_extract_all" not in plan[plan.index("Exchange ") :]  # texts move, not their terms


def bare(b):
    key = lambda x: (x is None, x)
    return b["term"], b["n"], b["first_id"], sorted(b["apis"]), sorted(b["types"]), sorted((x["tf"], x["dl"]) for x in b["impacts"]), sorted(((p["id"], p["api_id"], p["type"], p["tf"], p["dl"]) for p in b["postings"]), key=lambda p: list(map(key, p)))


def groups_of(rows):
    """The groups of (block, id, api_id, type, words), the plain way."""
    out = {}
    for block, ident, api, kind, words in rows:
        for t in set(words):
            out.setdefault((t, block), []).append((ident, api, kind, words.count(t), len(words)))
    told = []
    for (t, _), posts in sorted(out.items(), key=lambda x: (x[0][0].encode(), x[0][1])):
        pairs = {p[3:] for p in posts}
        best = [p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)]
        some = lambda c, of=posts: sorted({p[c] for p in of} - {None})
        told.append(bare({"term": t, "n": len(posts), "first_id": min(p[0] for p in posts), "apis": some(1), "types": some(2), "impacts": [{"tf": a, "dl": b} for a, b in best], "postings": [dict(zip(("id", "api_id", "type", "tf", "dl"), p, strict=True)) for p in posts]}))
    return told


@pytest.mark.parametrize("at_once", [1, 500, 1 << 20])
@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_groups_of_blocks(monkeypatch, at_once, batch):
    import pyarrow as pa

    monkeypatch.setattr(blockmax, "WORDS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows = [(i // 20 + 5, f"k{999 - i * 7 % 101}{i}", None if i % 9 == 4 else f"s{i % 3}", None if i > 90 else f"t{i % 2}", [f"ö{x}" if x % 2 else f"w{x}" for x in rng.geometric(0.15, int(rng.integers(0, 40)) * (i % 5 > 0))]) for i in range(110)]
    rows += [(99, "empty", "s0", "t0", [])]
    schema = pa.schema([("block", pa.int64()), ("id", pa.string()), ("api_id", pa.string()), ("type", pa.string()), ("dl", pa.int32()), ("words", pa.list_(pa.string()))])
    parts = [rows[i : i + batch] for i in range(0, len(rows), batch)]
    got = list(blockmax._groups(pa.RecordBatch.from_pylist([{"block": r[0], "id": r[1], "api_id": r[2], "type": r[3], "dl": len(r[4]), "words": r[4]} for r in p], schema) for p in parts))
    blocks = len({r[0] for r in rows})
    assert len(got) == blocks if at_once == 1 else len(got) <= blocks
    told = sorted((g for b in got for g in b.to_pylist()), key=lambda g: (g["term"].encode(), g["block"]))
    assert [bare(g) for g in told] == groups_of(rows)
    assert not list(blockmax._groups([]))
