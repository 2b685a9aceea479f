"""Benchmark decontamination with DataFrame functions only.

A document's windows are as long as a benchmark item. A window that is similar to an item holds at least a known number of places with
shingles of items of that length; a text's places that hold any are gathered, and every start with so many places in its window is
looked at. Each such window gets a 64-bit SimHash. Eight blocks of eight bits, each probed within two bits, find every item within 23
bits for certain (24 differing bits or more are needed to put three into every block). Candidates are then compared exactly, by the
weighted Jaccard similarity of their shingles (weight: how often the shingle occurs).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BITS, BLOCKS, RADIUS = 64, 8, 23
#: Rows that are broadcast, at most (none over 100 bytes: 50 MB); more are joined by a shuffle, shingles with SALTS parts for each key.
BROADCAST_ROWS, SALTS = 500_000, 16


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.col(array)[at + i] for i in range(size)])


def _shingles(df: DataFrame, array: str, size: int, *keep: str) -> DataFrame:
    """keep, at, h: each shingle of the array, with its place."""
    rows = df.filter(F.size(array) >= size).select(*keep, array, F.explode(F.sequence(F.lit(0), F.size(array) - size)).alias("at"))
    return rows.withColumn("h", _shingle(array, F.col("at"), size))


def _bags(df: DataFrame, array: str, size: int, key: str) -> DataFrame:
    return _shingles(df, array, size, key).groupBy(key, "h").agg(F.count("*").alias("weight"))


def simhash(bags: DataFrame, key: str) -> DataFrame:
    """(key, mass, fp): total weight and 64-bit SimHash of each bag (key, h, weight); masses stay under 2^31.

    A sum holds the counts of two bits in lanes of 32 bits, so 32 sums count all bits.
    """
    lanes = [F.expr(f"sum(weight * (((h >> {b}) & 1) | (((h >> {b + 1}) & 1) << 32)))") for b in range(0, BITS, 2)]
    sums = bags.groupBy(key).agg(F.sum("weight").alias("mass"), *[x.alias(f"s{i}") for i, x in enumerate(lanes)])
    sums = sums.select(key, "mass", F.array(*[f"s{i}" for i in range(len(lanes))]).alias("s"))
    bit = "((s[b div 2] >>> ((b % 2) * 32)) & 4294967295) * 2 > mass"
    return sums.select(key, "mass", F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (fp, b) -> fp | if({bit}, 1L << b, 0L))").alias("fp"))


def _block(fp: Column, i: Column) -> Column:
    return F.expr(f"cast(shiftright(fp, cast(block * {BITS // BLOCKS} as int)) & {2 ** (BITS // BLOCKS) - 1} as int)")


def _masks() -> list[int]:
    width, reach = BITS // BLOCKS, RADIUS // BLOCKS
    return [sum(1 << b for b in some) for n in range(reach + 1) for some in combinations(range(width), n)]


def _runs(size: int, similarity: float) -> Column:
    """Runs of starts (a to b) whose windows hold enough of the places at, ascending, for a similar item of n words in a text of len.

    common / (ours + theirs - common) >= similarity asks for common >= similarity * (ours + theirs) / (1 + similarity), and every common
    shingle stands at one of the places. The j-th run holds the starts for which places j to j + need - 1 are the first in the window.
    """
    ours = f"(least(n, len) - {size - 1})"
    need = f"cast(greatest(1, ceil({similarity}D * ({ours} + n - {size - 1}) / {1 + similarity}D - 1e-9D)) as int)"
    run = f"struct(greatest(0, at[j + {need} - 1] - {ours} + 1, coalesce(get(at, j - 1) + 1, 0)) as a, least(at[j], greatest(0, len - n)) as b)"
    return F.expr(f"if(size(at) < {need}, null, filter(transform(sequence(0, size(at) - {need}), j -> {run}), r -> r.a <= r.b))")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Windows of texts that are like benchmark items: (id_col, item, start, similarity), in words of letters and digits, lower-cased.

    A window has the item's number of words (a shorter text is one window) and may start at any word, so an item that a text holds whole is
    found at its place and at some places beside it. Items of fewer than size words and null items take no part; a null or short text has
    no window; a null id is an id; equal rows give equal windows once; other columns are not read. A window of similarity 0.8 differs from
    its item in 10 of 64 bits on average; more than 23 have a probability of about 1e-5.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("iw")).filter(F.size("iw") >= size)
    items = shared.stage(items.withColumn("n", F.size("iw")).withColumn("key", F.monotonically_increasing_id()), "items")
    seeds = shared.stage(_shingles(items, "iw", size, "n").select("h", "n").distinct(), "seeds")
    small = seeds.count() <= BROADCAST_ROWS

    # a row is known by 128 bits of its id and text; texts without enough places are not looked at again
    id_, text = F.col(id_col).alias("id"), F.col(text_col).alias("text")
    own = [F.xxhash64(F.lit(i), F.col(id_col), F.col(text_col)).alias(f"k{i}") for i in (1, 2)]
    hits = _shingles(docs.select(*own, words(F.col(text_col)).alias("w")).withColumn("len", F.size("w")), "w", size, "k1", "k2", "len").drop("w")
    if small:
        hits = hits.join(F.broadcast(seeds), "h")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("k1", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    places = hits.groupBy("k1", "k2", "len", "n").agg(F.sort_array(F.collect_set("at")).alias("at"))
    places = shared.stage(places.select("k1", "k2", "n", _runs(size, similarity).alias("runs")).filter("size(runs) > 0"), "places")
    keys = places.select("k1", "k2").distinct()
    some = docs.select(id_, text, *own).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["k1", "k2"], "left_semi")
    some = some.dropDuplicates(["k1", "k2"]).select("k1", "k2", "id", words(F.col("text")).alias("w"))
    windows = some.join(places, ["k1", "k2"]).select("id", "n", "w", F.explode("runs").alias("r"))
    windows = windows.select("id", "n", "w", F.explode(F.sequence("r.a", "r.b")).alias("start"))
    windows = windows.select("id", "n", "start", F.expr("slice(w, start + 1, n)").alias("w"), F.monotonically_increasing_id().alias("key"))
    windows = shared.stage(windows, "windows")

    near = _bags(windows, "w", size, "key")
    near = shared.stage(near, "bags")
    ours = simhash(near, "key").join(windows.select("key", "n"), "key")
    bags = shared.stage(_bags(items, "iw", size, "key"), "bags")
    theirs = simhash(bags, "key").join(items.select("key", "n"), "key").select(F.col("key").alias("ikey"), "n", F.col("mass").alias("imass"), "fp")

    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    probes = theirs.select("*", blocks).withColumn("mask", F.explode(F.array(*map(F.lit, _masks()))))
    probes = probes.withColumn("value", _block(F.col("fp"), F.col("block")).bitwiseXOR(F.col("mask"))).select("n", "block", "value", "ikey", "imass", F.col("fp").alias("ifp"))
    probes = shared.stage(probes, "probes")
    ours = ours.select("*", blocks).withColumn("value", _block(F.col("fp"), F.col("block")))
    found = ours.join(F.broadcast(probes) if probes.count() <= BROADCAST_ROWS else probes, ["n", "block", "value"])
    found = found.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("key", "ikey", "mass", "imass").distinct()

    both = found.join(near, "key").join(bags.select(F.col("key").alias("ikey"), "h", F.col("weight").alias("iweight")), ["ikey", "h"])
    shared_mass = both.groupBy("key", "ikey", "mass", "imass").agg(F.sum(F.least("weight", "iweight")).alias("common"))
    alike = shared_mass.withColumn("similarity", F.col("common") / (F.col("mass") + F.col("imass") - F.col("common"))).filter(F.col("similarity") >= similarity)
    out = alike.join(windows.select("key", "id", "start"), "key").join(items.select(F.col("key").alias("ikey"), "item"), "ikey")
    out = shared.stage(out.select(F.col("id").alias(id_col), "item", "start", "similarity"), "found")
    shared.discard(items, seeds, places, windows, near, bags, probes)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id_col, contaminated, n_items (items found in the text), n_windows and best_similarity (0 if none).

    Rows that share an id, null too, share the result. Options are those of leaks().
    """
    found = leaks(docs, benchmark, id_col, **options)
    per = found.groupBy(F.col(id_col).alias("found_id")).agg(F.countDistinct("item").alias("items"), F.countDistinct("start", "item").alias("windows"), F.max("similarity").alias("best"))
    out = docs.select(F.col(id_col)).join(per, F.col(id_col).eqNullSafe(F.col("found_id")), "left")
    zero = lambda c, k: F.coalesce(F.col(c), F.lit(0)).cast(k)
    return out.select(id_col, F.col("items").isNotNull().alias("contaminated"), zero("items", "long").alias("n_items"), zero("windows", "long").alias("n_windows"), zero("best", "double").alias("best_similarity"))
