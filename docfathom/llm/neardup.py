"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: t coordinates. In round i < t every element is thrown into one hashed bin and a bin keeps the least value of the first round
that reached it; in round t + j every element goes to bin j, so after 2t rounds every coordinate is filled. Rows of equal coordinates
between two sketches concentrate around the similarity as for t independent minima, for O(n + t log t) work.

With bands of 5 out of 160 coordinates, two sets of similarity 0.85 share no band with probability 7e-9 (0.8: 3e-6).
Equal sets are one class from the start. In each band bucket all members are compared exactly with the bucket's first member; buckets
whose members then still lie in different components are compared in blocks, those outside the first member's component against all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, shared
from .hashing import Words, mix, sums, window_hash

COORDINATES, BAND = 160, 5
#: Members of a bucket that one task compares with as many others.
CHUNK = 500


def shingle_sets(column, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, ascending, one text after another; and where each text's begin."""
    words = Words(column, lower=True)
    n, first = len(words.starts), words.first
    rows = len(first) - 1
    h = window_hash(sums(words.hash), size)
    count = np.diff(first)
    row_of = np.repeat(np.arange(rows), count)
    at = np.flatnonzero(row_of[: len(h)] == row_of[size - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    row, value = row_of[at], h[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        prefix = sums(words.hash)
        extra = np.array([window_hash(prefix[first[i] : first[i + 1] + 1] * _shift(first[i]), int(count[i]))[0] ^ np.uint64(count[i]) for i in short], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _shift(start: int) -> np.uint64:
    """Makes a window's hash the same wherever it stands in a batch."""
    from .hashing import powers

    return powers(int(start) + 1)[1][int(start)]


def sketch(values: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of each set as a row of t coordinates; rows of empty sets stay at the largest value."""
    rows, none = len(bounds) - 1, np.uint64(2**64 - 1)
    out = np.full(rows * t, none)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    left = values
    for i in range(2 * t):
        if not len(left):
            break
        with np.errstate(over="ignore"):
            x = mix(left ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        got = np.full(rows * t, none)
        np.minimum.at(got, row * t + bins, (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        np.copyto(out, got, where=out == none)
        open_ = (out.reshape(rows, t) == none).any(axis=1)
        if not open_.all():
            keep = open_[row]
            row, left = row[keep], left[keep]
    return out.reshape(rows, t)


def bands(sketches: np.ndarray, width: int = BAND) -> np.ndarray:
    """One hash for each band of each sketch, as signed 64-bit integers."""
    rows, t = sketches.shape
    parts = sketches.reshape(rows, t // width, width)
    out = np.zeros(parts.shape[:2], np.uint64)
    for j in range(width):
        out = mix(out ^ mix(parts[:, :, j] + np.uint64(j + 1)))
    return mix(out ^ np.arange(1, t // width + 1, dtype=np.uint64)).view(np.int64)


def _describe(size: int):
    def run(batches):
        for batch in batches:
            for part in shared.slices(batch, "text"):
                value, bounds = shingle_sets(part.column("text"), size)
                n = np.diff(bounds)
                padded = np.concatenate([value, [np.uint64(0)]])
                ends = np.minimum(bounds[:-1], len(value))
                key = np.stack([np.add.reduceat(padded, ends), np.add.reduceat(mix(padded ^ np.uint64(0x5DEECE66D)), ends)], axis=1)
                keys = pa.array([k.tobytes() if c else None for k, c in zip(key, n, strict=True)], pa.binary())
                b = bands(sketch(value, bounds))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, b.shape[1], 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(b[n > 0].ravel()))
                yield pa.record_batch([part.column("uid"), part.column("id"), pa.array(n, pa.int64()), keys, lists], names=["uid", "id", "n", "key", "bands"])

    return run


def _sets(size: int, wanted: str):
    def run(batches):
        block, ids = None, np.zeros(0, np.int64)
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block:
                    ids, block = np.sort(np.array(exchange.read_block(wanted, b, ["uid"])["uid"], np.int64)), b
                take = np.flatnonzero(np.isin(rows.column("uid").to_numpy(), ids))
                if not len(take):
                    continue
                for part in shared.slices(rows.take(pa.array(take)), "text"):
                    value, bounds = shingle_sets(part.column("text"), size)
                    sets = pa.array([value[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                    yield pa.record_batch([part.column("uid"), sets], names=["uid", "shingles"])

    return run


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _common(ordered: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each of the others are in ordered."""
    hit = exchange._within(np.concatenate(others), ordered)
    total = np.concatenate([[0], np.cumsum(hit)])
    ends = np.cumsum([len(x) for x in others])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_LINKS_SQL = "a long, b long"


def _star(percent: int):
    """Compares the members that one block has of a center's buckets with the center."""

    def run(table: pa.Table) -> pa.Table:
        uid, role = table.column("uid").to_numpy(), table.column("role").to_numpy()
        sets = _arrays(table.column("shingles"))
        center = sets[int(np.flatnonzero(role == 1)[0])]
        members = np.flatnonzero(role == 0)
        common = _common(center, [sets[i] for i in members])
        union = np.array([len(sets[i]) for i in members]) + len(center) - common
        ok = 100 * common >= percent * union
        hub = table.column("center").to_numpy()[0]
        return pa.table([pa.array(uid[members][ok]), pa.array(np.full(int(ok.sum()), hub))], schema=_LINKS)

    return run


def _blocks(percent: int):
    """Compares each member of a minor chunk with the members of another chunk that are in other components."""

    def run(table: pa.Table) -> pa.Table:
        uid, label, role = (table.column(c).to_numpy() for c in ("uid", "label", "role"))
        sets = _arrays(table.column("shingles"))
        minor, others = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        owner = np.repeat(others, [len(sets[i]) for i in others])
        flat = np.concatenate([sets[i] for i in others])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        size = np.array([len(s) for s in sets])
        out = []
        for i in minor:
            a, z = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = z - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((common > 0) & (100 * common >= percent * (size + size[i] - common)) & (label != label[i])):
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(label[i]), int(label[j])))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=_LINKS)

    return run


def components(links: DataFrame) -> DataFrame:
    """The least vertex of each component, staged: (v, label) for every vertex of links (a, b).

    Each round takes the least label among neighbours, then that label's label. A vertex with very many links, and a label that very many
    vertices have, are hot keys of these joins: they are split.
    """
    links_both = shared.stage(links.union(links.select("b", "a")).distinct(), "links")
    both = links_both.toDF("src", "dst")
    labels = shared.stage(both.groupBy(F.col("src").alias("v")).agg(F.min(F.least("src", "dst")).alias("label"), F.count("*").alias("degree")), "labels")
    total = max(1, labels.agg(F.sum("degree")).first()[0] or 0)
    while True:
        near = shared.split_join(both, labels.withColumnRenamed("v", "src"), "src", "degree", total).groupBy("dst").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("v") == F.col("dst")).select("v", "degree", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = shared.stage(step, "steps")
        up = labels.select(F.col("v").alias("next"), F.col("label").alias("top")).join(step.groupBy("next").agg(F.count("*").alias("rows")), "next")
        up = shared.stage(up, "tops")
        jumped = shared.stage(shared.split_join(step, up, "next", "rows", total).select("v", "degree", F.least("next", "top").alias("label"), "old"), "labels")
        changed = jumped.filter("label < old").limit(1).count()
        shared.discard(labels, step, up)
        path = shared.path_of(jumped)
        labels = jumped.select("v", "label", "degree")
        labels._docfathom_path = path
        if not changed:
            shared.discard(links_both)
            return labels


def _solve(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The staged rows (block, uid, ...), and for each row uid, id, n, component_id and the least uid of its component."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    through, _ = shared.carried(docs, carry)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *through)
    base, _ = exchange.blocks(rows, "neardup")
    kind = base.schema["id"].dataType.simpleString()
    known = shared.stage(base.select("uid", "id", "text").mapInArrow(_describe(size), f"uid long, id {kind}, n long, key binary, bands array<long>"), "sketches")
    classes = known.filter("n > 0").groupBy("key").agg(F.min("uid").alias("rep"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = shared.stage(classes, "classes")

    reps = known.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    entries = shared.stage(reps.select("uid", "n", F.explode("bands").alias("h")), "entries")
    found = entries.groupBy("h").agg(F.count("*").alias("c"), F.min("uid").alias("center"), signature("uid").alias("sig"), F.max("uid").alias("last"))
    buckets = shared.stage(found.filter("c > 1"), "buckets")
    total = entries.count()
    members = shared.stage(shared.split_join(entries, buckets, "h", "c", total), "members")
    shared.discard(entries)

    wanted = members.select("uid").distinct().withColumn("block", F.shiftright("uid", 33).cast("int"))
    wanted = shared.stage(wanted.repartition(F.col("block")), "wanted", "block")
    sets = shared.stage(base.select("block", "uid", "text").mapInArrow(_sets(size, shared.path_of(wanted)), "uid long, shingles binary"), "sets")

    pairs = members.filter("uid != center").select("uid", "center").distinct().withColumn("part", F.shiftright("uid", 33))
    side = pairs.join(sets, "uid").select("center", "part", "uid", F.lit(0).alias("role"), "shingles")
    hubs = pairs.select("center", "part").distinct().join(sets.withColumnRenamed("uid", "center"), "center")
    side = side.unionByName(hubs.select("center", "part", F.col("center").alias("uid"), F.lit(1).alias("role"), "shingles"))
    links = shared.stage(side.groupBy("center", "part").applyInArrow(_star(percent), _LINKS_SQL), "star")
    labels = components(links)
    shared.discard(links, wanted)

    # buckets whose members are still in different components
    lab = labels.select(F.col("v").alias("uid"), "label")
    told = members.join(lab, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    told = shared.stage(told.select("h", "uid", "label", "c", "sig", "center", "last", (F.col("uid") == F.col("center")).alias("first")), "told")
    shared.discard(members, buckets)
    # a bucket's hub is the component of its first member; equal buckets (the same members) are looked at once
    per = told.groupBy("h", "c", "sig", "center", "last").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("first"), F.col("label"))).alias("hub"))
    per = per.filter("lo < hi").groupBy("c", "sig", "center", "last", "hub").agg(F.min("h").alias("h"))
    open_ = shared.stage(per.select("h", F.col("c").alias("weight"), "hub"), "open")
    mixed = shared.split_join(told.select("h", "uid", "label", "c"), open_, "h", "weight", total).withColumn("minor", F.col("label") != F.col("hub"))
    mixed = mixed_table = shared.stage(mixed, "mixed")
    shared.discard(told, open_)
    minors = shared.stage(mixed.filter("minor").groupBy("h").agg(F.count("*").alias("m"), F.max("c").alias("weight")), "minors")
    mixed = shared.split_join(mixed.drop("weight"), minors, "h", "weight", total)
    slots = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    slot = lambda n: F.pmod(F.xxhash64("uid"), slots(n)).cast("int")
    mixed = mixed.withColumn("s_all", slots(F.col("c"))).withColumn("s_minor", slots(F.col("m"))).withColumn("mine", slot(F.col("c"))).withColumn("mine_minor", slot(F.col("m")))
    as_all = mixed.select("h", F.explode(F.sequence(F.lit(0), F.col("s_minor") - 1)).alias("x"), F.col("mine").alias("y"), "uid", "label", F.lit(0).alias("role"))
    as_minor = mixed.filter("minor").select("h", F.col("mine_minor").alias("x"), F.explode(F.sequence(F.lit(0), F.col("s_all") - 1)).alias("y"), "uid", "label", F.lit(1).alias("role"))
    work = as_all.unionByName(as_minor).join(sets, "uid")
    more = shared.stage(work.groupBy("h", "x", "y").applyInArrow(_guard(_blocks(percent)), _LINKS_SQL), "more")
    shared.discard(sets, mixed_table, minors)
    top = components(more)
    over = top.select(F.col("v").alias("label"), F.col("label").alias("top")).join(labels.groupBy("label").agg(F.count("*").alias("rows")), "label")
    over = shared.stage(over, "over")
    label = shared.split_join(labels, over, "label", "rows", total, "left").select("v", F.coalesce("top", "label").alias("label"))
    lone = top.select("v", "label").join(labels.select("v"), "v", "left_anti")
    label = shared.stage(label.unionByName(lone), "label")
    shared.discard(labels, top, more, over)

    placed = classes.join(label, F.col("rep") == F.col("v"), "left").select("key", "least", "copies", F.coalesce("label", "rep").alias("label"))
    placed = shared.stage(placed, "placed")
    least = shared.stage(placed.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("weight")), "least")
    placed = shared.split_join(placed, least, "label", "weight", total).select("key", "copies", "component_id", "label")
    placed = shared.stage(placed, "components")
    out = shared.split_join(known.select("uid", "id", "n", "key"), placed, "key", "copies", total, "left")
    alone = F.col("n") == 0
    return base, out.select("uid", "id", "n", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("uid")).otherwise(F.col("label")).alias("first"))


def signature(uid: str) -> F.Column:
    """128 bits that tell sets of ids apart."""
    return F.struct(F.bit_xor(F.xxhash64(uid)).alias("a"), F.bit_xor(F.xxhash64(uid, F.lit(1))).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """Components of texts whose sets of distinct `size`-word shingles have 100 * intersection >= percent * union.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text with fewer words is one shingle; one without words, or null, has an
    empty set and is linked with nothing. Texts take part whole, other columns are not read. Equal rows are linked like any copies.
    A row with a null id is a text like any other; it names no component.

    Returns id_col, n_shingles, component_id (the smallest id in the component) and kept (id = component_id, or the component has no id).
    """
    base, out = _solve(docs, id_col, text_col, percent, size)
    shared.discard(base)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def _without(path: str):
    def run(batches):
        block, gone = None, np.zeros(0, np.int64)
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block:
                    gone, block = np.array(exchange.read_block(path, b, ["uid"])["uid"], np.int64), b
                rows = rows.take(pa.array(np.flatnonzero(~np.isin(rows.column("uid").to_numpy(), gone))))
                yield rows.select([c for c in rows.schema.names if c.startswith("carry")])

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs without near duplicates: of each component of near_duplicates() the first row in the order of the input.

    Of equal rows one stays; texts without words all stay. All columns are returned.
    """
    columns = tuple(docs.columns)
    base, out = _solve(docs, id_col, text_col, percent, size, columns)
    gone = out.filter("uid != first").select("uid", F.shiftright("uid", 33).cast("int").alias("block"))
    gone = shared.stage(gone.repartition(F.col("block")), "gone", "block")
    schema = shared.carried(docs, columns)[1]
    from pyspark.sql import types as T

    left = base.select("block", "uid", *[f.name for f in schema]).mapInArrow(_without(shared.path_of(gone)), T.StructType(schema))
    return left.select(*shared.uncarried(left, columns))


def _guard(f):
    """f, for groups that have both roles."""

    def run(table: pa.Table) -> pa.Table:
        roles = set(table.column("role").to_pylist())
        return f(table) if roles == {0, 1} else _LINKS.empty_table()

    return run
