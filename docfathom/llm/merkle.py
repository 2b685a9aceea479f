"""A Merkle manifest of a table: one tree for each source, one tree over their roots, and a proof for every row.

Rows are ranked inside their source by one range partitioning and the sizes of its parts, so that a source that holds most rows is ranked
by as many tasks as there are. Blocks of BLOCK consecutive nodes are ordered arrays; higher-order functions collapse a block to its root,
level by level, and the roots of a source's blocks are the nodes of the next round, until one is left. The way down gives each block the
siblings above it, so that a row's proof is what its own block holds and then what the block was given. Digests alone are shuffled, no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Nodes under one parent, levels that a block collapses, and so the nodes of a block.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts) -> F.Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value) -> F.Column:
    """A field of a leaf: - for null, else its length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(row: dict) -> F.Column:
    """The leaf of a row from its columns by field."""
    return digest(*[encoded(row[f]) for f in FIELDS])


def lower_ascii(text) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with pos (from 0, by the columns in order) and n (how many), both inside key; staged.

    Rows that are equal in all columns of order are told apart by where they were read, so that no number of them lands in one part.
    """
    by = ["key", *order, "tie"]
    parted = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    parted = shared.stage(parted.drop("tie").withColumn("at", F.monotonically_increasing_id()), name)  # its upper bits are the part
    part = F.shiftrightunsigned("at", 33)
    sizes = parted.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    own = Window.partitionBy("key")
    before = F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    out = parted.withColumn("part", part).join(sizes, ["key", "part"])
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _depth(n) -> F.Column:
    """Levels that a block of a source with n nodes at its level collapses: all of them, or as many as leave one."""
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(n <= FAN**level, level).otherwise(out)
    return out


def _parents(nodes) -> F.Column:
    """The level above an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (key, pos, n, digest, others) as blocks: key, block, n, items in order, levels (arrays of digests, the own one first); staged."""
    others = [c for c in nodes.columns if c not in ("key", "n")]
    item = F.struct("pos", *[c for c in others if c != "pos"])
    out = nodes.groupBy("key", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    rise = lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1))))
    steps = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: i <= _depth(F.col("n")))
    return shared.stage(out.withColumn("levels", F.aggregate(steps, F.array(F.col("items.digest")), rise)), name)


def _steps(levels, i) -> F.Column:
    """The siblings of a block's node i (from 0), left and right, from its own level to the block's root."""

    def step(level):
        nodes = F.element_at(levels, level + 1)
        at = F.floor(i / F.pow(F.lit(float(FAN)), level)).cast("int")
        first = (at - at % FAN).cast("int")
        join = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
        return F.struct(join(first + 1, at - first).alias("left"), join(at + 2, first + FAN - 1 - at).alias("right"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda x: x < F.size(levels) - 1), step)


def _build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each round, the first of the nodes themselves, until each key has one block."""
    rounds = [_blocks(nodes, f"{name}-0")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        tops = rounds[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), _top(F.col("levels")).alias("digest"))
        rounds.append(_blocks(tops, f"{name}-{len(rounds)}"))
    return rounds


def _top(levels) -> F.Column:
    return F.element_at(F.element_at(levels, -1), 1)


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """For each block of the first round what leads from its root up: above (one row per key) has the steps and values to start with."""
    given = [c for c in above.columns if c not in ("key", "steps")]
    known = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        down = blocks.drop("n", "items").join(known, ["key", "block"])
        lower = F.transform(F.element_at("levels", 1), lambda _, i: F.struct((F.col("block") * BLOCK + i).alias("block"), F.concat(_steps(F.col("levels"), i), F.col("steps")).alias("steps")))
        known = down.select("key", *given, F.inline(lower))
    return known


def manifest(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The proofs of all rows, and what they show where a text was tampered with.

    A row's leaf is the digest of doc_id, source, lang, n_chars and text, null fields apart from empty ones. Leaves of a source ascend by
    doc_id, null first; rows with one id (ties) by their leaves, and equal rows have equal leaves and places beside each other. Rows of
    no source form one of their own, before the others. Every FAN consecutive nodes become their digest until one is left; the sources'
    roots form a tree in the same way. Where 5 divides the CRC-32 of the decimal id, the text is tampered with: its A-Z are lower-cased;
    rows without an id are not. Texts may be of any length and are read where they lie. An empty table gives no rows. Other columns,
    whatever their names, are not read but for those in carry, which come back as carry0, carry1 ...

    Returns doc_id, source, leaf, subroot, root, proof (the siblings from the leaf to the root, as one text), folded_root (from the
    tampered row), verified (whether that is root), n_leaves (of the source), position (in it), steps.
    """
    field = {f: F.col(f"`{f}`") for f in FIELDS}
    kept, _ = shared.carried(docs, carry)
    odd = F.crc32(field["doc_id"].cast("string").cast("binary")) % 5 == 0
    leaf = leaf_of(field)
    tampered = F.when(odd, leaf_of(field | {"text": lower_ascii(field["text"])}))
    source = field["source"].cast("string")
    key = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))  # bytewise the order of sources, null first
    leaves = shared.stage(docs.select(key.alias("key"), field["doc_id"].alias("doc_id"), leaf.alias("digest"), tampered.alias("tampered"), *kept), "leaves")
    rounds = _build(_ranked(leaves, ["doc_id", "digest"], "ranked"), "blocks")

    subroots = rounds[-1].select("key", _top(F.col("levels")).alias("digest"))
    nodes = _ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), ["source"], "subroots")
    upper = _build(nodes, "upper")
    start = upper[-1].select("key", _top(F.col("levels")).alias("root"), F.array().cast(_STEPS).alias("steps"))
    known = upper[0].drop("n").join(_descend(upper, start), ["key", "block"])
    each = F.transform("items", lambda x, i: F.struct(x["source"].alias("key"), x["digest"].alias("subroot"), F.concat(_steps(F.col("levels"), i), F.col("steps")).alias("steps")))
    above = shared.stage(known.select("root", F.inline(each)), "above")

    down = rounds[0].join(_descend(rounds, above), ["key", "block"])
    each = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(_steps(F.col("levels"), i), F.col("steps")).alias("steps")))
    source_of = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1))
    out = down.select(source_of.alias("source"), F.col("n").alias("n_leaves"), "subroot", "root", F.inline(each))
    item = F.col("item")
    folded = F.aggregate("steps", F.coalesce(item["tampered"], item["digest"]), lambda acc, s: digest(s["left"], acc, s["right"]))
    return out.select(
        item["doc_id"].alias("doc_id"),
        "source",
        item["digest"].alias("leaf"),
        "subroot",
        "root",
        F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "").alias("proof"),
        folded.alias("folded_root"),
        "n_leaves",
        item["pos"].alias("position"),
        "steps",
        *[item[f"carry{j}"].alias(f"carry{j}") for j in range(len(carry))],
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
