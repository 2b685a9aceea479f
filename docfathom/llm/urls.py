"""URL filters: rules for hosts and paths, and a tree of path templates whose branches are judged by labels.

URLs are counted by shape first: a host and the segments of its path with digits generalised. The tree grows from the hosts, one level of
segments after the other. Where most children of a node are seen once, the segment is variable and becomes a wildcard. Children whose
share of bad labels does not differ from that of their siblings are merged into a wildcard as well, those that differ in the same direction
with each other, and a child that is like none stays by itself. A template is rejected where its purity, the share of good labels smoothed
towards the node above it, is low. All steps are counts and joins by node; nodes that hold many rows are broadcast, so that one host may
hold most URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ANY, WORSE, BETTER, TAIL = "*", "{+}", "{-}", "**"


@dataclass(frozen=True)
class Settings:
    """What shapes the tree: levels of segments (what lies deeper shares the template's tail), children of a variable segment at least,
    labels that a child needs to be told from its siblings, the chi-square value from which it differs, pseudo-labels that a node takes
    from the one above, and the purity under which a template is rejected."""

    depth: int = 4
    children: int = 8
    labels: int = 5
    differs: float = 3.841
    pseudo: float = 4.0
    purity: float = 0.5


def parsed(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and what has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host, path, rules) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict, or nulls. rules: (verdict, host/path); of two as long the longer host, then block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    strength = lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[0] == "block")
    for kind, text in sorted(rules, key=strength):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path) -> F.Column:
    """The segments of a path, without empty ones, each run of digits as {n}."""
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))


def _differs(lab, bad, all_lab, all_bad, s: Settings) -> F.Column:
    """Whether a child's share of bad labels is another than that of the rest: chi-square of the two by two table."""
    some = (lab >= s.labels) & (all_lab > lab) & (all_bad > 0) & (all_lab > all_bad)
    gap = (bad * (all_lab - lab) - (all_bad - bad) * lab).cast("double")
    spread = lab.cast("double") * (all_lab - lab) * all_bad * (all_lab - all_bad)
    return some & (F.when(some, gap * gap * all_lab / spread).otherwise(0.0) >= s.differs)


def _level(rows: DataFrame, k: int, total: int, s: Settings) -> DataFrame:
    """rows (node, segs, n, lab, bad) with the node that their k-th segment leads to, staged; those that end before stay where they are."""
    named = rows.withColumn("child", F.get("segs", F.lit(k)))
    link = F.when(F.col("child").isNotNull(), F.concat("node", F.lit("/"), "child"))  # nodes hold wildcards, segments no slashes
    named = named.withColumn("link", link).drop("child")
    sums = lambda *more: [F.sum(c).alias(c) for c in ("n", "lab", "bad", *more)]
    kids = named.filter("link IS NOT NULL").groupBy("link", "node").agg(*sums(), F.count("*").alias("rows"))
    kids = shared.stage(kids, "kids")
    nodes = kids.groupBy("node").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    nodes = shared.stage(nodes, "nodes")
    known = shared.split_join(kids, nodes, "node", "kids", total)
    c = F.col
    variable = (c("kids") >= s.children) & (2 * c("kids") > c("all_n"))
    odd = _differs(c("lab"), c("bad"), c("all_lab"), c("all_bad"), s)
    side = F.when(c("bad") * c("all_lab") > c("all_bad") * c("lab"), WORSE).otherwise(BETTER)
    first = F.when(c("kids") == 1, "=").when(variable | ~odd, ANY).otherwise(side)
    known = known.withColumn("step", first).drop("kids", "all_n", "all_lab", "all_bad")
    known = shared.stage(known, "steps")
    apart = c("step").isin(WORSE, BETTER)
    sides = known.filter(apart).withColumn("side", F.concat("node", F.lit("/"), "step")).groupBy("side").agg(F.count("*").alias("kids"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    sides = shared.stage(sides, "sides")
    both = shared.split_join(known.filter(apart).withColumn("side", F.concat("node", F.lit("/"), "step")), sides, "side", "kids", total)
    alone = (c("kids") == 1) | _differs(c("lab"), c("bad"), c("all_lab"), c("all_bad"), s)
    both = both.withColumn("step", F.when(alone, "=").otherwise(c("step")))
    ways = known.filter(~apart).select("link", "node", "step", "rows").unionByName(both.select("link", "node", "step", "rows"))
    ways = ways.select("link", "rows", F.when(c("step") == "=", c("link")).otherwise(F.concat("node", F.lit("/"), "step")).alias("next"))
    out = shared.split_join(named, shared.stage(ways, "ways"), "link", "rows", total, "left")
    out = out.select(F.coalesce("next", "node").alias("node"), F.when(c("next").isNotNull(), c("node")).alias("above"), "shape", "segs", "n", "lab", "bad")
    return shared.stage(out, f"level-{k}")


def templates(urls: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The template and purity of each shape: shape, n (URLs), template, purity.

    urls: host, path. labelled: host, path, bad (0 or 1; null rows do not count). Without labels every purity is 1.
    """
    count = lambda df, n, lab, bad: df.select("host", segments(F.col("path")).alias("segs"), F.lit(n).alias("n"), lab.alias("lab"), bad.alias("bad"))
    seen = count(urls, 1, F.lit(0), F.lit(0)).unionByName(count(labelled.filter("bad IS NOT NULL"), 0, F.lit(1), F.col("bad").cast("int")))
    shapes = seen.groupBy("host", "segs").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    shape = F.concat_ws("/", F.array("host"), "segs")
    rows = shared.stage(shapes.select(F.col("host").alias("node"), shape.alias("shape"), "segs", "n", "lab", "bad"), "shapes")
    all_ = rows.agg(F.count("*").alias("rows"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = all_["bad"] / all_["lab"] if all_["lab"] else 0.0
    smooth = lambda above: (F.sum("bad") + settings.pseudo * above) / (F.sum("lab") + settings.pseudo)
    rates = shared.stage(rows.groupBy("node").agg(smooth(F.lit(prior)).alias("rate")), "rates")
    for k in range(settings.depth):
        rows = _level(rows, k, all_["rows"], settings)
        moved = rows.filter("above IS NOT NULL").groupBy("node", "above").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        parents = rates.select(F.col("node").alias("above"), F.col("rate").alias("upper"))
        own = moved.join(parents, "above").select("node", ((F.col("bad") + settings.pseudo * F.col("upper")) / (F.col("lab") + settings.pseudo)).alias("rate"))
        rates = shared.stage(rates.unionByName(own), "rates")
    sizes = shared.stage(rows.groupBy("node").agg(F.count("*").alias("rows")).join(rates, "node"), "known")
    out = shared.split_join(rows.select("node", "shape", "segs", "n"), sizes, "node", "rows", all_["rows"])
    deep = F.size("segs") > settings.depth
    return out.select("shape", "n", F.when(deep, F.concat("node", F.lit("/" + TAIL))).otherwise(F.col("node")).alias("template"), (1 - F.col("rate")).alias("purity"))


def judge(urls: DataFrame, labelled: DataFrame, rules=(), settings: Settings = Settings(), url_col: str = "url", carry: tuple[str, ...] = ()) -> DataFrame:
    """A verdict for every URL: that of the longest rule that fits, else block where the purity of its template is low.

    Null URLs and those without :// have an empty host and path and are of one template; equal URLs are judged alike, each row comes back.
    URLs of any length are read whole; segments beyond the depth of the tree share one tail. Hosts without labels have the purity of
    their tree's labels, that of all URLs. An empty table gives no rows. Columns in carry come back as carry0 ...; no others are read.

    labelled: url, bad (1 for URLs to be rejected, 0 for good ones). Returns host, path, rule, verdict, template, purity.
    """
    kept, _ = shared.carried(urls, carry)
    host, path = parsed(F.col(f"`{url_col}`"))
    rows = urls.select(host.alias("host"), path.alias("path"), *kept)
    host, path = parsed(F.col("url"))
    known = shared.stage(templates(rows.select("host", "path"), labelled.select(host.alias("host"), path.alias("path"), "bad"), settings).filter("n > 0"), "templates")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = rows.withColumn("shape", F.concat_ws("/", F.array("host"), segments(F.col("path"))))
    out = shared.split_join(rows, known, "shape", "n", total)
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    found = F.when(F.col("purity") < settings.purity, "block").otherwise("allow")
    return out.select(*[F.col(f"carry{i}") for i in range(len(carry))], "host", "path", rule.alias("rule"), F.coalesce(said, found).alias("verdict"), "template", "purity")
