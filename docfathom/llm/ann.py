"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed in the leaf that a greedy descent reaches. A query walks the tree best bin
first: a priority queue holds open nodes by the inner product of query and center, and leaves are visited in the order they come up. How
many leaves are visited is calibrated: it is widened until the true neighbours of a few queries, found by brute force over all vectors,
lie in visited leaves with the wanted recall.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
BRANCHES, LEAF_ROWS, CALIBRATION = 16, 200, 64
#: Vectors (and bytes of them) that a task compares with a block of queries: whole leaves, or parts of a large one.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_QUERIES = 20_000, 32 << 20, 1000


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centers of Lloyd's algorithm; centers that lose all their points go."""
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        new = sums[n > 0] / n[n > 0, None]
        if new.shape == centers.shape and np.allclose(new, centers):
            break
        centers = new
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


class Tree:
    """Nodes of a k-means tree: centers, children (empty for leaves) and the leaf numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centers, self.children, self.leaf = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1]
        self.leaves = 0
        work = [(0, sample, leaves)]
        while work:
            node, x, want = work.pop()
            centers = kmeans(x, min(BRANCHES, want), rng) if want > 1 and len(x) > 1 else x[:0]
            if len(centers) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            at = nearest(x, centers)
            for c in range(len(centers)):
                own = x[at == c]
                self.centers.append(centers[c])
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centers) - 1)
                work.append((len(self.centers) - 1, own, round(want * len(own) / max(1, len(x)))))
        self.centers = np.array(self.centers)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        out = np.full(len(x), -1)
        level = {0: np.arange(len(x))}
        while level:
            after: dict[int, np.ndarray] = {}
            for n, rows in level.items():
                if not self.children[n]:
                    out[rows] = self.leaf[n]
                    continue
                kids = np.array(self.children[n])
                at = nearest(x[rows], self.centers[kids])
                for c in np.unique(at):
                    after[int(kids[c])] = rows[at == c]
            level = after
        return out

    def order(self, q: np.ndarray):
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for k, s in zip(kids, (self.centers[kids] @ q).tolist(), strict=True):
                heapq.heappush(heap, (-s, k))


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def best(q: np.ndarray, own, x: np.ndarray, ids: np.ndarray, k: int, leaves=None):
    """For each query the k ids whose rows in x have the largest inner products, ties to smaller ids, without its own: (query row, id, score).
    An id with several rows counts with the best of them for that query.

    leaves: (the first row of each leaf in x, and the end; for each query which leaves it visits). Only rows of visited leaves are
    multiplied.
    """
    by_id = np.argsort(ids, kind="stable")
    names, first = np.unique(ids[by_id], return_index=True)
    repeated = len(names) < len(ids)
    for at in range(0, len(q), 100):
        part = q[at : at + 100]
        if leaves is None:
            scores = part @ x.T
        else:
            scores = np.full((len(part), len(x)), -np.inf)
            edges, visited = leaves
            for leaf, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                who = np.flatnonzero(visited[at : at + 100, leaf])
                if len(who):
                    scores[who, a:b] = part[who] @ x[a:b].T
        each = np.maximum.reduceat(scores[:, by_id], first, axis=1) if repeated else scores
        for i, s in enumerate(each, at):
            cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
            take = np.flatnonzero(s >= cut - 1e-9 * (1 + abs(cut)) if np.isfinite(cut) else s > -np.inf)
            if repeated:  # all rows of those ids that the query has seen
                take = np.flatnonzero(np.isin(ids, names[take]) & np.isfinite(scores[i - at]))
            take = take[ids[take] != own[i]]
            exact = (x[take] * q[i]).sum(axis=1)  # the same order of additions for each row, so that equal vectors tie
            order = np.lexsort((ids[take], -exact))
            if repeated:
                order = order[np.sort(np.unique(ids[take][order], return_index=True)[1])]  # the best row of each id, best first
            for j in order[:k]:
                yield i, int(ids[take[j]]), float(exact[j])


_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "qid long, id long, score double"


def _found(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[c] for r in rows], _FOUND.field(c).type) for c in range(3)], schema=_FOUND)


def _brute(q: np.ndarray, own: np.ndarray, d: int, k: int):
    def run(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("vec"), d), batch.column("id").to_numpy()
            yield from _found((int(own[i]), j, s) for i, j, s in best(q, own, x, ids, k)).to_batches()

    return run


def _file(tree: Tree, d: int):
    """The leaf of every vector, the vector as it came."""

    def run(batches):
        for batch in batches:
            leaf = tree.file(_matrix(batch.column("vec"), d)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(leaf, pa.int32()), batch.column("id"), batch.column("vec")], names=["leaf", "id", "vec"])

    return run


def _visits(tree: Tree, q: np.ndarray, visits: int, rows: np.ndarray, k: int) -> list[int]:
    """The first leaves in order: as many as calibrated, and until they hold k rows besides the query's own."""
    out, have = [], 0
    for leaf in tree.order(q):
        if len(out) >= visits and have > k:
            break
        out.append(leaf)
        have += int(rows[leaf])
    return out


def _walk(tree: Tree, d: int, visits: int, rows: np.ndarray, k: int, bin_of: np.ndarray):
    """For each query a row for each bin that holds leaves it visits."""

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("vec"), d)
            row, bins, leaves = [], [], []
            for i in range(len(q)):
                own: dict[int, list[int]] = {}
                for leaf in _visits(tree, q[i], visits, rows, k):
                    own.setdefault(int(bin_of[leaf]), []).append(leaf)
                row += [i] * len(own)
                bins += own
                leaves += own.values()
            at = pa.array(row, pa.int32())
            yield pa.record_batch(
                [pa.array(bins, pa.int32()), batch.column("id").take(at), batch.column("vec").take(at), pa.array(leaves, pa.list_(pa.int32()))],
                names=["bin", "id", "vec", "leaves"],
            )

    return run


def _compare(d: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, leaves = table.column("id").to_numpy(), table.column("leaves").to_pylist()
        x = _matrix(table.column("vec"), d)
        role = table.column("role").to_numpy()
        q, v = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        if not len(q) or not len(v):
            return _FOUND.empty_table()
        leaf = np.array([leaves[i][0] for i in v])
        order = np.argsort(leaf, kind="stable")  # rows of a leaf lie together
        v, (held, first) = v[order], np.unique(leaf[order], return_index=True)
        visited = np.array([np.isin(held, leaves[i]) for i in q])
        ways = (np.append(first, len(v)), visited)
        return _found((int(ids[q[i]]), j, s) for i, j, s in best(x[q], ids[q], x[v], ids[v], k, ways))

    return run


def usable(vec) -> F.Column:
    """Vectors that take part: not null, not zero, all components finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """For each row whose id is divisible by `every`, the k other rows of largest inner product that the tree finds.

    Ties go to smaller ids; fewer rows come only if there are no more candidates. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part, nor do rows with a null id; an id with several rows is a candidate
    with the best of them, and a query with the best of its own; other columns are not read. Components are kept as they are (float, else double). The tree is fitted on at most SAMPLE_ROWS vectors (those of least hash), every vector is filed in it.

    Returns query_id, rank (from 1), vec_id, score (in double precision), and visits (leaves that were visited).
    """
    spark = vectors.sparkSession
    vec = F.col(vector_col)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.cast(kind).alias("vec"), F.size(vec).alias("d")).filter(F.col("id").isNotNull() & usable(vec))
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double, visits int"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, total = int(sizes[0]["d"]), int(sizes[0]["count"])
    rows = rows.filter(F.col("d") == d).select("id", "vec")
    limit = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * d)))
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(limit).select("vec").collect()], np.float64)
    tree = Tree(sample, max(1, min(total // LEAF_ROWS, len(sample) // 10)))
    filed = shared.stage(rows.mapInArrow(_file(tree, d), f"leaf int, id long, vec {kind}"), "filed")
    held = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row per leaf
        held[r["leaf"]] = r["count"]

    queries = rows.filter(F.col("id") % every == 0)
    probe = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).collect()
    if not probe:
        return spark.createDataFrame([], schema)
    own, q = np.array([r["id"] for r in probe]), np.array([r["vec"] for r in probe], np.float64)
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    true = filed.select("id", "vec").mapInArrow(_brute(q, own, d, k), _FOUND_SQL).groupBy("qid", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    where: dict[int, list[int]] = {}
    for r in true.join(filed.select("id", "leaf"), "id").collect():  # CALIBRATION * k rows
        where.setdefault(r["qid"], []).append(r["leaf"])
    orders = {int(i): list(tree.order(v)) for i, v in zip(own, q, strict=True)}
    visits, all_true = 1, sum(map(len, where.values()))
    while visits < tree.leaves:
        hit = sum(leaf in (seen := set(orders[i][:visits])) for i, leaves in where.items() for leaf in leaves)
        if hit >= recall * all_true:
            break
        visits = min(tree.leaves, visits + max(1, visits // 4))

    # bins of whole leaves with about as many rows as a task compares at once
    block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
    bin_of, in_bin = np.zeros(tree.leaves, np.int64), [0]
    for leaf, n in enumerate(held.tolist()):
        if in_bin[-1] and in_bin[-1] + n > block:
            in_bin.append(0)
        bin_of[leaf] = len(in_bin) - 1
        in_bin[-1] += n
    walked = queries.repartition(F.col("id")).mapInArrow(_walk(tree, d, visits, held, k, bin_of), f"bin int, id long, vec {kind}, leaves array<int>")
    walked = shared.stage(walked, "walked")
    asked = np.zeros(len(in_bin), np.int64)
    for r in walked.groupBy("bin").count().collect():
        asked[r["bin"]] = r["count"]
    parts = lambda n, size: F.array(*map(F.lit, np.maximum(1, -(-np.array(n) // size)).tolist()))
    n_rows, n_asked = parts(in_bin, block), parts(asked, BLOCK_QUERIES)
    mine = lambda n: F.pmod(F.xxhash64("id"), n[F.col("bin")])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n[F.col("bin")] - 1).cast("long")))
    side_v = filed.withColumn("bin", F.array(*map(F.lit, bin_of.tolist()))[F.col("leaf")].cast("int"))
    side_v = side_v.select("bin", mine(n_rows).alias("a"), each(n_asked).alias("b"), "id", "vec", F.array("leaf").alias("leaves"), F.lit(0).alias("role"))
    side_q = walked.select("bin", each(n_rows).alias("a"), mine(n_asked).alias("b"), "id", "vec", "leaves", F.lit(1).alias("role"))
    found = side_v.unionByName(side_q).groupBy("bin", "a", "b").applyInArrow(_compare(d, k), _FOUND_SQL).groupBy("qid", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score", F.lit(int(visits)).alias("visits"))
