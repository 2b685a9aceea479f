import math

import numpy as np

from docfathom.llm import ann


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = list({i: (i, v) for i, v in good}.values())
    return {i: sorted(((-float((v.astype(np.float32).astype(float) * w.astype(np.float32).astype(float)).sum()), j) for j, w in good if j != i))[:k] for i, v in good if i % every == 0}


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(30, 8))
    rows = [(i, (centers[i % 30] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3000)]
    same = rows[5][1]
    rows += [(4000 + i, same) for i in range(700)]
    rows += [(6000, None), (6020, [0.0] * 8), (6040, [float("nan")] * 8), (6060, [1.0, None] + [0.0] * 6), (6080, [float("inf")] * 8), (6100, [1.0]), (None, same), rows[40], rows[41]]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, id long").repartition(4)
    got = ann.search(df, every=20, k=20).collect()
    want = brute(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == want.keys()
    hits = total = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        kth = want[q][-1][0]
        hits += sum(-r.score <= kth + 1e-9 for r in own)
        total += 20
    assert hits / total >= 0.93
    hot = [r.vec_id for r in by[4000]]
    assert hot == [j for _, j in want[4000]]


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    got = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]


def test_doubles_stay_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5).collect()
    of = {i: np.array(v) for i, v in rows}
    assert len(got) == 15 and all(r.score == (of[r.query_id] * of[r.vec_id]).sum() for r in got)


def test_only_visited_leaves_are_multiplied():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(90, 6)), rng.normal(size=(7, 6))
    edges, visited = np.array([0, 20, 25, 60, 90]), rng.random((7, 4)) < 0.5
    visited[0] = False
    for leaf in range(4):  # a row of a leaf that nobody visits must not be looked at
        if not visited[:, leaf].any():
            x[edges[leaf] : edges[leaf + 1]] = np.nan
    got = list(ann.best(q, [-1] * 7, x, np.arange(90), 4, (edges, visited)))
    want = []
    for i in range(7):
        rows = [j for leaf in range(4) if visited[i, leaf] for j in range(edges[leaf], edges[leaf + 1])]
        want += [(i, j) for j in sorted(rows, key=lambda j: (-(x[j] * q[i]).sum(), j))[:4]]
    assert [(i, j) for i, j, _ in got] == want


def test_order_is_best_first():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    tree = ann.Tree(x, 40)
    parent = {kid: node for node, kids in enumerate(tree.children) for kid in kids}
    node_of = {leaf: node for node, leaf in enumerate(tree.leaf) if leaf >= 0}

    def path(node):
        return [node, *path(parent[node])] if node in parent else []  # without the root

    for q in x[:5]:
        order = list(tree.order(q))
        assert sorted(order) == list(range(tree.leaves))
        seen = set()
        for at, leaf in enumerate(order):  # no leaf that is open, with all that leads to it, is better than the one taken
            ways = {f: min(float(tree.centers[n] @ q) for n in path(node_of[f]) if n not in seen) for f in order[at:]}
            assert ways[leaf] >= max(ways.values()) - 1e-9
            seen.update(path(node_of[leaf]))
    leaf = tree.file(x)
    assert leaf.min() >= 0 and leaf.max() < tree.leaves


def test_repeated_ids_with_different_vectors(spark, monkeypatch):
    """The order of rows plays no part, and each id counts with the best of its rows."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(i % 60, (2 * rng.normal(size=8)).tolist()) for i in range(300)]
    pick = lambda rows, parts: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts), every=20, k=5, recall=1.0).collect())
    got = pick(rows, 3)
    assert got == pick(rows[::-1], 5)
    own: dict = {}
    for i, v in rows:
        own.setdefault(i, []).append(np.array(v))
    exact = total = 0
    for q in (i for i in own if i % 20 == 0):
        want = sorted((-max(float((a * b).sum()) for a in own[q] for b in vs), j) for j, vs in own.items() if j != q)[:5]
        mine = [(-s, j) for i, _, j, s in got if i == q]
        assert len(mine) == len({j for _, j in mine}) == 5
        exact += sum(abs(s - t) < 1e-12 and i == j for (s, i), (t, j) in zip(mine, want, strict=True))
        total += 5
    assert exact >= 0.9 * total


def test_best_with_repeated_ids_is_exact():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(300, 4)), rng.normal(size=(7, 4))
    ids, own = rng.integers(0, 80, 300), np.arange(7)
    got: dict = {}
    for i, j, s in ann.best(q, own, x, ids, 9):
        got.setdefault(i, []).append((-s, j))
    for i in range(7):
        want = sorted((-max(float((x[r] * q[i]).sum()) for r in np.flatnonzero(ids == j)), j) for j in set(ids.tolist()) if j != own[i])[:9]
        assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([s for s, _ in got[i]], [s for s, _ in want])
