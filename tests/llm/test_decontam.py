import random
import re

from docfathom.llm import decontam


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bag(w):
    out = {}
    for i in range(len(w) - 4):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def brute(docs, items, similarity=0.8):
    found = set()
    bags = [(i, len(words(t)), bag(words(t))) for i, t in items if len(words(t)) >= 5]
    for d, t in docs:
        w = words(t)
        for item, n, theirs in bags:
            for s in range(max(1, len(w) - n + 1)):
                ours = bag(w[s : s + n])
                common = sum(min(c, theirs.get(k, 0)) for k, c in ours.items())
                if common and common / (sum(ours.values()) + sum(theirs.values()) - common) >= similarity:
                    found.add((d, item, s))
    return found


def test_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([5, 8, 20, 36, 60])))) for i in range(25)] + [(90, None), (91, "too short"), (None, "no id but five words here"), (3, "a a a a a a a a a a")]
    docs = []
    for i in range(60):
        item = words(items[i % 25][1])
        kind = i % 6
        if kind == 1:
            item[len(item) // 2] = "changed"
        if kind == 2:
            item = item[: int(len(item) * 0.9) or 1]
        if kind == 3:
            item = [w.upper() + "," for w in item]
        if kind == 4:
            item = make(30)
        if kind == 5:
            item = item[:3] + ["extra"] + item[3:]
        docs.append((i, " ".join(make(rng.choice([0, 4, 50])) + item + make(rng.choice([0, 30])))))
    docs += [(100, None), (101, ""), (102, "a " * 50), (None, items[2][1]), (103, "x " * 20000 + items[4][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = decontam.leaks(df, bench).collect()
    want = brute(docs, items)
    mine = {(r.doc_id, r.item, r.start) for r in got}
    assert mine == want and len(got) == len(mine)
    rows = decontam.contaminated(df, bench).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[0].contaminated and by[0].best_similarity == 1 and by[None].contaminated and by[103].contaminated
    assert not by[100].contaminated and not by[101].contaminated and not by[4].contaminated and by[4].n_items == 0


def test_simhash_and_probes(spark):
    rng = random.Random(0)
    rows = [(k, rng.getrandbits(63), rng.randint(1, 3)) for k in range(5) for _ in range(9)]
    got = {r.key: r.fp & (2**64 - 1) for r in decontam.simhash(spark.createDataFrame(rows, "key long, h long, weight long"), "key").collect()}
    for k in range(5):
        want = 0
        for b in range(64):
            if sum(w if h >> b & 1 else -w for q, h, w in rows if q == k) > 0:
                want |= 1 << b
        assert got[k] == want
    masks = set(decontam._masks())
    for _ in range(200):  # any 23 bits leave a block with at most two
        x = 0
        for b in rng.sample(range(64), 23):
            x |= 1 << b
        assert any(x >> 8 * i & 255 in masks for i in range(8))


def test_no_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contaminated(docs, none).collect()] == [False]
    assert decontam.contaminated(docs.limit(0), none).count() == 0


def test_by_shuffle_and_repeated_rows(spark, monkeypatch):
    """Without any broadcast the rows are the same; equal rows count once; a text of one word repeated is found at all its starts."""
    items = [(1, "one two three four five six seven"), (2, "a a a a a a a a a a"), (3, "one two three four five six seven")]
    docs = [(1, items[0][1] + " and more"), (1, items[0][1] + " and more"), (2, "a " * 14), (None, items[0][1]), (None, items[0][1]), (4, "one two three four five six")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, w string, k1 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r.doc_id or 0, r.item, r.start, round(r.similarity, 6)) for r in decontam.leaks(df, bench).collect())
    want = [(0, 1, 0, 1.0), (0, 3, 0, 1.0), (1, 1, 0, 1.0), (1, 3, 0, 1.0), *[(2, 2, i, 1.0) for i in range(5)]]
    assert rows() == want
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_large_bags(spark):
    """Counts over 16 bits do not run into each other."""
    bags = spark.createDataFrame([(1, 1, 70_000), (1, 2, 80_000), (1, 4, 10)], "key long, h long, weight long")
    row = decontam.simhash(bags, "key").first()
    assert (row.mass, row.fp) == (150_010, 2)
