import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docfathom.llm import neardup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (ident, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((ident, len(sets[i]), comp, ident == comp if ident is not None and comp is not None else comp is None))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    make = lambda n: [word() for _ in range(n)]
    texts = []
    for n in (3, 5, 30, 60, 120, 200):
        base = make(n)
        texts.append(" ".join(base))
        for _ in range(12):  # a chain of small changes: links reach further than pairs
            base = list(base)
            base[rng.randrange(n)] = word()
            texts.append("\n".join(base) if rng.random() < 0.5 else " ".join(base).upper())
    passage = make(40)
    texts += [" ".join(make(20) + passage + make(15)) for _ in range(40)]
    texts += [texts[20]] * 6 + ["", None, " \t ", "one", "One", "one two", "É é x y z w", "é é x y z w", "a " * 400]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i if i != 3 else None, t) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("percent", "chunk"), [(85, 500), (80, 3)])
def test_against_brute_force(spark, percent, chunk, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = corpus(percent)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, uid int").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, percent=percent).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(brute(rows, percent), key=order)


def test_one_of_each(spark):
    rows = [*corpus(4), (900, "one two three four five six"), (900, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = nd.one_of_each(docs).collect()
    comps = brute(rows, 80)
    groups = {c[2] for c in comps if c[1]}
    empty = sum(not c[1] for c in comps)
    assert len(got) == len(groups) + empty and got[0].__fields__ == ["doc_id", "text", "source"]
    assert len(nd.one_of_each(docs.limit(0)).collect()) == 0


def test_sketch_concentrates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 3000):
        for similarity in (0.5, 0.85):
            errors = []
            for _ in range(40 if n < 3000 else 8):
                common = int(n * 2 * similarity / (1 + similarity))
                a = rng.integers(0, 2**63, n, np.uint64)
                b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common, np.uint64)])
                s = nd.sketch(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n]))
                assert (s != np.uint64(2**64 - 1)).all()
                errors.append((s[0] == s[1]).mean() - common / (2 * n - common))
            assert abs(np.mean(errors)) < 0.06


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "x", "A B c d e f", "", None, "x y", "q a b c d e f"]
    value, bounds = nd.shingle_sets(pa.array(texts))
    for i, t in enumerate(texts):
        alone, own = nd.shingle_sets(pa.array([t]))
        assert alone.tolist() == value[bounds[i] : bounds[i + 1]].tolist() and own[-1] == len(shingles(t))


def test_signature_tells_buckets_apart(spark):
    """Buckets of three with the same ends whose middle members agree in a short hash."""
    from pyspark.sql import functions as F

    from docfathom.llm import neardup

    short = spark.range(1, 5000).groupBy((F.xxhash64("id") % 1000003).alias("short")).agg(F.collect_list("id").alias("ids")).filter("size(ids) > 1").collect()
    assert short
    rows = [(2 * k + j, uid) for k, r in enumerate(short) for j in (0, 1) for uid in (0, r.ids[j], 9999)]
    got = spark.createDataFrame(rows, "h long, uid long").groupBy("h").agg(neardup.signature("uid").alias("sig")).collect()
    assert len({r.sig for r in got}) == len({(r.ids[j]) for r in short for j in (0, 1)})


def test_components_of_stars_and_chains(spark):
    """One vertex with nearly all links, a long chain, and pairs, against a plain union."""
    rng = random.Random(9)
    links = [(0, i) for i in range(1, 3000)] + [(i + 1, i) for i in range(4000, 4060)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = nd.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.v: r.label for r in got.collect()} == {v: root(v) for v in {x for pair in links for x in pair}}
