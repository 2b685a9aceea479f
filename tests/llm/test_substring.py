import hashlib
import random
import re
from collections import Counter

import pytest

from docfathom.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [3, 8, 35])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    base = [" ".join(rng.choice("a b c dé e f g h".split()) for _ in range(rng.choice([0, 5, 40, 200]))) for _ in range(40)]
    passage = " ".join(f"w{i}" for i in range(window + 3))
    texts = base + base[:5] + [None, "", " \t\n", "x " * 100, passage, "q " + passage + " z", "r\x0b" + passage.replace(" ", "  "), "A " + passage.upper(), "a b " * 50]
    texts += [" ".join(f"u{rng.randint(0, 9**9)}" for _ in range(5000))]
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, kept string").repartition(4)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs, window=window).collect())
    want = Counter((rows[i][0], *x) for i, x in enumerate(brute(texts, window)))
    assert got == want


def test_levels_end_without_candidates(spark, monkeypatch):
    """With no repeated word sequence one pass is made; with one, all levels and the second hash."""
    seen = []
    real = substring.exchange.repeated
    monkeypatch.setattr(substring.exchange, "repeated", lambda sent, name: seen.append(name) or real(sent, name))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{k}" for k in range(50))) for i in range(4)], "doc_id long, text string")
    assert substring.drop_repeats(docs).filter("n_removed > 0").count() == 0 and seen == ["substring-9"]
    seen.clear()
    assert substring.drop_repeats(docs.union(docs)).filter("n_removed = 50").count() == 8
    assert seen == ["substring-9", "substring-18", "substring-35", "substring-35"]


def test_second_hash(spark, monkeypatch):
    """Where the first hash of all windows is the same, the second one still tells them apart."""
    real = substring._Levels._hashes
    monkeypatch.setattr(substring._Levels, "_hashes", lambda self, words, step, seed: real(self, words, step, seed) if seed else real(self, words, step, seed) * 0 + 7)
    levels = substring._Levels(5, ["a"] * 3)
    words = substring.Words(substring.pa.array(["a b c d e f", "g h i j k"]))
    first, second = substring.np.array([7], "u8"), levels._hashes(words, 5, 1)[:1]
    for answers, hashes in zip(levels.answers, [first, first, second], strict=True):
        answers.of = lambda block, h=substring.np.sort(substring.exchange.mix(hashes.copy())): h
    assert levels.alive(words, 0).tolist() == [True] + [False] * 6


def test_empty_and_spans(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.drop_repeats(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d x"), (2, "z a b c d")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring.drop_repeats(docs, window=4).collect()}
    assert got == {1: [(0, 4)], 2: [(1, 5)]}


def test_query_digest(spark):
    from docfathom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for r, (n, k, kept) in zip(docs, brute([r.text for r in docs], 35), strict=True):
        x = got[r.doc_id]
        assert (x.n_words, x.n_removed, x.kept_sha256) == (n, k, hashlib.sha256(kept.encode()).hexdigest())
