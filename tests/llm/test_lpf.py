import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docfathom.llm import lpf


def brute_lpf(text, starts):
    out = []
    for i in starts:
        best = 0
        for j in starts:
            if j < i:
                k = 0
                while i + k < len(text) and text[j + k] == text[i + k] and k < 255:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_factors(seed):
    rng = random.Random(seed)
    alphabet = [b"ab", b"a", b"abcd\x00"][seed % 3]
    text = bytes(rng.choice(alphabet) for _ in range(300))
    text = text + text[20:270] + b"zz" + text[:100]
    starts = np.array(sorted(rng.sample(range(len(text)), 300)))
    length, source = lpf.longest_previous_factors(np.frombuffer(text, np.uint8), starts)
    assert length.tolist() == brute_lpf(text, starts.tolist())
    for i, n, s in zip(starts, length, source, strict=True):
        assert n == 0 or s < i and text[s : s + n] == text[i : i + n]


def test_smaller_before():
    rng = random.Random(1)
    for n in (0, 1, 2, 50):
        v = np.array(rng.sample(range(1000), n), int)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert lpf.smaller_before(v).tolist() == want


def brute(texts, window, keep_first=False):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    met, out = set(), []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            if seen[w] > 1 and not (keep_first and w not in met):
                gone[i : i + window] = b"\1" * window
            met.add(w)
        spans = bytes(gone).split(b"\0")
        out.append((len(t), sum(gone), sum(bool(s) for s in spans), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéö ") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    base = [make(rng.choice([0, 3, 30, 120])) for _ in range(25)]
    passage, line = make(45), make(17)
    texts = [*base, *base[:4], None, "", "x" * 900, "ab" * 300, passage, "q" + passage + make(9), make(20) + passage, passage[3:]]
    texts += [make(12) + line + make(12) for _ in range(25)]
    texts += [base[7][:90] + make(40) + base[8][100:], "é" * 400, make(2500) + passage]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("keep_first", "hot"), [(False, False), (True, False), (False, True)])
def test_against_brute_force(spark, keep_first, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(lpf, "HOT_PIECES", 1)
    texts = corpus(9)
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, block int, uid int").coalesce(1)
    if not keep_first:
        docs = docs.repartition(4)
    got = defaultdict(list)
    for r in lpf.drop_repeated_bytes(docs, window=128, keep_first=keep_first).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)))
    want = brute(texts, 128, keep_first)
    for i in range(len(texts)):
        assert got[i if i != 5 else None] == [want[i]], i


def test_empty(spark):
    assert lpf.drop_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    import hashlib

    from docfathom.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op7_lpf_dedup"](spark, "/root/testdata/sf0.001").collect()}
    for d, (n, k, spans, kept) in zip(docs, brute([d.text for d in docs], 200), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, k, spans, hashlib.sha256(kept).hexdigest())


def test_a_window_in_very_many_pieces_is_one_row(spark, monkeypatch):
    """Hot windows are counted, not gathered; results are those of brute force, with and without their first places."""
    rng = random.Random(9)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n)).decode()
    hot = word(260)
    texts = [word(40) + hot + word(30) for _ in range(300)] + [hot, hot[:230], hot[20:] + word(50), word(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    results = []
    for least in (10, 10**9):
        monkeypatch.setattr(lpf, "HOT_PIECES", least)
        for keep in (False, True):
            out = lpf.drop_repeated_bytes(df, window=200, keep_first=keep).collect()
            results.append(sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in out))
    assert results[0] == results[2] and sum(r[1] for r in results[1]) == sum(r[1] for r in results[3])
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - 199):
            seen.setdefault(t[a : a + 200], []).append((i, a))
    for i, n, kept in results[0]:
        gone = {a + j for s, places in seen.items() if len(places) > 1 for k, a in places if k == i for j in range(200)}
        assert n == len(gone) and kept == bytes(b for j, b in enumerate(texts[i].encode()) if j not in gone)
    single = spark.range(100_000).selectExpr("cast(id % 7 as int) block", "id piece", "id uid", "0L start", "3 shift", "1 n", "'same' same")
    plan = lpf._same_windows(single)
    sums = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(same" in line]
    assert plan.count() == 100_000 and plan.filter("size(old) = 0").count() == 1 and not sums
