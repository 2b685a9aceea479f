import random

import numpy as np
import pytest

from docfathom.llm import materialise as m
from docfathom.llm import shared, tokens

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 4095, 4097, 70000])
def test_permutation(n):
    a, b = m.permute(np.arange(n), n, 1), m.permute(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n))
    assert n < 20 or (a != b).any() and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.35


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "stars and"]) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(300)] + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    folder = shared.new_path(spark, "shards")
    index = m.materialise(docs, folder, size=32, per_shard=50)
    got = sorted(m.read_shards(spark, folder, index, 32).collect(), key=lambda r: r.slot)
    n = len(got)
    assert [r.slot for r in got] == list(range(n))
    back = np.argsort(m.permute(np.arange(n), n, 20240229)[np.arange(n)])
    by_number = {int(i): got[s] for s, i in enumerate(back)}
    stream = np.concatenate([np.frombuffer(by_number[i].ids, np.uint16) for i in range(n)])
    e = tokens.encoder(tokens.default_path())
    own = np.split(stream, np.flatnonzero(stream == 1) + 1)[:-1]
    want = sorted(np.frombuffer(e.encode(t or ""), np.uint32).tolist() + [1] for _, t in rows)
    assert sorted(x.tolist() for x in own) == want
    text = {i: t for i, t in rows}
    for r in got[:40]:
        if r.doc_id is not None:
            ids = np.frombuffer(e.encode(text[r.doc_id]), np.uint32).tolist() + [1]
            mine = np.frombuffer(r.ids, np.uint16).tolist()
            k = min(len(ids) - r.start, len(mine))
            assert mine[:k] == ids[r.start :][:k]
    for slot in (0, 49, 50, n - 3, n):
        assert [r["ids"] for r in m.read_from(folder, slot, 50, 32)] == [bytes(r.ids) for r in got[slot:]]
    assert m.materialise(docs.limit(0), shared.new_path(spark, "shards")).count() == 0


def permute_plainly(i, n, key):
    """The network written out for one number: six rounds on two halves, walked on until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, full = (1 << half) - 1, (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    keys = [mixed((r + key * 0x9E3779B97F4A7C15) & full) for r in range(1, m.ROUNDS + 1)]
    while True:
        left, right = i >> half, i & low
        for k in keys:
            left, right = right, left ^ mixed(right ^ k) & low
        i = left << half | right
        if i < n:
            return i


def test_shards_against_brute_force(spark):
    """The whole shards, byte for byte, written by a plain loop over the texts of one partition."""
    import struct
    import zlib

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["sun", "moon", "stars and"]) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    folder = shared.new_path(spark, "shards")
    m.materialise(docs, folder, size=32, key=99, per_shard=40)
    e, stream = tokens.encoder(tokens.default_path()), []
    for i, t in enumerate(texts):
        ids = [*np.frombuffer(e.entire(t), np.uint32).tolist(), 1]
        stream += [(i, k, x) for k, x in enumerate(ids)]
    records = [stream[a : a + 32] for a in range(0, len(stream), 32)]
    slots = {permute_plainly(i, len(records), 99): r for i, r in enumerate(records)}
    assert sorted(slots) == list(range(len(records)))
    system, root = shared.filesystem(folder)
    for first in range(0, len(records), 40):
        want = b""
        for slot in range(first, min(first + 40, len(records))):
            r = slots[slot]
            ids = struct.pack(f"<{len(r)}H", *[x for _, _, x in r])
            want += struct.pack("<qqII", r[0][0], r[0][1], len(r), zlib.crc32(ids)) + ids.ljust(64, b"\0")
        with system.open_input_file(f"{root}/shard-{first // 40:08d}.bin") as f:
            assert f.read() == want


def test_ids_that_do_not_fit_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="16 bits"):
        m.materialise(docs, shared.new_path(spark, "shards"), end_id=1 << 16)


def test_read_back_is_spread(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text").repartition(4)
    folder = shared.new_path(spark, "shards")
    index = m.materialise(docs, folder, size=32, per_shard=50)
    monkeypatch.setattr(m, "READ_BYTES", 1 << 14)
    back = m.read_shards(spark, folder, index, 32)
    assert back.rdd.getNumPartitions() > 3
