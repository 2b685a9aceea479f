import random
import zlib
from collections import defaultdict

import pytest

from docfathom.llm import packing, tokens

T = pytest.importorskip("public_tokenizers")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a document at a time, by looking at every bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 200]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, n = packing.plan(counts, capacity)
    room, used = defaultdict(lambda: capacity), []
    for length, first, bin_, each, offset in runs:
        end = min([r[1] for r in runs if r[0] == length and r[1] > first], default=counts[length])
        for j in range(end - first):
            used.append((bin_ + j // each, offset + j % each * length, length))
            room[bin_ + j // each] -= length
    assert sorted(room.values()) == one_by_one(lengths, capacity) and n == len(room)
    at = defaultdict(int)
    for b, offset, length in sorted(used):
        assert at[b] == offset
        at[b] += length


def test_tree():
    for cap in (1, 5, 64, 100):
        tree, there = packing.CapacityTree(cap), set()
        rng = random.Random(cap)
        for _ in range(300):
            v = rng.randint(0, cap)
            (there.add if (on := rng.random() < 0.3) else there.discard)(v)
            tree.set(v, on)
            q = rng.randint(0, cap)
            assert tree.least_from(q) == min([x for x in there if x >= q], default=None)


def test_words_encode_like_whole_texts():
    e = tokens.WordEncoder(tokens.default_path())
    odd = ["", " ", "It's ΑΣ Straße école x y\x1cz", "a<|endoftext|>b", "don't 12.5 ÀÉİ \U0001f600!!", "x" * 3000, "\t\nA\x0bB\x85c　d​e"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("abcXYZ éÅß'.,1 \n\t́ 日本") for _ in range(80)) for _ in range(200)]
    for text in odd:
        assert list(memoryview(e.encode(text)).cast("I")) == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bird", "sings"]) for _ in range(rng.choice([0, 1, 20, 100, 300])))) for i in range(60)] + [(None, None), (5, "a"), (5, "a")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, block int, rank int").repartition(5)
    got = packing.pack(docs, capacity=64).collect()
    e = tokens.WordEncoder(tokens.default_path())
    full = sorted(e.encode(t or "") + (1).to_bytes(4, "little") for _, t in rows)
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        whole[(r.doc_id, 0)].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.start == 64 * r.piece
    assert sum(r.length for r in got) * 4 == sum(map(len, full))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in rows[:5] + rows[6:60]:
        ids = b"".join(x.ids for x in sorted(whole[(i, 0)], key=lambda x: x.piece))
        assert zlib.crc32(ids) == zlib.crc32(e.encode(t) + (1).to_bytes(4, "little"))
    assert len(seqs) == len(one_by_one([n for r in [r.length for r in got] for n in [r]], 64))
    assert packing.pack(docs.limit(0)).count() == 0


def test_every_sign_below_3000_alone_and_in_words():
    """Capitals may have lower-case letters beyond the range that the fast path knows (U+0181, U+023A ...)."""
    e = tokens.WordEncoder(tokens.default_path())
    for c in range(1, 0x3000):
        for text in (chr(c), f"ab{chr(c)}cd", f"A{chr(c)} '{chr(c)}S 1{chr(c)}", f"x{chr(c)}"):
            assert e.encode(text) == e.entire(text), hex(c)
