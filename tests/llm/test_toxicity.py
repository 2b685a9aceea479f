import random
import time

import numpy as np
import pyarrow as pa
import pytest

from docfathom.llm import toxicity as tox

WORDS = "the of a wonderful idiot stupid moron reading river green horse loser window pathetic tall house every people never always".split()


@pytest.fixture(scope="module")
def decoder():
    rng = random.Random(0)
    text = " ".join(rng.choice(WORDS) for _ in range(20000))
    return tox.Decoder(tox.language_model(tox.gram_counts(pa.array([text, None, ""]))))


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1d10t", "idiot"), ("st00pid", "stoopid"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("s-t-u-p-i-d", "stupid"), ("p4th3t1c", "pathetic"), ("1 d 1 0 t", "idiot"), ("$tup1d", "stupid"), ("looooser", "loser"), ("w1nd0w", "window")],
)
def test_restores(decoder, raw, want):
    text = f"you are an {raw} and more"
    got = dict(decoder.restore(text))
    if want == "stoopid":
        assert got[raw] != raw
    else:
        assert got.get(raw) == want


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        (" ".join("youareastupidpatheticidiotandamoronandaloserandnobodylikesyou"), ["stupid", "pathetic"]),
        ("stu" + "u" * 500 + "pid", ["stupid"]),
        ("-".join(["never"] * 20 + ["1d10t"]), ["idiot"]),
        (".".join("always" * 20 + "stupid"), ["stupid"]),
    ],
)
def test_restores_long_stretches(decoder, raw, found):
    assert len(raw) > 80
    got = "".join(dict(decoder.restore(f"well {raw} .")).get(raw, "").split())
    assert all(w in got for w in found)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("i***t", "idiot"), ("s****d", "stupid"), ("l***r", "loser"), ("p******c", "pathetic"), ("s*t*u*p*i*d", "stupid"), ("i d * o t", "idiot"), ("m * r * n", "moron")],
)
def test_restores_masks(decoder, raw, want):
    assert dict(decoder.restore(f"you are an {raw} and more")).get(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("idio7,", "idiot"), ("1dio7.", "idiot"), ("idio7)", None), ("mor0n!", "moron"), ("idio*", "idiot"), ("stup**", "stupid"), ("lo$er", "loser"), ("o+", None), ("stuupid", "stupid"), ("IdiOooT", "idiot"), ("STuUpid", "stupid"), ("h0r$3333", None), ("$$$$tupid", None)],
)
def test_gate(decoder, raw, want):
    got = dict(decoder.restore(f"you are an {raw} and more"))
    assert raw in got and (want is None or got[raw].strip(" !") == want)


def test_gate_leaves_exclamations(decoder):
    assert decoder.restore("the horse! never!! a moron!") == []


def test_addresses_are_no_words(decoder):
    assert decoder.restore("write to st00pid@river.green.org please") == []
    assert dict(decoder.restore("s.t.@.t.u.p.i.d")) != {}


def test_leaves_plain_text(decoder):
    for text in ("the river is green.", "", "A tall house, never 1999 or 42!", "all good feelings", "b"):
        assert decoder.restore(text) == []


def test_viterbi_is_the_cheapest_path(decoder):
    def brute(raw, apart):
        found = []

        def walk(i, out, cost):
            if i == len(raw):
                total, ctx = cost, (0, 0, 0)
                for ch in out + " ":
                    s = tox.symbol(ch) if ch != " " else 0
                    total += float(decoder.costs[(*ctx, s)])
                    ctx = (*ctx[1:], s) if s else (0, 0, 0)
                found.append((total, out))
                return
            for text, to, price in decoder.edges(raw, i, apart):
                walk(to, out + text, cost + price)

        walk(0, "", 0.0)
        return min(found)

    for raw in ("1d10t", "m00r0n", "l0s3r", "a||l"):
        total, text = brute(raw, False)
        assert decoder._decode(raw) == text


def test_viterbi_keeps_all_states(decoder):
    """Masks of two and three stars under costs without a pattern: the cheapest path is any of them."""

    def cheapest(d, raw):
        best = []

        def walk(i, z, cost, out):
            if i == len(raw):
                best.append((cost + d.flat.item(z, 0), out))
                return
            for text, to, price in d.edges(raw, i, False):
                total, y = cost + price, z
                for ch in text:
                    s = tox.symbol(ch) if ch != " " else 0
                    total, y = total + d.flat.item(y, s), y % 784 * 28 + s if s else 0
                walk(to, y, total, out + text)

        walk(0, 0, 0.0, "")
        return min(best)[1]

    rough = tox.Decoder(np.random.default_rng(3).uniform(0.1, 9.0, (28,) * 4).astype(np.float32))
    for d in (decoder, rough):
        for raw in ("s**t", "st**id", "m**0n", "b**ch", "i1**t", "st***d", "a***e", "st**", "mo***", "lo**r*"):
            assert d._decode(raw) == cheapest(d, raw)


def test_long_runs_of_stars(decoder):
    begin = time.perf_counter()
    assert decoder._decode("st" + "*" * 3000 + "d") == "st d"
    for raw in ("a" + "*" * 200 + "b", "*" * 4000, "a" + "*" * 4000 + "b", "********title********", "a" + "*" * 4000):
        decoder.restore(raw)
    assert time.perf_counter() - begin < 1


@pytest.mark.parametrize(("raw", "want"), [("**Important**", "important"), ("*important*", "important"), ("**stupid", "stupid"), ("important**", "important"), ("***important***", "important"), ("stup**", "stupid"), ("idio*", "idiot")])
def test_emphasis_is_no_mask(decoder, raw, want):
    assert [w for _, w in decoder.restore(raw)] in ([], [want])


def test_masks_under_a_model_of_the_table():
    import duckdb

    table = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").to_arrow_table()
    decoder = tox.Decoder(tox.language_model(sum(tox.gram_counts(c) for c in table.column("text").chunks)))
    for raw, want in (("i***t", "idiot"), ("s****d", "stupid"), ("st***d", "stupid"), ("id**t", "idiot"), ("mo**n", "moron"), ("tr**h", "trash"), ("stup**", "stupid")):
        assert decoder.restore(raw) == [(raw, want)]
    for raw in ("l***r", "p******c", "i****s"):  # whatever the word is, each star is a letter of it
        assert [len(w) for _, w in decoder.restore(raw)] == [len(raw)]


def test_counts():
    got = tox.gram_counts(pa.array(["ab", "é c"]))
    s = tox.SYMBOLS
    code = lambda *x: sum(v * s ** (3 - i) for i, v in enumerate(x))
    want = np.zeros(s**4, int)
    for g in [(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 2, 0), (0, 0, 0, 27), (0, 0, 27, 27), (0, 27, 27, 0), (0, 0, 0, 3), (0, 0, 3, 0)]:
        want[code(*g)] += 1
    assert (got == want).all()


def test_scores(spark):
    rng = random.Random(5)
    clean = [w for w in WORDS if w not in ("idiot", "stupid", "moron", "loser", "pathetic")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(30)]
        if i % 5 == 0:
            words[7] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(i % 5 == 0), None))
    rows += [(1000, "what an 1d10t and m0r0n", "x", 1.0), (1001, "i d i o t", "x", 1.0), (1002, None, None, None), (1003, "", None, None), (None, "idiot", None, None), (7, rows[7][1], "x", 0.5)]
    labels += [(5, None, None), (None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = tox.toxicity(docs, known).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    wrong = sum(by[i].predicted != (i % 5 == 0) for i in range(900))
    assert wrong <= 2
    assert by[1000].predicted == 1 and by[1001].predicted == 1 and by[1002].score == by[1003].score == 0 and by[None].predicted == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(docs, none).collect()} == {0.0}
    assert tox.toxicity(docs.limit(0), known).count() == 0


def test_few_labels_are_calibrated(spark, monkeypatch):
    """With 15 toxic labelled rows the calibration is fitted, too."""
    fitted = []
    monkeypatch.setattr(tox, "fit_logistic", lambda x, y, fit=tox.fit_logistic: fitted.append((len(y), y.sum())) or fit(x, y))
    rng = random.Random(7)
    ids = [r.id for r in spark.range(2000).filter(~tox.held_out("id")).limit(300).collect()]
    rows = [(i, " ".join(rng.choice(["river", "green", "tall", "house", "people"]) for _ in range(12)) + (" idiot" if k < 15 else "") + f" {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(k < 15)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in tox.toxicity(docs, known).collect()}
    assert fitted == [(300, 15.0)] and min(got[i] for i in ids[:15]) > max(got[i] for i in ids[15:])


def test_held_out_accuracy(spark):
    from docfathom.llm.queries import QUERIES

    d = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 500 and hits / len(got) > 0.9


def test_a_token_beyond_letters_apart(decoder):
    """Letters apart may end within a token; what is marked beyond them makes the token one to look at."""
    assert ("c.m0r0n", "c moron") in decoder.restore("a b c.m0r0n e f") or any("moron" in x for _, x in decoder.restore("a b c.m0r0n e f"))
    assert [raw for raw, _ in decoder.restore("you a b c.d e") if raw.startswith("c")] in ([], ["c.d"])


def test_equal_texts_with_different_labels_count_as_toxic(spark):
    rows = [(i, f"{'vile' if i % 3 == 0 else 'nice'} words {i % 50} here") for i in range(600)]
    docs = spark.createDataFrame(rows + [(1000 + i, x) for i, x in rows], "doc_id long, text string")
    labels = [(i, int("vile" in x)) for i, x in rows] + [(1000 + i, 0) for i, _ in rows]
    runs = [tox.toxicity(docs.repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int")).select("doc_id", "score") for n in (1, 7)]
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in runs)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_memo_changes_nothing(monkeypatch):
    costs = tox.language_model(tox.gram_counts(pa.array(["the idiot went home", "a stupid moron sat there", "well hello"] * 20)))
    texts = ["st*pid id1ot hello", "sstupid  m0r0n id1ot m0r0n", "nice HELLO. st*pid"] * 3
    whole = tox.Decoder(costs)
    want = [tox.features(x, whole) for x in texts]
    monkeypatch.setattr(tox, "MEMO_WORDS", 1)
    small = tox.Decoder(costs)
    assert [tox.features(x, small) for x in texts] == want and sum(len(r) for _, r in want) > 9
