import pathlib
import random

import corpus_pipeline as cp
from docfathom.llm.shared import owner, shared_dir
from docfathom.llm.tokens import default_path, encoder


def test_stages_on_planted_cases(spark, tmp_path):
    """Each stage against what was planted for it; clean documents pass all stages unchanged."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    make = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, make(120)) for i in range(300)]
    toxic = [(1000 + i, make(40) + " zugarot stoopnik " + make(40)) for i in range(120)]
    near = [(2000 + i, clean[i][1] + " " + word()) for i in range(20)] + [(2100 + i, clean[50][1]) for i in range(5)]
    passage = make(60)
    repeats = [(3000 + i, make(60) + "  " + passage + "\n" + make(60)) for i in range(8)]
    items = [(i, make(40)) for i in range(6)]
    leaks = [(4000 + i, make(70) + " " + items[i][1].upper() + " " + make(70)) for i in range(6)]
    odd = [(None, None), (None, None), (5001, ""), (5002, make(3)), (5003, make(30000)), (7, clean[7][1])]
    rows = clean + toxic + near + repeats + leaks + odd
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, uid int")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name, step in cp.STAGES:
        step(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        got[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda name: [r.doc_id for r in got[name]]
    assert not {i for i, _ in toxic} & set(ids("toxicity")) and len(ids("toxicity")) == len(rows) - len(toxic)
    kept = ids("near_dedup")
    for i in range(20):
        assert (i in kept) + (2000 + i in kept) == 1
    assert sum(i in kept for i in [50, *range(2100, 2105)]) == 1 and kept.count(7) + kept.count(2007) == 1 and kept.count(None) == 2
    text = {r.doc_id: r for r in got["substring_dedup"]}
    whole = dict(rows)
    for i, _ in repeats:
        assert passage not in text[i].text and text[i].n_chars == len(text[i].text) and len(text[i].text.split()) == 120
    assert all(text[i].text == whole[i] for i in range(20, 300) if i in text)
    assert set(ids("decontamination")) == set(ids("substring_dedup")) - {i for i, _ in leaks}
    assert len(ids("decontamination")) == len(ids("substring_dedup")) - len(leaks)
    e = encoder(default_path())
    last = {r.doc_id: r for r in got["decontamination"]}
    some = [r for r in got["packing"] if r.doc_id in last and r.doc_id is not None and r.piece == 0]
    assert {r.doc_id for r in got["packing"]} == set(last)
    for r in some[:50]:
        assert bytes(r.ids) == (e.encode(last[r.doc_id].text or "") + (1).to_bytes(4, "little"))[: 4 * 4096]


def test_run(spark):
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "docfathom"
    before = set(folder.glob("*"))
    with owner(spark) as made:
        assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
        left = {p.name.split("-")[0] for p in set(folder.glob("*")) - before}
        assert len(made) > 30 and 0 < len(left) < 6 and not left & {"pipeline", "sketches", "neardup", "substring", "windows", "leaks"}
    assert set(folder.glob("*")) == before
