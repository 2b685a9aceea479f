"""The store's segments, deletions, log and layouts, and ingestion of many sources at once."""

import json
import os
import random

import pytest

from docfathom.operators import fts
from docfathom.sources import embed, ingest, log, openapi
from docfathom.sources.store import CHUNKS, FOLDERS, SEGMENTS_OF_A_TIER, IndexStore

WORDS = "alpha beta gamma delta pets list make token layer index of the".split()


provider = lambda: embed.HashingProvider(8)  # noqa: E731  (workers get it by value: they cannot import this file)


def bytes_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def rows(spark, given):
    full = [(i, a, "guide", t, c, f"h{c}", None, [float(len(c))] * 8) for i, a, t, c in given]
    return spark.createDataFrame(full, CHUNKS.replace(", created_at string", ""))


def scores(spark, index, stats, queries=("alpha", "beta pets", "list", "snake_case token")):
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return {(r.query_id, r.id): r.score for r in fts.bm25_scores(asked, index, stats).collect()}


def same_as_rebuilt(spark, store, want):
    """Contents are those of a model; index, statistics and ranking those of a store written at once."""
    got = {r.id: (r.api_id, r.title, r.content) for r in store.chunks().collect()}
    assert got == want
    chunks = store.chunks().select("id", "api_id", "type", "title", "content")
    toks = fts.tokenised(chunks)
    key = lambda r: (r.term, r.id)
    cols = ["term", "id", "api_id", "type", "dl", "tf", "positions"]
    assert sorted(store.index().select(cols).collect(), key=key) == sorted(fts.postings(toks).select(cols).collect(), key=key)
    if want:
        assert tuple(store.stats().first()) == tuple(fts.corpus_stats(toks).first())
    mine, whole = scores(spark, store.index(), store.stats()), scores(spark, fts.postings(toks), fts.corpus_stats(toks))
    assert mine.keys() == whole.keys() and all(abs(mine[k] - whole[k]) < 1e-12 for k in mine)


def test_any_order_of_changes_is_a_store_written_at_once(spark):
    rng = random.Random(3)
    store = IndexStore.temporary(spark, 8)
    for a in "xyz":
        store.upsert_api({"id": a, "name": a})
    want = {}
    for step in range(14):
        act = rng.choice(["upsert"] * 4 + ["delete", "drop"])
        if act == "upsert":
            given = {}
            for _ in range(rng.choice([1, 1, 3, 25])):
                a = rng.choice("xyz")
                i = f"{a}:{rng.randrange(40)}"
                given[i] = (i, a, rng.choice(WORDS), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))))
            store.upsert_chunks(rows(spark, given.values()))
            want |= {i: v[1:] for i, v in given.items()}
        elif act == "delete":
            i = rng.choice(sorted(want) or ["x:1"])
            store.delete_chunk(i)
            want.pop(i, None)
        else:
            a = rng.choice("xyz")
            store.delete_chunks_by_api(a)
            want = {i: v for i, v in want.items() if v[0] != a}
        if step % 5 == 4:
            same_as_rebuilt(spark, store, want)
    again = IndexStore(spark, store.path, 8)
    assert again.state == store.state and again.version == store.version
    again.compact(everything=True)
    assert len(again.state["segments"]) <= 1 and not again.state["deletes"] and not again.state["dropped"]
    same_as_rebuilt(spark, again, want)


def test_a_small_change_writes_little(spark):
    store = IndexStore.temporary(spark, 8)
    rng = random.Random(1)
    text = lambda i: " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(150)) + f" {i}"
    parsed = [openapi.chunk(f"s:{i:04d}", "s", "guide", "t", text(i), None, i) for i in range(1500)]
    ingest.merge_chunks(store, "s", parsed, {"id": "s", "name": "s"}, provider)
    whole = bytes_of(store.path)
    for i in range(0, 1500, 100):
        parsed[i] = openapi.chunk(f"s:{i:04d}", "s", "guide", "t", text(i), None, i)
    r = ingest.merge_chunks(store, "s", parsed, {"id": "s", "name": "s"}, provider)
    assert (r.total, r.embedded, r.skipped, r.deleted) == (1500, 15, 1485, 0)
    changed = bytes_of(store.path) - whole
    assert changed < whole / 20 and len(store.state["segments"]) == 2
    before = bytes_of(store.path)
    store.delete_chunk("s:0007")
    assert bytes_of(store.path) - before < 10_000
    assert store.chunk_by_id("s:0007") is None and store.state["stats"]["s"][0] == 1499
    same_as_rebuilt(spark, store, {c["id"]: ("s", "t", c["content"]) for c in parsed if c["id"] != "s:0007"})


def test_readers_keep_their_state(spark):
    store = IndexStore.temporary(spark, 8)
    store.upsert_api({"id": "x", "name": "x"})
    store.upsert_chunks(rows(spark, [("x:1", "x", "a", "one"), ("x:2", "x", "b", "two")]))
    held = store.chunks()
    store.delete_chunk("x:1")
    assert held.count() == 2 and store.chunks().count() == 1
    store.compact(everything=True)
    assert held.count() == 2 and store.chunks().count() == 1
    store.upsert_api({"id": "y", "name": "y"})  # the commit after deletes what the one before took out
    assert len([n for n in os.listdir(store.path) if n.startswith("chunks-")]) == 1


def test_segments_of_one_size_are_merged(spark):
    store = IndexStore.temporary(spark, 8)
    store.upsert_api({"id": "x", "name": "x"})
    want = {}
    for k in range(10):
        given = [(f"x:{k}:{j}", "x", "t", WORDS[(j + k) % 12]) for j in range(20)]
        store.upsert_chunks(rows(spark, given))
        want |= {g[0]: g[1:] for g in given}
        assert len(store.state["segments"]) < 2 * SEGMENTS_OF_A_TIER and len(store.state["deletes"]) <= FOLDERS
    same_as_rebuilt(spark, store, want)


def test_two_writers_at_once(spark, monkeypatch):
    """The second writer commits between all that the first one looks at and the first one's own commit."""
    one = IndexStore.temporary(spark, 8)
    one.upsert_api({"id": "x", "name": "x"})
    two = IndexStore(spark, one.path, 8)
    move = log.CommitLog._move

    def late(self, source, target):
        if self is one.log:
            monkeypatch.setattr(log.CommitLog, "_move", move)
            two.upsert_chunks(rows(spark, [("x:2", "x", "t", "of the second")]))
        move(self, source, target)

    monkeypatch.setattr(log.CommitLog, "_move", late)
    with pytest.raises(RuntimeError, match="another writer"):
        one.upsert_chunks(rows(spark, [("x:1", "x", "t", "of the first")]))
    left = {n for n in os.listdir(one.path) if n.startswith("chunks-")}
    assert len(left) == 1 and one.chunks().count() == 0  # what it had written is gone, its state is as before
    one.refresh()
    one.upsert_chunks(rows(spark, [("x:1", "x", "t", "of the first")]))
    want = {"x:1": ("x", "t", "of the first"), "x:2": ("x", "t", "of the second")}
    for store in (one, IndexStore(spark, one.path, 8)):
        same_as_rebuilt(spark, store, want)
    names = sorted(n for n in os.listdir(os.path.join(one.path, "_log")) if n.endswith(".json"))
    assert names == [f"{k:020d}.json" for k in range(len(names))]


def test_two_makers_of_one_store(spark, tmp_path, monkeypatch):
    load = log.CommitLog.load
    first = IndexStore(spark, str(tmp_path / "s"), 8)
    first.upsert_api({"id": "x", "name": "x"})
    seen = iter([(-1, None, 0)])
    monkeypatch.setattr(log.CommitLog, "load", lambda self: next(seen, None) or load(self))
    assert [a["id"] for a in IndexStore(spark, str(tmp_path / "s"), 8).get_apis()] == ["x"]


def test_checkpoints(spark):
    store = IndexStore.temporary(spark, 8)
    for k in range(log.CHECKPOINT_EVERY + 3):
        store.upsert_api({"id": "x", "name": "x", "version": str(k)})
    folder = os.path.join(store.path, "_log")
    kept = [n for n in os.listdir(folder) if n.endswith(".checkpoint")]
    assert kept
    for n in os.listdir(folder):  # the state does not need what is before a checkpoint
        if n.endswith(".json") and n < max(kept):
            with open(os.path.join(folder, n), "w") as f:
                f.write("{}")
    again = IndexStore(spark, store.path, 8)
    assert again.state == store.state and again.get_apis()[0]["version"] == str(log.CHECKPOINT_EVERY + 2)


def old_store(spark, path, layout):
    """A store as the program of that layout has left it."""
    old = CHUNKS
    given = [("x:1", "x", "guide", "One", "alpha beta pets", "h1", None, "2024-01-01 00:00:00", [1.0] * 8), ("x:2", "x", "guide", "Two", "beta", "h2", None, "2024-01-01 00:00:00", [2.0] * 8), ("y:1", "y", "schema", "Pet", "list of pets", "h3", None, "2024-01-01 00:00:00", [3.0] * 8)]
    state = {"embedding_dimension": 8, "apis": f"{path}/apis-0", "chunks": {}}
    sources = spark.createDataFrame([("x", "x", "1", "/s", None, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("y", "y", None, None, "/d", "2024-01-01 00:00:00", "2024-01-01 00:00:00")], "id string, name string, version string, spec_path string, docs_path string, created_at string, updated_at string")
    sources.coalesce(1).write.parquet(state["apis"])  # without source_hash and spec_content
    for a in "xy":
        own = spark.createDataFrame([g for g in given if g[1] == a], old)
        state["chunks"][a] = f"{path}/chunks-{a}"
        own.write.parquet(state["chunks"][a])
        if layout > 1:
            toks = fts.tokenised(own)
            state.setdefault("postings", {})[a] = f"{path}/postings-{a}"
            fts.postings(toks).write.parquet(state["postings"][a])
            n = toks.agg({"*": "count", "dl": "sum"}).first()
            state.setdefault("stats", {})[a] = [n["count(1)"], n["sum(dl)"]]
    if layout > 2:
        state["spent"] = []
    with open(f"{path}/CURRENT", "w") as f:
        json.dump(state, f)
    return {g[0]: (g[1], g[3], g[4]) for g in given}


@pytest.mark.parametrize("layout", [1, 2, 3])
def test_earlier_layouts(spark, tmp_path, layout):
    path = str(tmp_path)
    want = old_store(spark, path, layout)
    store = IndexStore(spark, path, 8)
    assert store.layout == layout and store.source_hash("x") is None and store.spec_content("x") is None
    same_as_rebuilt(spark, store, want)
    assert [h["chunk"]["id"] for h in store.search("pets", [1.0] * 8)][0] == "x:1"
    assert os.path.exists(f"{path}/CURRENT") and not os.path.exists(f"{path}/_log")  # nothing is written by reading
    store.upsert_chunks(rows(spark, [("x:2", "x", "Two", "gamma"), ("x:3", "x", "Three", "delta")]))
    want |= {"x:2": ("x", "Two", "gamma"), "x:3": ("x", "Three", "delta")}
    assert store.layout == log.LAYOUT and not os.path.exists(f"{path}/CURRENT")
    assert all(s["postings"] for s in store.state["segments"])
    again = IndexStore(spark, path, 8)
    assert again.layout == log.LAYOUT and again.chunk_by_id("x:1")["created_at"] == "2024-01-01 00:00:00"
    same_as_rebuilt(spark, again, want)
    again.delete_chunk("x:1")
    again.delete_chunks_by_api("y")
    again.compact(everything=True)
    same_as_rebuilt(spark, again, {i: v for i, v in want.items() if i in ("x:2", "x:3")})


def test_a_layout_of_the_future(spark, tmp_path):
    IndexStore(spark, str(tmp_path), 8).log.publish(1, {"layout": log.LAYOUT + 1})
    with pytest.raises(RuntimeError, match="knows layouts up to"):
        IndexStore(spark, str(tmp_path), 8)


SPEC = "openapi: 3.0.0\ninfo: {{title: T{0}, version: '1'}}\npaths:\n  /a{0}: {{get: {{summary: Get {0}}}}}\n"


def registry(tmp_path, n):
    out = []
    for i in range(n):
        d = tmp_path / f"d{i}"
        d.mkdir()
        (d / "b.md").write_text(f"# B{i}\n\ntext {i}\n\n## Same\n\n1\n\n## Same\n\n2")
        (d / "a.md").write_text(f"# A{i}\r\n\r\nmore {i}")
        (d / "skipped.txt").write_text("no")
        (d / "sub").mkdir()
        (d / "sub" / "deeper.md").write_text("# Deeper")
        if i % 2:
            out.append(ingest.Source(f"s{i}", None, str(d)))
        else:
            (tmp_path / f"s{i}.yml").write_text(SPEC.format(i))
            out.append(ingest.Source(f"s{i}", str(tmp_path / f"s{i}.yml"), str(d)))
    return out


def jobs(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("rest", "")
    return out, n


def told(r):
    return (r.total, r.embedded, r.skipped, r.deleted, r.unchanged)


def test_a_registry_is_one_job(spark, tmp_path):
    sources = registry(tmp_path, 200)
    sources[3:3] = [ingest.Source("gone", str(tmp_path / "none.yml")), ingest.Source("nodocs", None, str(tmp_path / "none"))]
    (tmp_path / "bad.yml").write_text("swagger: '2.0'")
    sources.insert(50, ingest.Source("bad", str(tmp_path / "bad.yml"), str(tmp_path / "d1")))
    one, few = IndexStore.temporary(spark, 8), IndexStore.temporary(spark, 8)
    done, n = jobs(spark, lambda: ingest.ingest_sources(one, sources, make=provider))
    _, m = jobs(spark, lambda: ingest.ingest_sources(few, sources[:3], make=provider))
    assert n <= m + 8  # as many for two hundred as for three, but for the listing of many folders
    by = {r.api: r for r in done}
    assert [r.api for r in done] == [s.name for s in sources]
    assert {a for a, r in by.items() if r.error} == {"gone", "nodocs", "bad"}
    assert isinstance(by["gone"].error, FileNotFoundError) and str(by["nodocs"].error) == f"docs path does not exist: {tmp_path}/none"
    assert "is not OpenAPI 3.x (found: 2.0)" in str(by["bad"].error) and "Traceback" in by["bad"].trace
    assert told(by["s1"]) == (4, 4, 0, 0, False) and told(by["s0"]) == (6, 6, 0, 0, False)
    assert one.version <= 2 and one.chunks().count() == 100 * (3 + 5)
    assert one.chunks_by_api(ingest.source_id("s1")).filter("id LIKE '%/same'").first().content == "2"
    assert one.spec_content("s0") == SPEC.format(0)
    api = next(a for a in one.get_apis() if a["name"] == "s0")
    assert api["spec_path"] == str(tmp_path / "s0.yml") and api["docs_path"] == str(tmp_path / "d0")
    # the same as reading the source on the driver
    import hashlib

    from docfathom.sources import markdown

    digest = hashlib.sha256(SPEC.format(0).encode() + b"a.md" + (tmp_path / "d0" / "a.md").read_bytes() + b"b.md" + (tmp_path / "d0" / "b.md").read_bytes()).hexdigest()
    assert one.source_hash(ingest.source_id("s0")) == digest == ingest.source_hash(one, sources[0])
    i = ingest.source_id("s0")
    here = openapi.parse_openapi_file(sources[0].spec, i) + markdown.parse_markdown_dir(sources[0].docs, i)
    last = {c["id"]: (c["title"], c["content"], c["metadata"]) for c in here}
    assert {r.id: (r.title, r.content, r.metadata) for r in one.chunks_by_api(i).collect()} == last

    (tmp_path / "d1" / "b.md").write_text("# B1\n\nother")
    again = {r.api: r for r in ingest.ingest_sources(one, sources, make=provider)}
    assert told(again["s1"]) == (2, 1, 1, 1, False) and sum(r.unchanged for r in again.values()) == 199
    forced = {r.api: r for r in ingest.ingest_sources(one, sources, force=True, make=provider)}
    assert told(forced["s0"]) == (6, 1, 5, 0, False)  # of two chunks with one id the first is not what is stored
    assert told(forced["s1"]) == (2, 0, 2, 0, False) and sum(bool(r.error) for r in forced.values()) == 3


def test_a_provider_that_fails_for_one_source(spark, tmp_path):
    class Picky(embed.HashingProvider):
        def embed_documents(self, texts):
            if any("text 1" in t for t in texts):
                raise ValueError("down")
            return super().embed_documents(texts)

    sources = registry(tmp_path, 4)
    store = IndexStore.temporary(spark, 8)
    by = {r.api: r for r in ingest.ingest_sources(store, sources, make=lambda: Picky(8))}
    assert {a for a, r in by.items() if r.error} == {"s1"} and "down" in str(by["s1"].error) and "Traceback" in by["s1"].trace
    assert {a["name"] for a in store.get_apis()} == {"s0", "s2", "s3"} and store.chunks([ingest.source_id("s1")]).count() == 0
    assert told(ingest.ingest_docs(store, "s1", sources[1].docs, make=provider)) == (4, 4, 0, 0, False)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    store = IndexStore.temporary(spark, 8)
    assert told(ingest.ingest_docs(store, "e", str(tmp_path / "e"), make=provider)) == (0, 0, 0, 0, False)
    assert told(ingest.ingest_docs(store, "e", str(tmp_path / "e"), make=provider)) == (0, 0, 0, 0, True)
