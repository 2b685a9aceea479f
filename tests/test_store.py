import json
import sqlite3

import numpy as np
import pytest

from docfathom import cli
from docfathom.functions import text as T
from docfathom.operators import fts
from docfathom.operators.hybrid import SearchOptions
from docfathom.sources import embed, ingest, openapi, tools
from docfathom.sources.store import CHUNKS, FOLDERS, IndexStore

SPEC = """openapi: 3.0.0
info: {title: Pay, version: "1"}
paths:
  /pay: {get: {summary: List payments}, post: {summary: Make a payment}}
  /refund: {post: {summary: Refund}}
"""


@pytest.fixture
def hashing():
    embed.set_provider(embed.HashingProvider(16))
    yield
    embed.reset_provider()
    IndexStore.close()


def make(spark, rows):
    full = [(i, a, k, t, c, f"h{i}", m, v) for i, a, k, t, c, m, v in rows]
    return spark.createDataFrame(full, CHUNKS.replace(", created_at string", ""))


@pytest.fixture
def seeded(spark):
    store = IndexStore.temporary(spark, 3)
    for name, spec, version, content in (("petstore", "/p", "1.0.0", "openapi: raw"), ("payments", "/q", None, None), ("arch", None, None, None), ("guides", None, None, None)):
        store.upsert_api({"id": name, "name": name, "spec_path": spec, "version": version, "spec_content": content})
    meta = json.dumps({"method": "get", "path": "/pets"})
    store.upsert_chunks(
        make(
            spark,
            [
                ("c1", "petstore", "endpoint", "GET /pets", "List all pets", meta, [0.1, 0.2, 0.3]),
                ("c2", "petstore", "endpoint", "Other", "Make a pet", None, [0.2, 0.3, 0.4]),
                ("c3", "petstore", "overview", "Overview", "About pets", None, [0.3, 0.4, 0.5]),
                ("a1", "arch", "guide", "Layers", "The layers of snake_case code", None, [0.4, 0.5, 0.6]),
                ("a2", "arch", "glossary", "Word", "A word", None, [0.5, 0.6, 0.7]),
                ("g1", "guides", "guide", "How", "How to begin", None, [0.6, 0.7, 0.8]),
            ],
        )
    )
    return store


def test_store(spark, seeded, tmp_path):
    assert [a["name"] for a in seeded.get_apis()] == ["arch", "guides", "payments", "petstore"]
    assert "source_hash" not in seeded.get_apis()[0]
    assert [r.id for r in seeded.chunks_by_api("petstore", "endpoint").collect()] == ["c1", "c2"]
    assert seeded.chunk_by_id("c1")["metadata"] == {"method": "get", "path": "/pets"} and seeded.chunk_by_id("zz") is None
    assert {c["id"] for c in seeded.chunks_by_ids(["c1", "g1", "zz"])} == {"c1", "g1"} and seeded.chunks_by_ids([]) == []
    before = seeded.chunk_by_id("c2")["created_at"]
    old = seeded.chunks()
    seeded.upsert_chunks(make(spark, [("c2", "arch", "schema", "New", "New text", "{}", [1.0, 1.0, 1.0])]))
    got = seeded.chunk_by_id("c2")
    assert (got["api_id"], got["title"], got["created_at"]) == ("petstore", "New", before)
    assert old.filter("id = 'c2'").first().title == "Other"  # a reader keeps its snapshot
    seeded.delete_chunk("c2")
    seeded.delete_chunks_by_api("arch")
    assert {r.id for r in seeded.chunks().collect()} == {"c1", "c3", "g1"}
    again = IndexStore(spark, seeded.path, 3)
    assert again.chunks().count() == 3 and again.spec_content("petstore") == "openapi: raw"
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        seeded.upsert_chunks(make(spark, [("n", "nobody", "guide", "", "", None, None)]))
    with pytest.raises(ValueError, match="UNIQUE"):
        seeded.upsert_api({"id": "other", "name": "arch"})


def test_dimensions_and_singleton(spark, tmp_path):
    with pytest.raises(ValueError, match="database has 8d vectors but provider requires 4d. Re-index with: "):
        IndexStore(spark, IndexStore.temporary(spark, 8).path, 4)
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError, match=f"Invalid embedding dimension: {bad}"):
            IndexStore(spark, str(tmp_path / "x"), bad)
    a = IndexStore.open(spark, str(tmp_path / "a"), 4)
    assert IndexStore.open(spark, str(tmp_path / "a"), 4) is a
    with pytest.raises(RuntimeError, match="Call closeDb.. first"):
        IndexStore.open(spark, str(tmp_path / "b"), 4)
    IndexStore.close()
    IndexStore.close()
    assert IndexStore.open(spark, str(tmp_path / "b"), 4) is not a
    IndexStore.close()


def test_corrupt_rows(spark, seeded):
    seeded.upsert_chunks(make(spark, [("m", "arch", "guide", "", "x", "{bad", None), ("t", "arch", "nokind", "", "x", None, None)]))
    with pytest.raises(ValueError, match='Corrupted metadata JSON in chunk "m"'):
        seeded.chunk_by_id("m")
    with pytest.raises(ValueError, match='Invalid chunk type "nokind" in chunk "t"'):
        seeded.chunk_by_id("t")


def test_hybrid(seeded):
    ids = lambda **o: [h["chunk"]["id"] for h in seeded.search(o.pop("q", "pets"), o.pop("v", [0.1, 0.2, 0.3]), SearchOptions(**o))]
    assert ids()[0] == "c1" and len(ids()) == 6
    assert set(ids(api_id="arch")) == {"a1", "a2"} and set(ids(api_id="arch", api_ids=["guides"])) == {"a1", "a2", "g1"}
    assert set(ids(types=["guide"])) == {"a1", "g1"} and len(ids(types=[], api_ids=[])) == 6
    assert len(ids(limit=2)) == 2
    assert ids(q="\" ' * ( )")[0] == "c1" and ids(q="user's (data)")
    assert ids(q="snake_case", v=[0.6, 0.7, 0.8])[0] == "a1"


def test_bm25_like_sqlite(spark):
    rng = np.random.default_rng(0)
    words = "alpha beta gamma délta snake_case v1.2 the of pets Straße x-y".split()
    rows = [(f"k{i:03d}", " ".join(rng.choice(words, rng.integers(0, 4))), " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, content)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    chunks = spark.createDataFrame([(i, "a", "guide", t, c) for i, t, c in rows], "id string, api_id string, type string, title string, content string")
    toks = fts.tokenised(chunks).cache()
    index, stats = fts.postings(toks).cache(), fts.corpus_stats(toks)
    queries = ["alpha", "delta pets", "snake_case", "v1.2 beta", "alpha alpha", "of the ?", "?", "missing alpha", "x-y (gamma)", "STRASSE straße"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {}
    for r in fts.bm25_scores(asked, index, stats).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    for n, q in enumerate(queries):
        match = " ".join(f'"{w}"' for w in T.sanitize_query(q))
        want = {i: -s for i, s in db.execute("SELECT id, rank FROM f WHERE f MATCH ?", (match,))}
        mine = got.get(n, {})
        assert mine.keys() == want.keys(), q
        assert all(abs(mine[i] - want[i]) < 1e-9 for i in want), q


def test_tools(seeded, hashing, monkeypatch):
    monkeypatch.setattr(embed, "embed_query", lambda _: [0.1, 0.2, 0.3])
    assert tools.list_apis(seeded).text == "## Indexed APIs\n\n- **arch**\n- **guides**\n- **payments**\n- **petstore** (v1.0.0)"
    found = tools.search_api_docs(seeded, "pets")
    assert found.text.startswith("## Search Results\n\n### GET /pets\n`endpoint` · petstore\n\nList all pets\n\n---\n\n### ") and not found.is_error
    assert tools.search_api_docs(seeded, "x", "nope") == tools.ToolResult('API "nope" not found.', True)
    assert "petstore" not in tools.search_docs(seeded, "pets").text
    assert tools.search_docs(seeded, "x", "nope").text == 'Doc source "nope" not found. Available: arch, guides'
    assert tools.search_docs(seeded, "x", "guides", ["endpoint"]).text == "No results found for your query."
    assert tools.get_api_endpoints(seeded, "petstore").text == "## petstore Endpoints\n\n- **GET** `/pets` — GET /pets\n- Other"
    assert tools.get_api_endpoints(seeded, "payments").text == 'No endpoints found for "payments".'
    assert tools.get_api_spec(seeded, "petstore").text == "openapi: raw"
    assert tools.get_api_spec(seeded, "payments") == tools.ToolResult('No spec content stored for "payments".', True)
    empty = IndexStore.temporary(seeded.spark, 3)
    assert tools.list_apis(empty).text == "No APIs indexed yet." and tools.search_docs(empty, "x").is_error
    out = []
    ask = lambda i, m, **p: json.dumps({"id": i, "method": m, "params": p})
    tools.serve(seeded, [ask(1, "tools/list"), ask(2, "tools/call", name="get-api-spec", arguments={"apiName": "petstore"}), ask(3, "nope")], out.append)
    got = [json.loads(x) for x in out]
    assert [t["name"] for t in got[0]["result"]["tools"]] == list(tools.TOOLS) and got[1]["result"] == {"content": [{"type": "text", "text": "openapi: raw"}]} and "error" in got[2]


def test_incremental_ingest(spark, hashing, tmp_path):
    spec, docs = tmp_path / "s.yml", tmp_path / "docs"
    docs.mkdir()
    spec.write_text(SPEC)
    (docs / "a.md").write_text("# A\n\nintro\n\n## B\n\ntext")
    store = IndexStore.temporary(spark, 16)
    told = lambda r: (r.total, r.embedded, r.skipped, r.deleted, r.unchanged)
    run = lambda **o: told(ingest.ingest_api(store, "pay", str(spec), str(docs), **o))
    assert run() == (6, 6, 0, 0, False)
    assert run() == (0, 0, 0, 0, True)
    assert run(force=True) == (6, 0, 6, 0, False)
    spec.write_text(SPEC.replace("  /refund: {post: {summary: Refund}}\n", "").replace("List payments", "List all"))
    assert run() == (5, 1, 4, 1, False)
    assert store.chunks().count() == 5 and store.chunks().filter("embedding IS NULL").count() == 0
    with pytest.raises(ValueError, match="docs path does not exist: "):
        ingest.ingest_docs(store, "d", str(tmp_path / "none"))
    (docs / "b.md").write_text("# X\n## S\n1\n## S\n2")
    assert told(ingest.ingest_docs(store, "d", str(docs))) == (4, 4, 0, 0, False)
    assert store.chunks_by_api(ingest.source_id("d")).filter("id LIKE '%/s'").first().content == "2"

    files = spark.createDataFrame([("/x/one.md", "# One\n\na\n\n## Two\n\nb"), ("/x/two.md", "# Three\n\nc")], "path string, content string")
    assert told(ingest.ingest_files(store, "frame", files)) == (3, 3, 0, 0, False)
    assert told(ingest.ingest_files(store, "frame", files.limit(1))) == (2, 0, 2, 1, False)

    class Counting(embed.HashingProvider):
        def embed_documents(self, texts):
            with open(tmp_path / "calls", "a") as f:
                f.write("x" * len(texts))
            return super().embed_documents(texts)

    ingest.ingest_files(store, "counted", files, lambda: Counting(16))
    assert (tmp_path / "calls").read_text() == "xxx"  # each chunk once

    class Broken:
        dimension = 16

        def embed_documents(self, texts):
            raise ValueError("down")

    state = store.state
    (docs / "c.md").write_text("# Y\nnew")
    with pytest.raises(Exception, match="down"):
        ingest.ingest_docs(store, "d", str(docs), make=Broken)
    assert store.state == state


def test_cli(spark, hashing, tmp_path, monkeypatch):
    monkeypatch.setenv("DOCFATHOM_DB_PATH", str(tmp_path / "index"))
    (tmp_path / "s.yml").write_text(SPEC)
    out, err = [], []
    with pytest.raises(cli.CliError, match="provide --api and --spec, or --all"):
        cli.run(spark, api="x")
    with pytest.raises(cli.CliError, match="registry not found: "):
        cli.run(spark, all_entries=True, registry=str(tmp_path / "none.yml"))
    (tmp_path / "r.yml").write_text("apis: [{name: good, spec: s.yml}, {name: bad, spec: no.yml}]")
    assert cli.run(spark, all_entries=True, registry=str(tmp_path / "r.yml"), out=out.append, err=err.append) == 1
    assert out[0] == "Ingesting good..." and out[1].startswith("  4 chunks: 4 embedded, 0 skipped, 0 deleted (") and err[0].startswith("  Error ingesting bad: ")
    assert out[-1].startswith("\nDone. 1 entry processed, 4 chunks (4 embedded, 0 skipped, 0 deleted), 1 failed in ")
    (tmp_path / "r.yml").write_text("apis: []")
    assert cli.run(spark, all_entries=True, registry=str(tmp_path / "r.yml"), out=out.append) == 0 and "Done. 0 entries processed" in out[-1]
    assert cli.run(spark, api="good", spec=str(tmp_path / "s.yml"), out=out.append) == 0 and out[-2:] == ["  unchanged, skipping", "Done in 0ms."]


def test_nothing_changed_writes_no_chunks(spark):
    store = IndexStore.temporary(spark, 64)
    parsed = [openapi.chunk(f"s:{i}", "s", "guide", "t", f"text {i}", None, i) for i in range(5)]
    make = lambda: embed.HashingProvider(64)
    ingest.merge_chunks(store, "s", parsed, {"id": "s", "name": "s", "source_hash": "1"}, make)
    before = {k: store.state[k] for k in ("segments", "deletes", "stats")}
    again = ingest.merge_chunks(store, "s", parsed, {"id": "s", "name": "s", "source_hash": "2"}, make)
    assert (again.total, again.embedded, again.skipped, again.deleted) == (5, 0, 5, 0)
    assert {k: store.state[k] for k in before} == before and store.source_hash("s") == "2"
    fewer = ingest.merge_chunks(store, "s", parsed[1:], {"id": "s", "name": "s"}, make)
    assert fewer.deleted == 1 and store.state["segments"] == before["segments"] and len(store.state["deletes"]) == 1 and store.chunks().count() == 4


def test_two_writers_and_spent_snapshots(spark):
    import os

    one = IndexStore.temporary(spark, 64)
    two = IndexStore(spark, one.path, 64)
    one.upsert_api({"id": "a", "name": "a"})
    with pytest.raises(RuntimeError, match="another writer"):
        two.upsert_api({"id": "b", "name": "b"})
    assert two.get_apis() == []
    two.refresh()
    two.upsert_api({"id": "b", "name": "b"})
    assert [a["name"] for a in two.get_apis()] == ["a", "b"]
    for i in range(20):
        two.upsert_api({"id": "b", "name": "b", "version": str(i)})
    assert [(a["name"], a["version"]) for a in two.get_apis()] == [("a", None), ("b", "19")]
    assert len([x for x in os.listdir(one.path) if x.startswith("sources-")]) <= 2 * FOLDERS  # the current ones, and those of the state before


def test_tool_schemas_and_wrong_arguments(seeded):
    out = []
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    call = lambda i, name, **given: ask(i, "tools/call", name=name, arguments=given)
    lines = [ask(1, "tools/list"), call(2, "search-api-docs"), call(3, "search-docs", query="x", types=["nope"]), call(4, "get-api-spec", apiName=5), "{odd", "[]", ask(5, "ping"), call(6, "search-api-docs", query="authentication", types=["overview"])]
    tools.serve(seeded, lines, out.append)
    got = [json.loads(x) for x in out]
    listed = {t["name"]: t for t in got[0]["result"]["tools"]}
    assert all(t["title"] and t["description"] and t["inputSchema"]["type"] == "object" for t in listed.values())
    assert listed["search-api-docs"]["inputSchema"]["required"] == ["query"] and "required" not in listed["list-apis"]["inputSchema"]
    assert listed["search-docs"]["inputSchema"]["properties"]["types"]["items"]["enum"] == ["overview", "endpoint", "schema", "glossary", "use-case", "guide"]
    assert [g["error"]["code"] for g in got[1:6]] == [-32602, -32602, -32602, -32700, -32600] and got[6]["result"] == {} and "result" in got[7]


def test_server_program(spark, seeded):
    from docfathom import server

    out, err = [], []
    assert server.run(spark, [json.dumps({"id": 1, "method": "initialize"})], out.append, err.append, lambda: seeded) == 0
    assert json.loads(out[0])["result"]["serverInfo"]["name"] == "docfathom" and not err

    def broken():
        raise ValueError("no such folder")

    assert server.run(spark, [], out.append, err.append, broken) == 1 and err == ["docfathom startup failed: no such folder\n"]


def test_search_batch_in_blocks(spark, monkeypatch):
    from docfathom.operators import vector

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 8)).round(3), rng.normal(size=(23, 8)).round(3)
    x[50] = x[51]
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 30)
    vectors = spark.createDataFrame([(f"c{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, vector array<double>")
    got = {}
    for r in vector.search_batch(vectors, queries, 7).collect():
        got.setdefault(r.query_id, {})[r.vec_rank] = r.id
    for i, r in enumerate(q):
        d = np.sqrt(((x - r) ** 2).sum(1)).round(6)
        want = sorted(range(200), key=lambda j: (d[j], f"c{j:03d}"))[:7]
        assert [got[i][k] for k in range(1, 8)] == [f"c{j:03d}" for j in want]
    plan = vector.search_batch(vectors, queries, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Union") == 1  # one pass, whatever the number of blocks
    assert vector.search_batch(vectors.limit(0), queries, 7).count() == 0 and vector.search_batch(vectors, queries.limit(0), 7).count() == 0
