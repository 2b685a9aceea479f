import json

import numpy as np
import pytest

from docfathom.sources import embed, markdown, openapi, registry, yamlish
from docfathom.sources.ingest import IngestResult, Source, format_duration, format_result, source_hash, source_id
from docfathom.sources.store import IndexStore

PETS = """openapi: "3.0.3"
info: {title: Pets, version: 1.2.0, description: About pets}
servers:
  - {url: https://a, description: Production}
  - {url: https://b}
paths:
  /pets:
    parameters: [{name: ignored, in: query}]
    post: {summary: Create, requestBody: {required: true, content: {application/json: {schema: {$ref: '#/components/schemas/PetInput'}}}}, responses: {'201': {description: made}}}
    get:
      operationId: listPets
      tags: [pets]
      parameters:
        - {name: limit, in: query, schema: {type: integer}}
        - {name: status, in: query, required: true, schema: {type: string, enum: [on, off]}}
      responses:
        default: {description: other}
        '404': {}
        '200': {description: ok, content: {application/json: {schema: {type: array, items: {$ref: '#/components/schemas/Pet'}}}, text/plain: {schema: {}}}}
components:
  schemas:
    Pet: {type: object, description: A pet, required: [id], properties: {id: {type: integer}, name: {type: [string, 'null'], description: Its name}, self: {$ref: '#/components/schemas/Pet'}, x: {}}}
    PetInput: {type: object, properties: {name: {type: string, description: Called}, tag: {}}}
"""


def test_openapi():
    c = openapi.parse_openapi_text(PETS, "p", "pets.yaml")
    assert [x["id"] for x in c] == ["p:overview", "p:endpoint:get:/pets", "p:endpoint:post:/pets", "p:schema:Pet"]
    assert c[0]["content"] == "# Pets\n\nVersion: 1.2.0\n\nAbout pets\n\n## Servers\n\n- https://a (Production)\n- https://b"
    assert c[1]["content"] == (
        "# GET /pets\n\n## Parameters\n\n- **limit** [query] : integer\n- **status** [query] : string (required)\n\n## Responses\n\n### 200: ok\n\nContent-Type: application/json\n- type: array of object"
        "\n\nContent-Type: text/plain\n\n### 404: undefined\n### default: other"
    )
    assert c[2]["content"].endswith("## Request Body\n\nContent-Type: application/json\n- type: object\n  properties:\n    - name (string) - Called\n    - tag (unknown)\n\n## Responses\n\n### 201: made")
    assert json.loads(c[1]["metadata"]) == {"path": "/pets", "method": "get", "tags": ["pets"], "operationId": "listPets"}
    assert c[2]["metadata"] == '{"path":"/pets","method":"post","tags":[],"operationId":null}' and c[0]["metadata"] is None
    assert "- **id** (integer) (required)\n- **name** (string,null) - Its name\n- **self** (object)" in c[3]["content"]
    assert c[3]["metadata"] == '{"schemaName":"Pet","propertyCount":4}'


@pytest.mark.parametrize(("text", "told"), [('swagger: "2.0"', "is not OpenAPI 3.x (found: 2.0)"), ("a: 1", "(found: unknown)"), ("[1", 'Failed to parse OpenAPI spec for "p" at s.yaml:'), ("openapi: 3.0.0\nx: {$ref: '#/no'}", "Failed to parse")])
def test_openapi_errors(text, told):
    with pytest.raises(ValueError) as e:
        openapi.parse_openapi_text(text, "p", "s.yaml")
    assert told in str(e.value)


def test_yaml_dialect():
    assert yamlish.load("a: on\nb: yes\n200: x\nc: 2020-01-01\nd: 1.5\ne: ~\nf: 1:30\ng: true") == {"a": "on", "b": "yes", "200": "x", "c": "2020-01-01", "d": 1.5, "e": None, "f": "1:30", "g": True}


def ids(text, path="/d/my-guide.md"):
    return [(c["id"].removeprefix("a:doc:my-guide:"), c["content"]) for c in markdown.parse_markdown_text(text, "a", path)]


def test_markdown_sections():
    assert ids("lost\n\n# Top `x`\n\nintro\n\n## One & **Two**\n\nb\n\n#### Deep\n\nc\n\n### Sub\n\nd") == [("top-x", "intro"), ("top-x/one-two", "b\n\n#### Deep\n\nc"), ("top-x/one-two/sub", "d")]
    assert ids("no headings") == [] and ids("") == []
    assert ids("# A\nx\n# B\ny\n## C\nz") == [("b", "y"), ("b/c", "z")]
    assert ids("# A\n## H\n1\n# B\n### S\n2") == [("b/h/s", "2")]
    assert ids("Title\n===\n\ntext\n\nSecond\n---\nmore\n") == [("title", "text"), ("title/second", "more")]


def test_markdown_blocks():
    assert ids("# A\n```sh\n# no\n```\n> # no\n\n- # no\n  ## no\n\n    # code\n\n<div>\n# no\n</div>\n\n<!-- \n# no\n-->\n## B ##\nt") [1] == ("a/b", "t")
    assert len(ids("# A\n```sh\n# no\n```\n> # no\n\n- # no\n  ## no\n\n    # code\n\n<div>\n# no\n</div>\n\n<!-- \n# no\n-->\n## B ##\nt")) == 2
    assert ids("## [Link](u) _it_ \\* a_b_c\nq")[0][0] == "link-it-a-b-c"
    assert [t for _, t, _, _ in markdown.headings("#nospace\n# yes\n#\n")] == ["yes", ""]


def test_markdown_packing():
    big = "p" * 1400
    parts = markdown.parse_markdown_text(f"# T\n\n{big}\n\n{big}\n\n{big}\n\n" + "x" * 6100, "a", "/d/Glossary.md")
    assert [len(c["content"]) for c in parts] == [2802, 1400, 3000, 3000, 100] and parts[1]["id"] == "a:doc:Glossary:t:1" and parts[0]["type"] == "glossary"
    assert json.loads(parts[1]["metadata"]) == {"filePath": "/d/Glossary.md", "headings": ["T"], "chunkIndex": 1}
    assert markdown.utf16("a\U0001f600") == 3 and markdown.kind_of("x/My_USE_case.md") == "use-case"


REGISTRY = [
    ("x: 1", 'expected top-level "apis" or "docs" array in'),
    ("apis: [{spec: s}]", 'apis.yml entry 0: missing or invalid "name"'),
    ("apis: [{name: a}]", 'apis.yml entry 0 (a): missing or invalid "spec"'),
    ("apis: [{name: a, spec: s, docs: 3}]", 'apis.yml entry 0 (a): "docs" must be a string'),
    ("docs: [{path: p}]", 'apis.yml docs entry 0: missing or invalid "name"'),
    ("docs: [{name: a}]", 'apis.yml docs entry 0 (a): missing or invalid "path"'),
    ("apis: [{name: a, spec: s}, {name: a, spec: t}]", 'apis.yml: duplicate name "a" within apis section'),
    ("apis: [{name: a, spec: s}]\ndocs: [{name: a, path: p}]", 'duplicate name "a" (appears in both apis and docs sections)'),
    ("docs: [{name: a, path: p}, {name: a, path: p}]", 'duplicate name "a" (appears in both docs and docs sections)'),
]


@pytest.mark.parametrize(("text", "told"), REGISTRY)
def test_registry_errors(tmp_path, text, told):
    (tmp_path / "r.yml").write_text(text)
    with pytest.raises(ValueError) as e:
        registry.load_registry(str(tmp_path / "r.yml"))
    assert told in str(e.value)


def test_registry(tmp_path):
    (tmp_path / "r.yml").write_text("apis: [{name: a, spec: s.yml, docs: d}]\ndocs: [{name: b, path: ../x}]")
    got = registry.load_registry(str(tmp_path / "r.yml"))
    assert got.apis == [registry.ApiEntry("a", f"{tmp_path}/s.yml", f"{tmp_path}/d")] and got.docs[0].path == f"{tmp_path.parent}/x"


def test_voyage(monkeypatch):
    calls = []

    def send(url, headers, body):
        calls.append((headers, body))
        return 200, json.dumps({"data": [{"embedding": [1.0, 2.0]} for _ in body["input"]]})

    p = embed.VoyageProvider(send)
    with pytest.raises(ValueError, match="Embedding failed on batch 1/1 .texts 0-0.: VOYAGE_API_KEY environment variable is not set"):
        p.embed_documents(["a"])
    monkeypatch.setenv("VOYAGE_API_KEY", "k")
    assert len(p.embed_documents(["t"] * 300)) == 300 and [len(b["input"]) for _, b in calls] == [128, 128, 44]
    assert calls[0][0] == {"Authorization": "Bearer k"} and calls[0][1]["input_type"] == "document" and p.dimension == 1024
    p.embed_query("q")
    assert calls[-1][1]["input_type"] == "query" and p.embed_documents([]) == []
    for answer, told in (((500, "no"), "Voyage API error (500): no"), ((200, "{}"), "expected 1 embeddings, got no data field"), ((200, '{"data": []}'), "got 0"), ((200, '{"data": [{"embedding": []}]}'), "invalid embedding at index 0")):
        with pytest.raises(ValueError) as e:
            embed.VoyageProvider(lambda *_, a=answer: a).embed_query("q")
        assert told in str(e.value)


def test_ollama(monkeypatch):
    calls = []

    def send(url, headers, body):
        calls.append((url, body))
        return 200, json.dumps({"embeddings": [[1, 2]] * len(body["input"])})

    p = embed.OllamaProvider(send)
    assert p.dimension == 1024 and len(p.embed_documents(["a", "b"])) == 2 and calls == [("http://localhost:11434/api/embed", {"model": "bge-large", "input": ["a", "b"]})]
    monkeypatch.setenv("OLLAMA_DIMENSION", "3")
    monkeypatch.setenv("OLLAMA_URL", "http://h")

    def refuse(*_):
        raise OSError("refused")

    for send, told in ((refuse, "Failed to connect to Ollama at http://h: refused"), (lambda *_: (404, "x"), "Ollama API error (404): x"), (lambda *_: (200, "{}"), "missing embeddings array"), (lambda *_: (200, '{"embeddings": []}'), "expected 1 embeddings, got 0")):
        with pytest.raises(ValueError) as e:
            embed.OllamaProvider(send).embed_query("q")
        assert told in str(e.value)


def test_transformers_and_factory(monkeypatch):
    seen = {}

    def load(model, **options):
        seen.update(model=model, **options)
        return lambda texts, pooling: [[3.0, 4.0] for _ in texts]

    assert np.allclose(embed.TransformersProvider(load).embed_query("q"), [0.6, 0.8]) and seen == {"model": "Xenova/bge-large-en-v1.5", "remote": True}
    with pytest.raises(ValueError, match="Failed to load Transformers model"):
        embed.TransformersProvider().embed_query("q")
    embed.reset_provider()
    monkeypatch.setenv("EMBEDDING_PROVIDER", "zzz")
    with pytest.raises(ValueError, match='Invalid EMBEDDING_PROVIDER "zzz". Valid options: voyage, ollama, transformers'):
        embed.get_provider()
    monkeypatch.setenv("EMBEDDING_PROVIDER", "ollama")
    assert embed.get_provider() is embed.get_provider() and embed.get_dimension() == 1024
    embed.reset_provider()


def test_hashes_and_formats(spark, tmp_path):
    (tmp_path / "b.md").write_text("B")
    (tmp_path / "a.md").write_text("A")
    (tmp_path / "c.txt").write_text("no")
    import hashlib

    store = IndexStore.temporary(spark, 8)
    assert source_hash(store, Source("s", None, str(tmp_path))) == hashlib.sha256(b"a.mdAb.mdB").hexdigest()
    assert source_hash(store, Source("s", str(tmp_path / "a.md"), str(tmp_path / "none"))) == hashlib.sha256(b"A").hexdigest()
    assert source_id("python.org") == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    assert (format_duration(12.6), format_duration(1500)) == ("13ms", "1.5s")
    assert format_result(IngestResult("a", 5, 3, 1, 1, False, 10)) == "  5 chunks: 3 embedded, 1 skipped, 1 deleted (10ms)"


def test_references_over_several_files(tmp_path):
    """A reference means the file that it is written in; pointers lead through references, folders and loops."""
    (tmp_path / "parts" / "deep").mkdir(parents=True)
    (tmp_path / "api.yaml").write_text(
        'openapi: 3.0.0\ninfo: {title: T, version: "1"}\npaths: {}\ncomponents: {schemas: {A: {$ref: "x.yaml#/A"}, B: {$ref: "parts/b.yaml"}, C: {$ref: "#/components/schemas/A/properties/b"}, D: {$ref: "api.yaml#/components/schemas/A"}}}\n'
    )
    (tmp_path / "x.yaml").write_text('A: {type: object, description: of x, properties: {a: {type: string}, b: {$ref: "#/B"}, c: {$ref: "parts/b.yaml#/properties/p"}}}\nB: {type: object, properties: {q: {type: integer}, r: {type: string}, s: {$ref: "#/A"}}}\n')
    (tmp_path / "parts" / "b.yaml").write_text('type: object\nproperties: {p: {type: boolean}, q: {$ref: "deep/c.yaml#/Z"}, r: {$ref: "../x.yaml#/B/properties/q"}}\n')
    (tmp_path / "parts" / "deep" / "c.yaml").write_text('Z: {$ref: "#/Y"}\nY: {type: number}\n')
    got = {c["title"]: c["content"] for c in openapi.parse_openapi_file(str(tmp_path / "api.yaml"), "t")}
    assert got["A"] == got["D"].replace("# D", "# A") == "# A\n\nof x\n\n## Properties\n\n- **a** (string)\n- **b** (object)\n- **c** (boolean)"
    assert got["B"].endswith("- **p** (boolean)\n- **q** (number)\n- **r** (integer)") and got["C"].endswith("- **q** (integer)\n- **r** (string)\n- **s** (object) - of x")
    (tmp_path / "x.yaml").write_text("A: {$ref: '#/Nope'}\n")
    with pytest.raises(ValueError, match='Token "Nope" does not exist'):
        openapi.parse_openapi_file(str(tmp_path / "api.yaml"), "t")


def test_specifications_of_one_partition_are_dealt_out(spark):
    from pyspark.sql import functions as F

    rows = [(f"/s/{i}.yaml", PETS.replace("title: Pets", f"title: Pets {i}"), f"a{i}") for i in range(64)]
    specs = spark.createDataFrame(rows, "path string, content string, api_id string").coalesce(1)
    got = openapi.split_frame(specs).withColumn("task", F.spark_partition_id()).collect()
    per = {}
    for r in got:
        per[r.task] = per.get(r.task, 0) + 1
    assert len(per) >= 8 and max(per.values()) <= len(got) / 4
    want = [c for path, text, api in rows for c in openapi.parse_openapi_text(text, api, path)]
    key = lambda c: (c["api_id"], c["seq"])
    assert sorted(({k: r[k] for k in want[0]} for r in got), key=key) == sorted(want, key=key)


def test_chunks_leave_before_a_batch_is_read():
    import pyarrow as pa

    text = "# Doc\n\n" + "".join(f"## Part {i}\n\ntext {i}\n\n" for i in range(20))
    files = [(f"/d/f{i}.md", text if i % 5 else None, "a") for i in range(1000)]
    schema = pa.schema([(n, pa.string()) for n in ("path", "content", "api_id")])
    batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in files], schema)
    read = []

    def parse(content, api_id, path):
        read.append(path)
        return markdown.parse_markdown_text(content or "", api_id, path)

    got = openapi.chunk_batches(iter([batch.slice(0, 0), batch]), parse)
    first = next(got)
    assert len(read) < 50 and first.num_rows < openapi.CHUNKS_AT_ONCE + 21
    rest = list(got)
    assert max(b.num_rows for b in rest) < openapi.CHUNKS_AT_ONCE + 21
    assert [c for b in (first, *rest) for c in b.to_pylist()] == [c for p, t, a in files for c in markdown.parse_markdown_text(t or "", a, p)]


def test_markdown_goes_through_in_small_batches(spark):
    rows = [(f"/d/f{i}.md", f"# T{i}\n\nbody\n\n## S\n\n" + "word " * 1300, "a") for i in range(20)] + [("/d/none.md", None, "a")]
    frame = spark.createDataFrame(rows, "path string, content string, api_id string")
    assert "MapInArrow" in markdown.split_frame(frame)._jdf.queryExecution().executedPlan().toString()
    want = [c for path, text, api in rows for c in markdown.parse_markdown_text(text or "", api, path)]
    key = lambda c: (c["id"], c["seq"])
    assert sorted((r.asDict() for r in markdown.split_frame(frame).collect()), key=key) == sorted(want, key=key)
