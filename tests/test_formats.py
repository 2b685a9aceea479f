"""Sources as formats of Spark, and the stream of a folder."""

import os

import pytest

from docfathom.sources import embed, formats, ingest, markdown, openapi
from docfathom.sources.store import IndexStore
from docfathom.streaming.ingest import watch_markdown

SPEC = "openapi: 3.0.0\ninfo: {title: Pay, version: '1'}\npaths:\n  /pay: {get: {summary: List}}\n"


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# A\n\none\n\n## B\n\ntwo")
    (d / "glossary.md").write_text("# Words\n\nthree")
    (d / "x.txt").write_text("no")
    (tmp_path / "s.yml").write_text(SPEC)
    (tmp_path / "apis.yml").write_text("apis: [{name: pay, spec: s.yml, docs: docs}]\ndocs: [{name: guides, path: docs}]")
    return tmp_path


def rows(df):
    return sorted(tuple(r[c] for c in formats.FIELDS) for r in df.collect())


def parsed(chunks):
    return sorted(tuple(c[f] for f in formats.FIELDS) for c in chunks)


def test_formats(spark, folder):
    docs, spec = str(folder / "docs"), str(folder / "s.yml")
    assert rows(spark.read.format("markdown").option("api_id", "m").load(docs)) == parsed(c for n in ("a.md", "glossary.md") for c in markdown.parse_markdown_file(f"{docs}/{n}", "m"))
    assert rows(spark.read.format("openapi").option("api_id", "p").load(spec)) == parsed(openapi.parse_openapi_file(spec, "p"))
    every = spark.read.format("registry").load(str(folder / "apis.yml"))
    pay, guides = ingest.source_id("pay"), ingest.source_id("guides")
    assert rows(every.filter("source = 'pay'").drop("source")) == parsed(openapi.parse_openapi_file(spec, pay) + [c for n in ("a.md", "glossary.md") for c in markdown.parse_markdown_file(f"{docs}/{n}", pay)])
    assert {(r.source, r.api_id): r[2] for r in every.groupBy("source", "api_id").count().collect()} == {("pay", pay): 5, ("guides", guides): 3}


def test_in_sql(spark, folder):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW guide USING markdown OPTIONS (path '{folder}/docs', api_id 'm')")
    assert [tuple(r) for r in spark.sql("SELECT type, count(*) FROM guide GROUP BY type ORDER BY type").collect()] == [("glossary", 1), ("guide", 2)]


def test_types_and_sources_skip_files(spark, folder):
    """A file that cannot be read is no matter where it is not wanted."""
    (folder / "docs" / "broken.md").write_bytes(b"\xff\xfe\xff")
    (folder / "docs" / "use-case-broken.md").write_bytes(b"\xff")
    read = lambda kind, path, **o: spark.read.format(kind).options(**o).load(str(folder / path))
    with pytest.raises(Exception, match="codec can't decode"):
        read("markdown", "docs", api_id="m").collect()
    some = read("markdown", "docs", api_id="m", types="glossary, schema")
    assert [r.content for r in some.filter("content = 'nothing'").collect()] == [] and [r.content for r in some.collect()] == ["three"]
    assert [r.type for r in read("openapi", "s.yml", api_id="p", types="endpoint").collect()] == ["endpoint"]
    assert {r.type for r in read("registry", "apis.yml", types="endpoint,overview").collect()} == {"endpoint", "overview"}
    (folder / "apis.yml").write_text("apis: [{name: pay, spec: s.yml}]\ndocs: [{name: guides, path: docs}]")
    assert {r.source for r in read("registry", "apis.yml", sources="pay").collect()} == {"pay"}


def test_wrong_options(spark, folder):
    with pytest.raises(Exception, match="needs the option api_id"):
        spark.read.format("markdown").load(str(folder / "docs")).collect()
    with pytest.raises(Exception, match="docs path does not exist"):
        spark.read.format("markdown").option("api_id", "m").load(str(folder / "none")).collect()


def test_groups():
    files = [formats.File(str(i), "a", False, size=s) for i, s in enumerate([1, 2, formats.GROUP_BYTES, 3, formats.GROUP_BYTES + 1] + [1] * 130)]
    groups = formats.grouped(files)
    assert [f.path for g in groups for f in g.files] == [str(i) for i in range(135)]
    assert all(len(g.files) <= formats.GROUP_FILES and (len(g.files) == 1 or sum(f.size for f in g.files) <= formats.GROUP_BYTES) for g in groups)
    assert len(formats.grouped([])) == 1


def test_a_stream_forgets(spark, folder, tmp_path):
    store = IndexStore.temporary(spark, 8)
    docs, calls = folder / "docs", tmp_path / "calls"

    class Counting(embed.HashingProvider):
        def embed_documents(self, texts):
            with open(calls, "a") as f:
                f.write("x" * len(texts))
            return super().embed_documents(texts)

    api = {"id": "w", "name": "w"}

    def run(checkpoint="ck"):
        calls.write_text("")
        watch_markdown(store, str(docs), api, str(tmp_path / checkpoint), lambda: Counting(8)).awaitTermination()
        return {r.id: r.content for r in store.chunks().collect()}, len(calls.read_text())

    chunk = "w:doc:a:a"
    assert run() == ({chunk: "one", f"{chunk}/b": "two", "w:doc:glossary:words": "three"}, 3)
    version = store.version
    assert run()[1] == 0 and store.version == version  # nothing has changed
    (docs / "a.md").write_text("# A\n\none\n\n## C\n\nnew")  # a section lost, one won
    assert run() == ({chunk: "one", f"{chunk}/c": "new", "w:doc:glossary:words": "three"}, 1)
    os.remove(docs / "glossary.md")
    (docs / "d.md").write_text("# D\n\nfour")
    held, n = run()
    assert (held, n) == ({chunk: "one", f"{chunk}/c": "new", "w:doc:d:d": "four"}, 1)
    version = store.version
    assert run("fresh") == (held, 0) and store.version == version  # all files once more: the store is as it should be
    assert tuple(store.stats().first()) == (3, 2.0)
