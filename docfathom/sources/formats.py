"""Sources as formats of Spark: spark.read.format("openapi" | "markdown" | "registry"), in SQL too, and readStream for markdown folders.

    register(spark)
    spark.read.format("markdown").option("api_id", "guides").load("/docs")
    spark.sql("CREATE TEMPORARY VIEW specs USING openapi OPTIONS (path '/specs', api_id 'petstore')")

The driver lists names only. Files are parsed on the executors, a partition for each group of files. The options types and sources (lists
with commas) skip whole files: a markdown file has one type, by its name, a specification has three, and a registry's files have a source.
They are options, not filters pushed down by Spark: Spark 4.1 keeps what it has pushed into a reader of this kind for the next query over
the same frame, which then misses rows. Columns that are not asked for are dropped by Spark after the reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import markdown, openapi
from .registry import load_registry

FIELDS = [f.split()[0] for f in openapi.CHUNK_FIELDS.split(", ")]
#: Files (and bytes of them, as listed) that a partition reads, at most.
GROUP_FILES, GROUP_BYTES = 64, 16 << 20
SPECIFICATIONS = (".yml", ".yaml", ".json")


@dataclass
class File:
    """A file to parse; spec: a specification, else markdown; name: its source's in a registry."""

    path: str
    api_id: str
    spec: bool
    name: str | None = None
    size: int = 0
    gone: bool = False

    def types(self) -> set[str]:
        return {"overview", "endpoint", "schema"} if self.spec else {markdown.kind_of(self.path)}

    def chunks(self) -> list[dict]:
        read = openapi.parse_openapi_file if self.spec else markdown.parse_markdown_file
        return read(self.path, self.api_id)


@dataclass
class Group(InputPartition):
    files: list[File]


def grouped(files: Iterable[File]) -> list[Group]:
    out, size = [], 0
    for f in files:
        if not out or len(out[-1].files) == GROUP_FILES or size + f.size > GROUP_BYTES:
            out.append(Group([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out or [Group([])]


def _listed(path: str, spec: bool) -> list[str]:
    if not os.path.exists(path):
        raise ValueError(f"{'specification' if spec else 'docs path'} does not exist: {path}")
    if not os.path.isdir(path):
        return [path]
    names = sorted(n for n in os.listdir(path) if n.endswith(SPECIFICATIONS)) if spec else markdown.markdown_files(path)
    return [os.path.join(path, n) for n in names]


class FilesReader(DataSourceReader):
    """Chunks of files: of the wanted types (all, if none are named) only, and files of other types are not opened."""

    def __init__(self, files: list[File], named: bool, types: set[str]):
        self.files, self.named, self.types = [f for f in files if not types or f.types() & types], named, types

    def partitions(self) -> list[Group]:
        return grouped(self.files)

    def read(self, partition: Group) -> Iterator[tuple]:
        for f in partition.files:
            for c in f.chunks():
                if self.types and c["type"] not in self.types:
                    continue
                yield (*([f.name] if self.named else []), *(c[x] for x in FIELDS))


class _Files(DataSource):
    spec = False

    def schema(self) -> str:
        return openapi.CHUNK_FIELDS

    def _option(self, name: str) -> str:
        if not self.options.get(name):
            raise ValueError(f'format "{self.name()}" needs the option {name}')
        return self.options[name]

    def _list(self, name: str) -> set[str]:
        return {x.strip() for x in (self.options.get(name) or "").split(",")} - {""}

    def reader(self, schema) -> FilesReader:
        api = self._option("api_id")
        return FilesReader([File(p, api, self.spec, size=os.path.getsize(p)) for p in _listed(self._option("path"), self.spec)], False, self._list("types"))


class OpenApi(_Files):
    """Chunks of a specification, or of those of a folder. Options: path, api_id, types."""

    spec = True

    @classmethod
    def name(cls) -> str:
        return "openapi"


class Markdown(_Files):
    """Chunks of a markdown file, or of those of a folder. Options: path, api_id, types."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self._option("path"))


class Registry(_Files):
    """Chunks of all sources of a registry, with the source's name. Options: path, sources, types."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "source string, " + openapi.CHUNK_FIELDS

    def reader(self, schema) -> FilesReader:
        from .ingest import source_id

        entries, files = load_registry(self._option("path")), []
        for e in entries.apis:
            files += [File(p, source_id(e.name), True, e.name) for p in _listed(e.spec, True)]
            files += [File(p, source_id(e.name), False, e.name) for p in (_listed(e.docs, False) if e.docs and os.path.isdir(e.docs) else [])]
        for e in entries.docs:
            files += [File(p, source_id(e.name), False, e.name) for p in _listed(e.path, False)]
        sources = self._list("sources")
        files = [f for f in files if not sources or f.name in sources]
        for f in files:
            f.size = os.path.getsize(f.path)
        return FilesReader(files, True, self._list("types"))


class FolderStream(DataSourceStreamReader):
    """The markdown files of a folder as they change: path and content of those that are new or changed, null for those that are gone.

    An offset is what the folder held: each file's time of change and size. It is kept in the checkpoint, and its size goes with the number
    of files, not with their contents. A file that changes again before a batch reads it is read in its later state, now and once more.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for name in markdown.markdown_files(self.path):
            try:
                s = os.stat(os.path.join(self.path, name))
            except FileNotFoundError:
                continue
            out[name] = [s.st_mtime_ns, s.st_size]
        return out

    def partitions(self, start: dict, end: dict) -> list[Group]:
        names = sorted({*start, *end})
        return grouped(File(os.path.join(self.path, n), "", False, size=end.get(n, [0, 0])[1], gone=n not in end) for n in names if start.get(n) != end.get(n))

    def read(self, partition: Group) -> Iterator[tuple]:
        for f in partition.files:
            text = None
            if not f.gone:
                try:
                    with open(f.path, encoding="utf-8", newline="") as source:
                        text = source.read()
                except FileNotFoundError:  # gone meanwhile, as the next batch will say too
                    pass
            yield (f.path, text)


def register(spark: SparkSession) -> None:
    for source in (OpenApi, Markdown, Registry):
        spark.dataSource.register(source)
