"""Incremental ingestion: digest, split, compare, embed, commit, for one source or for all of a registry at once.

Sources are a frame of files. Each source's digest is taken by one task, from a sorted stream of its files; files are parsed where they
are read; one full outer join finds what is new, changed, unchanged and gone in all sources; one commit writes it. What fails in one source
is told as its error and leaves that source as it was; the others go on.
"""

from __future__ import annotations

import errno
import hashlib
import os
import time
import traceback
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import embed, markdown, openapi
from .store import NEW_SOURCE, IndexStore

#: Sources whose ids a filter lists, at most; the chunks of more are found by a join.
LISTED_SOURCES = 500
PARSED = openapi.CHUNK_FIELDS + ", file binary, error string, trace string"
#: Rows of files that go to Python at once: a batch holds their whole contents.
FILES_AT_ONCE = 16


@dataclass(frozen=True)
class IngestResult:
    api: str
    total: int = 0
    embedded: int = 0
    skipped: int = 0
    deleted: int = 0
    unchanged: bool = False
    duration_ms: float = 0.0
    error: Exception | None = None
    trace: str = ""


@dataclass(frozen=True)
class Source:
    """A specification, with markdown files if docs names their folder; or such a folder alone."""

    name: str
    spec: str | None = None
    docs: str | None = None


def source_id(name: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def format_duration(ms: float) -> str:
    return f"{int(ms + 0.5)}ms" if ms < 1000 else f"{ms / 1000:.1f}s"


def format_result(r: IngestResult) -> str:
    return f"  {r.total} chunks: {r.embedded} embedded, {r.skipped} skipped, {r.deleted} deleted ({format_duration(r.duration_ms)})"


# --- sources as files
def _qualified(store: IndexStore, path: str) -> tuple[str, bool]:
    """A path as Spark's readers name it, and whether it is there."""
    place = store.spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else os.path.abspath(path))
    fs = place.getFileSystem(store.spark._jsc.hadoopConfiguration())
    return fs.makeQualified(place).toString(), fs.exists(place)


def _missing(store: IndexStore, source: Source) -> Exception | None:
    if source.spec is None:
        return None if _qualified(store, source.docs)[1] else ValueError(f"docs path does not exist: {source.docs}")
    return None if _qualified(store, source.spec)[1] else FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), source.spec)


def source_files(store: IndexStore, sources: Sequence[Source]) -> DataFrame:
    """api_id, path, spec (whether it is the specification), file (what files of a source are ordered by) and content: specifications, and
    the .md files of folders themselves by the UTF-16 units of their names. A folder that is absent holds nothing."""
    spark, places, paths = store.spark, [], set()
    for s in sources:
        for path, spec in ((s.spec, True), (s.docs, False)):
            if path is not None:
                place, there = _qualified(store, path)
                places.append((source_id(s.name), path.rstrip("/") or path, spec, place))
                if there:
                    paths.add((place, spec))
    known = F.broadcast(spark.createDataFrame(places, "api_id string, given string, spec boolean, place string"))  # the caller's own list
    read = spark.read.format("binaryFile")
    specs, folders = sorted(p for p, spec in paths if spec), sorted(p for p, spec in paths if not spec)
    none = spark.createDataFrame([], "path string, content binary")
    found = read.load(specs).select("path", "content") if specs else none
    found = found.join(known.filter("spec"), F.col("path") == F.col("place")).select("api_id", F.col("given").alias("path"), "spec", F.lit(b"").alias("file"), "content")
    named = read.option("pathGlobFilter", "*.md").load(folders).select("path", "content") if folders else none
    name = F.element_at(F.split("path", "/"), -1)
    named = named.withColumn("name", name).withColumn("folder", F.expr("left(path, length(path) - length(name) - 1)")).drop("path")
    named = named.join(known.filter("NOT spec"), F.col("folder") == F.col("place"))
    file = F.concat(F.lit(b"\x01"), F.encode("name", "UTF-16BE"))
    return found.unionByName(named.select("api_id", F.concat("given", F.lit("/"), "name").alias("path"), "spec", file.alias("file"), "content"))


def digests(files: DataFrame) -> DataFrame:
    """api_id and the digest of a source: its specification's bytes, then names and bytes of the markdown files. A task keeps one file at a time."""

    def run(batches):
        import pyarrow as pa

        at, digest = None, None
        row = lambda: pa.record_batch([pa.array([at]), pa.array([digest.hexdigest()])], names=["api_id", "digest"])
        for batch in batches:
            for api, path, spec, content in zip(*(batch.column(c) for c in ("api_id", "path", "spec", "content")), strict=True):
                if api.as_py() != at:
                    if at is not None:
                        yield row()
                    at, digest = api.as_py(), hashlib.sha256()
                if not spec.as_py():
                    digest.update(os.path.basename(path.as_py()).encode())
                digest.update(content.as_buffer())
        if at is not None:
            yield row()

    return files.repartition("api_id").sortWithinPartitions("api_id", "file").mapInArrow(run, "api_id string, digest string")


def source_hash(store: IndexStore, source: Source) -> str:
    row = digests(source_files(store, [source])).first()
    return row["digest"] if row else hashlib.sha256().hexdigest()


def _spec_text(content: bytes) -> str:
    """Text as a reader with universal newlines has it."""
    return content.decode().replace("\r\n", "\n").replace("\r", "\n")


def parsed_files(files: DataFrame) -> DataFrame:
    """Chunks of the files (CHUNK_FIELDS), and file; a file that cannot be parsed is one row with error and trace."""

    def run(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PARSED.split(", ")])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    read = openapi.parse_openapi_text if r["spec"] else markdown.parse_markdown_text
                    chunks = read(_spec_text(r["content"]) if r["spec"] else r["content"].decode(), r["api_id"], r["path"])
                except Exception as e:
                    chunks = [{"api_id": r["api_id"], "error": str(e), "trace": traceback.format_exc()}]
                out += [{**c, "file": r["file"]} for c in chunks]
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("api_id", "path", "spec", "file", "content").mapInArrow(run, PARSED)


# --- comparing and committing
def _local(store: IndexStore, parsed: list[dict]) -> DataFrame:
    import pyarrow as pa

    fields = [f.split()[0] for f in openapi.CHUNK_FIELDS.split(", ")]
    kinds = {"seq": pa.int32()}
    return store.spark.createDataFrame(pa.table({f: pa.array([c[f] for c in parsed], kinds.get(f, pa.string())) for f in fields}))


def _held(store: IndexStore, ids: list[str]) -> DataFrame:
    if len(ids) <= LISTED_SOURCES:
        return store.stored(ids)
    return store.stored().join(store.spark.createDataFrame([(i,) for i in ids], "api_id string"), "api_id", "left_semi")


def merge_sources(store: IndexStore, rows: DataFrame, ids: list[str], sources: Callable[[list[str]], DataFrame | None], make: Callable | None = None, order: Sequence[str] = ("seq",), catch: bool = False, held: DataFrame | None = None) -> dict[str, IngestResult]:
    """Compare the chunks of some sources (CHUNK_FIELDS and the columns of order) with what is stored, embed what changed, and commit all.

    rows is evaluated once, into the store's folder, and each changed chunk is embedded once. Of chunks with one id the last in order is
    stored, all are counted. sources gives the rows of the table of sources for the ids that did not fail. held: the stored chunks that rows
    stand for (all of the sources', if not given); those that rows do not have are deleted. catch: an error of the provider
    is that of the sources whose chunks it was given, else it is raised and the store is as before.
    """
    spark, scratch = store.spark, []

    def kept(df: DataFrame) -> DataFrame:
        scratch.append(store.scratch(df))
        return spark.read.schema(df.schema).parquet(scratch[-1])

    try:
        rows = kept(rows.withColumn("_row", F.monotonically_increasing_id()))
        last = Window.partitionBy("api_id", "id").orderBy(*[F.desc(c) for c in order], F.desc("_row"))
        new = rows.select("api_id", "id", F.col("content_hash").alias("new"), "_row", F.row_number().over(last).alias("n"))
        old = (_held(store, ids) if held is None else held).select("api_id", "id", F.col("content_hash").alias("old"), "created_at", "dl")
        told = kept(new.join(old, ["api_id", "id"], "full_outer"))
        same = F.coalesce(F.col("new") == F.col("old"), F.lit(False))
        sums = [F.count("new").alias("total"), F.count_if(same).alias("skipped"), F.count_if(F.col("new").isNull()).alias("deleted")]
        counts = {r["api_id"]: r for r in told.groupBy("api_id").agg(*sums, F.count_if((F.col("n") == 1) & ~same).alias("changed"), F.count_if(F.col("old").isNotNull() & ~same).alias("hidden")).collect()}

        failed: dict[str, IngestResult] = {}
        changed, gone = None, None
        if any(r["changed"] for r in counts.values()):
            now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
            changed = rows.join(told.filter((F.col("n") == 1) & ~same).select("_row", F.coalesce("created_at", now).alias("created_at")), "_row")
            changed = changed.drop("_row", *[c for c in order if c != "seq"]).repartitionByRange("api_id", "id").sortWithinPartitions("api_id", "id")
            changed = embed.embed_frame(changed, make, by="api_id" if catch else None)
            if catch:
                changed = kept(changed)
                for r in changed.filter("error IS NOT NULL").groupBy("api_id").agg(F.min(F.struct("error", "trace")).alias("e")).collect():
                    failed[r["api_id"]] = IngestResult("", error=RuntimeError(r["e"]["error"]), trace=r["e"]["trace"])
                changed = changed.drop("error", "trace")
        if any(r["hidden"] for r in counts.values()):
            gone = told.filter(F.col("old").isNotNull() & ~same & (F.coalesce("n", F.lit(1)) == 1)).select("id", "api_id", "dl")
        if failed:
            rest = lambda df: None if df is None else df.join(F.broadcast(spark.createDataFrame([(i,) for i in failed], "api_id string")), "api_id", "left_anti")
            changed, gone = rest(changed), rest(gone)
        well = [i for i in ids if i not in failed]
        known = sources(well) if well else None
        if any(x is not None for x in (known, changed, gone)) and well:
            store.commit(known, changed, gone)
    finally:
        for place in scratch:
            store.drop(place)
    out = {}
    for i in ids:
        r = counts.get(i)
        out[i] = failed.get(i) or (IngestResult("", r["total"], r["total"] - r["skipped"], r["skipped"], r["deleted"]) if r else IngestResult(""))
    return out


def merge_chunks(store: IndexStore, name: str, parsed: list[dict] | DataFrame, api: dict, make: Callable | None = None) -> IngestResult:
    """merge_sources() for one source and its chunks, on the driver or in a frame of them (CHUNK_FIELDS), however large.

    A provider that fails leaves the store as it was. Where nothing is new, changed or gone, only the source's row is written.
    """
    begin = time.perf_counter()
    rows = _local(store, parsed) if isinstance(parsed, list) else parsed
    r = merge_sources(store, rows, [api["id"]], lambda _: store.source_rows([api]), make)[api["id"]]
    return replace(r, api=name, duration_ms=1000 * (time.perf_counter() - begin))


def ingest_files(store: IndexStore, name: str, files: DataFrame, make: Callable | None = None) -> IngestResult:
    """Ingest markdown texts from a frame (path, content): read, split and embedded on the executors. The source is always compared."""
    ident = source_id(name)
    chunks = markdown.split_frame(files.select("path", "content", F.lit(ident).alias("api_id")))
    return merge_chunks(store, name, chunks, {"id": ident, "name": name}, make)


def ingest_sources(store: IndexStore, sources: Sequence[Source], force: bool = False, make: Callable | None = None) -> list[IngestResult]:
    """Ingest sources in as many jobs for two hundred as for one: a result for each, in order, its error with it.

    Every duration is that of the whole. Files are read by Spark and parsed on the executors; a specification's references to other files
    are read there as well, so those have to be in a folder that all machines see.
    """
    begin, out = time.perf_counter(), {}
    for s in sources:
        if error := _missing(store, s):
            out[source_id(s.name)] = IngestResult(s.name, error=error, trace="".join(traceback.format_exception(error)))
    work = [s for s in sources if source_id(s.name) not in out]
    if work:
        batch = ("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES_AT_ONCE))
        before = store.spark.conf.get(batch[0])
        store.spark.conf.set(*batch)
        try:
            files = source_files(store, work)
            found = {r["api_id"]: r["digest"] for r in digests(files).collect()}  # a row for each source
            found = {i: found.get(i, hashlib.sha256().hexdigest()) for i in map(lambda s: source_id(s.name), work)}
            held = {r["id"]: r["source_hash"] for r in store.apis().select("id", "source_hash").collect()}
            same = {i for i, d in found.items() if not force and held.get(i) == d}
            out |= {source_id(s.name): IngestResult(s.name, unchanged=True) for s in work if source_id(s.name) in same}
            work = [s for s in work if source_id(s.name) not in same]
            place = store.scratch(parsed_files(files.filter(F.col("api_id").isin(*[source_id(s.name) for s in work])) if same else files)) if work else None
        finally:
            store.spark.conf.set(batch[0], before)
        if work:
            try:
                out |= _merge_parsed(store, work, store.spark.read.schema(PARSED).parquet(place), files, found, make)
            finally:
                store.drop(place)
    ms = 1000 * (time.perf_counter() - begin)
    results = [out[source_id(s.name)] for s in sources]
    return [replace(r, api=s.name, duration_ms=0.0 if r.unchanged else ms) for s, r in zip(sources, results, strict=True)]


def _merge_parsed(store: IndexStore, work: list[Source], rows: DataFrame, files: DataFrame, found: dict[str, str], make: Callable | None) -> dict[str, IngestResult]:
    first = rows.filter("error IS NOT NULL").groupBy("api_id").agg(F.min_by(F.struct("error", "trace"), "file").alias("e")).collect()
    out = {r["api_id"]: IngestResult("", error=ValueError(r["e"]["error"]), trace=r["e"]["trace"]) for r in first}
    good = {source_id(s.name): s for s in work if source_id(s.name) not in out}
    if not good:
        return out
    if out:
        rows = rows.join(F.broadcast(store.spark.createDataFrame([(i,) for i in good], "api_id string")), "api_id", "left_semi")

    def rows_of(ids: list[str]) -> DataFrame:
        absolute = lambda p: None if p is None else p if "://" in p else os.path.abspath(p)
        known = [(i, good[i].name, None, absolute(good[i].spec), absolute(good[i].docs), found[i], None) for i in ids]
        known = store.spark.createDataFrame(known, NEW_SOURCE).drop("spec_content")
        text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
        specs = files.filter("spec").select(F.col("api_id").alias("id"), text.alias("spec_content"))
        return store.source_rows(known.join(specs, "id", "left"))

    return out | merge_sources(store, rows.drop("error", "trace"), list(good), rows_of, make, ("file", "seq"), catch=True)


def _one(results: list[IngestResult]) -> IngestResult:
    if results[0].error:
        raise results[0].error
    return results[0]


def ingest_api(store: IndexStore, name: str, spec: str, docs: str | None = None, force: bool = False, make: Callable | None = None) -> IngestResult:
    """Ingest a specification, with markdown files if docs names their folder."""
    return _one(ingest_sources(store, [Source(name, spec, docs)], force, make))


def ingest_docs(store: IndexStore, name: str, docs: str, force: bool = False, make: Callable | None = None) -> IngestResult:
    """Ingest a folder of markdown files."""
    return _one(ingest_sources(store, [Source(name, None, docs)], force, make))
