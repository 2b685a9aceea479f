"""The index store: segments of chunks and of their inverted index, deletions, and a commit log.

A store is a folder with a log (log.py) and immutable folders of parquet. A commit adds what is new: a segment with the chunks that were
added or changed, sorted by source and id, the part of the inverted index that they make, sorted by term, and the ids of stored chunks that
they replace or that are gone. Every row and every deletion carries the number of its commit; a deletion hides the rows of earlier ones.
Readers read all segments and leave out what is hidden, so a small change costs what is changed. Segments of one order of size are merged
when there are several, and what is hidden goes then. Corpus statistics are kept with the state, exactly, so ranking is that of a store
written at once. Readers hold the state that they opened.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CHUNK_TYPES, sanitize_query, token_list
from ..operators import fts, hybrid
from . import log

APIS = "id string, name string, version string, spec_path string, docs_path string, source_hash string, spec_content string, created_at string, updated_at string"
CHUNKS = "id string, api_id string, type string, title string, content string, content_hash string, metadata string, created_at string, embedding array<float>"
POSTINGS = "term string, id string, api_id string, type string, dl int, tf int, positions array<struct<col:int,pos:int>>"
#: What segments have beside those columns: the commit that a row is of, and (chunks) the number of its terms.
STORED_CHUNKS, STORED_POSTINGS = CHUNKS + ", dl int, seq long", POSTINGS + ", seq long"
DELETES = "id string, api_id string, dl int, seq long"
NEW_SOURCE = "id string, name string, version string, spec_path string, docs_path string, source_hash string, spec_content string"
DEFAULT_DIMENSION = 1024
#: Environment variable with the store's folder.
PATH_VARIABLE, DEFAULT_PATH = "DOCFATHOM_DB_PATH", "docfathom-index"
#: Segments of one order of size (TIER times the rows of the one before) that are merged, and folders of deletions or sources.
TIER, SEGMENTS_OF_A_TIER, FOLDERS = 8, 4, 8
#: Deletions that a reader broadcasts, at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DELETES = 200_000

_open: dict[str, IndexStore] = {}


def check_dimension(dimension) -> int:
    if isinstance(dimension, bool) or not isinstance(dimension, (int, float)) or dimension != int(dimension) or dimension < 1:
        raise ValueError(f"Invalid embedding dimension: {dimension}")
    return int(dimension)


class IndexStore:
    """open() gives the process's one store; instances made directly are independent of it."""

    def __init__(self, spark: SparkSession, path: str, dimension: int = DEFAULT_DIMENSION):
        self.spark, self.path = spark, path.rstrip("/")
        dimension = check_dimension(dimension)
        self.log = log.CommitLog(spark, self.path)
        self.refresh()
        if self.state is None:
            try:
                self.log.publish(0, {"state": log.empty(dimension)})
            except log.Conflict:  # another program has just made it
                pass
            self.refresh()
        self.require(dimension)

    # --- the process's store
    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, dimension: int = DEFAULT_DIMENSION) -> IndexStore:
        path = (path or os.environ.get(PATH_VARIABLE) or DEFAULT_PATH).rstrip("/")
        if held := _open.get("store"):
            if held.path != path:
                raise RuntimeError(f'Database already open at "{held.path}", cannot open "{path}". Call closeDb() first.')
            held.require(check_dimension(dimension))
            return held
        _open["store"] = cls(spark, path, dimension)
        return _open["store"]

    @staticmethod
    def close() -> None:
        _open.pop("store", None)

    @classmethod
    def temporary(cls, spark: SparkSession, dimension: int = DEFAULT_DIMENSION) -> IndexStore:
        """A store in a temporary folder of this machine, for a local master: executors elsewhere do not see it."""
        import tempfile

        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("a temporary store needs a local master: name a shared folder")
        return cls(spark, tempfile.mkdtemp(prefix="docfathom-index-"), dimension)

    def require(self, dimension: int) -> None:
        have = self.state["embedding_dimension"]
        if have != dimension:
            raise ValueError(f"Embedding dimension mismatch: database has {have}d vectors but provider requires {dimension}d. Re-index with: python -m docfathom.cli --all --force")

    # --- commits
    def refresh(self) -> None:
        self.version, self.state, self.layout = self.log.load()
        if self.layout == 1 and self.state["segments"]:  # that one kept no statistics
            rows = self._stored(self.state["segments"]).groupBy("api_id").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).collect()
            self.state["stats"] = {r[0]: [r[1], r[2]] for r in rows}

    def _place(self, part: dict, key: str = "path") -> str:
        return part[key] if "/" in part[key] else f"{self.path}/{part[key]}"

    def _write(self, df: DataFrame, name: str) -> str:
        """A new folder, named as the state names it."""
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def scratch(self, df: DataFrame) -> str:
        """A folder beside the segments with the rows of df, for drop()."""
        return f"{self.path}/{self._write(df, '_scratch')}"

    def drop(self, place: str) -> None:
        self.log.delete(place)

    def commit(self, sources: DataFrame | None = None, fresh: DataFrame | None = None, gone: DataFrame | None = None, dropped: list[str] = ()) -> None:
        """One commit: rows of the table of sources; chunks that are added or changed (CHUNKS, sorted by source and id if the reader is to
        skip); stored chunks that they replace or that are gone (id, api_id, dl); sources all of whose chunks go.

        What fails leaves the store as it was. Folders that this takes out of the state are deleted by the next commit, so that readers of
        the state before are not disturbed.
        """
        seq, made = self.version + 1, []
        stats = {a: list(v) for a, v in self.state["stats"].items()}
        commit: dict = {"segments": [], "deletes": [], "sources": [], "dropped": {}, "remove": []}

        def keep(df: DataFrame, name: str) -> str:
            made.append(self._write(df, name))
            return made[-1]

        try:
            for a in dropped:
                stats.pop(a, None)
                if any(a in s["apis"] for s in self.state["segments"]):
                    commit["dropped"][a] = seq
            works = {}
            if gone is not None:
                works["deletes"] = lambda: keep(gone.select("id", "api_id", F.col("dl").cast("int").alias("dl"), F.lit(seq).cast("long").alias("seq")), "deletes")
            if sources is not None:
                works["sources"] = lambda: keep(sources.coalesce(1).withColumn("seq", F.lit(seq).cast("long")), "sources")
            if fresh is not None:
                works["segments"] = lambda: self._segment(fresh, seq, keep)
            with ThreadPoolExecutor(3) as pool:  # jobs that need nothing of each other
                found = {k: w.result() for k, w in {k: pool.submit(inheritable_thread_target(w)) for k, w in works.items()}.items()}
            if "deletes" in found and (n := self._count(found["deletes"], DELETES, stats, -1)):
                commit["deletes"].append({"seq": seq, "path": found["deletes"], "rows": sum(n.values())})
            if found.get("segments"):
                segment, sizes = found["segments"]
                commit["segments"].append(segment)
                self._add(stats, sizes, 1)
            if "sources" in found:
                commit["sources"].append({"seq": seq, "path": found["sources"]})
            commit["stats"] = {a: stats.get(a) for a in {*stats, *self.state["stats"]} if stats.get(a) != self.state["stats"].get(a)}
            self._publish(commit)
        except Exception:
            for name in made:
                self.drop(f"{self.path}/{name}")
            raise
        self.compact()

    def _publish(self, commit: dict) -> None:
        """The next commit; a store of an earlier layout becomes one of this layout with it."""
        before, gone = self.state, commit.get("remove", [])
        paths = lambda x: [x[k] for k in ("path", "postings") if x.get(k)]
        commit["spent"] = [p for part in ("segments", "deletes", "sources") for x in before[part] if x["path"] in gone for p in paths(x)]
        after = log.applied(before, commit)
        self.log.publish(self.version + 1, {"state": after} if self.layout < log.LAYOUT else commit)
        old_layout = self.layout < log.LAYOUT
        self.state, self.version, self.layout = after, self.version + 1, log.LAYOUT
        if self.version % log.CHECKPOINT_EVERY == 0:
            self.log.checkpoint(self.version, after)
        if old_layout:
            self.log.delete("CURRENT")
        for name in before["spent"]:
            self.drop(self._place({"path": name}))

    @staticmethod
    def _add(stats: dict, sizes: dict, sign: int) -> None:
        for api, (n, dl) in sizes.items():
            old = stats.get(api, [0, 0])
            stats[api] = [old[0] + sign * n, old[1] + sign * dl]
            if not stats[api][0]:
                del stats[api]

    def _sizes(self, path: str, schema: str) -> dict[str, list[int]]:
        """Rows and their terms by source of a folder that was just written: a row for each source that changed."""
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{path}").groupBy("api_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        return {r["api_id"]: [r["n"], r["dl"]] for r in rows.collect()}

    def _count(self, path: str, schema: str, stats: dict, sign: int) -> dict[str, int]:
        sizes = self._sizes(path, schema)
        self._add(stats, sizes, sign)
        return {a: n for a, (n, _) in sizes.items()}

    def _segment(self, fresh: DataFrame, seq: int, keep) -> tuple[dict, dict] | None:
        """Write chunks and their part of the inverted index: what the state says of them, and their sizes by source."""
        mark = F.lit(seq).cast("long").alias("seq")
        path = keep(fresh.select(*[c for c in self._names(CHUNKS)], fts.length().alias("dl"), mark), "chunks")
        sizes = self._sizes(path, STORED_CHUNKS)
        if not sizes:
            return None
        toks = fts.tokenised(self.spark.read.schema(STORED_CHUNKS).parquet(f"{self.path}/{path}"))
        index = fts.postings(toks, by_chunk=True).select(*self._names(POSTINGS), mark)
        rows = sum(n for n, _ in sizes.values())
        return {"seq": seq, "path": path, "postings": keep(index.sortWithinPartitions("term", "id"), "postings"), "rows": rows, "apis": sorted(sizes)}, sizes

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [f.split()[0] for f in schema.replace("struct<col:int,pos:int>", "x").split(", ")]

    # --- compaction
    def _due(self) -> list[dict]:
        """Segments to merge: those of a tier that has several, or that were written without an index; oldest tiers last."""
        tiers: dict[int, list[dict]] = {}
        for s in self.state["segments"]:
            tiers.setdefault(int(math.log(max(1, s["rows"]), TIER)), []).append(s)
        due = [s for s in self.state["segments"] if not s["postings"]]
        for _, own in sorted(tiers.items()):
            if len(own) >= SEGMENTS_OF_A_TIER:
                due += [s for s in own if s not in due]
        hidden = sum(d["rows"] for d in self.state["deletes"])
        if hidden > sum(s["rows"] for s in self.state["segments"]) // 2:
            due = list(self.state["segments"])
        return due

    def compact(self, everything: bool = False) -> None:
        """Merge segments of one order of size, deletions and rows of sources, if there are several, in a commit of its own.

        Each row is rewritten once for each order of size that the store grows through. If another writer is faster, nothing is done.
        """
        due = list(self.state["segments"]) if everything else self._due()
        deletes, sources = self.state["deletes"], self.state["sources"]
        many = lambda parts: len(parts) >= (2 if everything else FOLDERS)
        if not (due or many(deletes) or many(sources) or (everything and deletes)):
            return
        seq, made, commit = self.version + 1, [], {"segments": [], "deletes": [], "sources": [], "dropped": {}, "remove": []}
        mark = F.lit(seq).cast("long").alias("seq")

        def keep(df: DataFrame, name: str) -> str:
            made.append(self._write(df, name))
            return made[-1]

        if due:
            rows = self._stored(due).repartitionByRange("api_id", "id").sortWithinPartitions("api_id", "id")
            path = keep(rows.select(*self._names(CHUNKS), "dl", mark), "chunks")
            n = self._count(path, STORED_CHUNKS, {}, 1)
            commit["remove"] += [s["path"] for s in due]
            if n:
                index = self._index(due).select(*self._names(POSTINGS), mark)
                index = index.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
                commit["segments"].append({"seq": seq, "path": path, "postings": keep(index, "postings"), "rows": sum(n.values()), "apis": sorted(n)})
            left = [s for s in self.state["segments"] if s not in due]
            oldest = min((s["seq"] for s in left), default=seq)
            commit["remove"] += [d["path"] for d in deletes if d["seq"] <= oldest]  # hide nothing any more
            deletes = [d for d in deletes if d["seq"] > oldest]
            commit["dropped"] = {a: None for a, at in self.state["dropped"].items() if at <= oldest or not any(a in s["apis"] for s in left)}
        if many(deletes):
            rows = self.spark.read.schema(DELETES).parquet(*map(self._place, deletes))
            commit["remove"] += [d["path"] for d in deletes]
            commit["deletes"].append({"seq": max(d["seq"] for d in deletes), "path": keep(rows.coalesce(max(1, len(deletes) // FOLDERS)), "deletes"), "rows": sum(d["rows"] for d in deletes)})
        if many(sources):
            commit["remove"] += [s["path"] for s in sources]
            commit["sources"].append({"seq": seq, "path": keep(self._sources().coalesce(1), "sources")})
        try:
            self._publish(commit)
        except Exception as e:
            for name in made:
                self.drop(f"{self.path}/{name}")
            if not isinstance(e, log.Conflict):
                raise
            self.refresh()

    # --- what the segments show
    def _shown(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows of segments that no later commit hides."""
        oldest = min(s["seq"] for s in segments)
        for a, at in self.state["dropped"].items():
            if at > oldest and any(a in s["apis"] for s in segments):
                rows = rows.filter((F.col("api_id") != a) | (F.coalesce("seq", F.lit(0)) >= at))
        later = [d for d in self.state["deletes"] if d["seq"] > oldest]
        if not later:
            return rows
        hidden = self.spark.read.schema(DELETES).parquet(*map(self._place, later)).select(F.col("id").alias("_id"), F.col("api_id").alias("_api"), F.col("seq").alias("_seq"))
        if sum(d["rows"] for d in later) <= BROADCAST_DELETES:
            hidden = F.broadcast(hidden)
        return rows.join(hidden, (F.col("id") == F.col("_id")) & (F.col("api_id") == F.col("_api")) & (F.coalesce("seq", F.lit(0)) < F.col("_seq")), "left_anti")

    def _stored(self, segments: list[dict]) -> DataFrame:
        """The chunks that some segments show, with dl and seq (null in rows of earlier layouts: dl is counted then)."""
        if not segments:
            return self.spark.createDataFrame([], STORED_CHUNKS)
        rows = self.spark.read.schema(STORED_CHUNKS).parquet(*map(self._place, segments))
        if any(not s["seq"] for s in segments):
            rows = rows.withColumn("dl", F.coalesce("dl", fts.length()))
        return self._shown(rows, segments)

    def _index(self, segments: list[dict]) -> DataFrame:
        """The postings that some segments show; what was written without an index is indexed on the way."""
        with_index = [s for s in segments if s["postings"]]
        out = self.spark.createDataFrame([], STORED_POSTINGS)
        if with_index:
            out = self._shown(self.spark.read.schema(STORED_POSTINGS).parquet(*[self._place(s, "postings") for s in with_index]), with_index)
        if bare := [s for s in segments if not s["postings"]]:
            out = out.unionByName(fts.postings(fts.tokenised(self._stored(bare))).withColumn("seq", F.lit(0).cast("long")).select(*out.columns))
        return out

    def _sources(self) -> DataFrame:
        """The latest row of each source, with the commit it is of."""
        if not self.state["sources"]:
            return self.spark.createDataFrame([], APIS + ", seq long")
        rows = self.spark.read.schema(APIS + ", seq long").parquet(*map(self._place, self.state["sources"]))
        if len(self.state["sources"]) == 1:
            return rows
        last = Window.partitionBy("id").orderBy(F.desc(F.coalesce("seq", F.lit(0))))
        return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    # --- reading
    def apis(self) -> DataFrame:
        """All sources by name."""
        return self._sources().drop("seq").orderBy("name")

    def get_apis(self) -> list[dict]:
        return [r.asDict() for r in self.apis().drop("source_hash").collect()]

    def source_hash(self, api_id: str) -> str | None:
        row = self.apis().filter(F.col("id") == api_id).select("source_hash").first()
        return row[0] if row else None

    def spec_content(self, name: str) -> str | None:
        row = self.apis().filter(F.col("name") == name).select("spec_content").first()
        return row[0] if row else None

    def stored(self, api_ids=None) -> DataFrame:
        """The chunks of some sources, or all, with dl (their terms): only segments that hold them are read, and their row groups."""
        segments = [s for s in self.state["segments"] if not api_ids or any(a in s["apis"] for a in api_ids)]
        rows = self._stored(segments)
        return rows.filter(F.col("api_id").isin(*api_ids)) if api_ids else rows

    def chunks(self, api_ids=None) -> DataFrame:
        return self.stored(api_ids).select(*self._names(CHUNKS))

    def chunks_by_api(self, api_id: str, kind: str | None = None) -> DataFrame:
        rows = self.chunks([api_id]).filter(F.col("api_id") == api_id)
        return (rows.filter(F.col("type") == kind) if kind else rows).orderBy("id")

    def _sources_of(self, *ids: str) -> list[str] | None:
        """The sources that hold chunks of these ids, if the ids begin with the sources' own, as ingested ones do."""
        known = {i.split(":", 1)[0] for i in ids}
        return sorted(known) if known <= self.state["stats"].keys() else None

    def chunk_by_id(self, ident: str) -> dict | None:
        row = self.chunks(self._sources_of(ident)).filter(F.col("id") == ident).first()
        return read_chunk(row) if row else None

    def chunks_by_ids(self, ids: list[str]) -> list[dict]:
        if not ids:
            return []
        return [read_chunk(r) for r in self.chunks(self._sources_of(*ids)).filter(F.col("id").isin(*ids)).collect()]

    # --- writing
    def upsert_api(self, api: dict) -> None:
        self.commit(self.source_rows([api]))

    def source_rows(self, apis: list[dict] | DataFrame) -> DataFrame:
        """Rows of the table of sources, checked against those that are stored; a stored source keeps the time of its creation."""
        fields = self._names(NEW_SOURCE)
        new = self.spark.createDataFrame([tuple(a.get(k) for k in fields) for a in apis], NEW_SOURCE) if isinstance(apis, list) else apis
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        held = self._sources().select("id", "name", "created_at")
        names = held.select(F.col("id").alias("_id"), "name").unionByName(new.select(F.col("id").alias("_id"), "name"))
        if new.join(names, "name").filter("id <> _id").limit(1).count():
            raise ValueError("UNIQUE constraint failed: apis.name")
        new = new.join(held.select("id", F.col("created_at").alias("_old")), "id", "left")
        return new.select(*fields, F.coalesce("_old", now).alias("created_at"), now.alias("updated_at"))

    def upsert_chunks(self, rows: DataFrame) -> None:
        """Insert or replace chunks (CHUNKS without created_at); a stored chunk keeps its source and the time of its creation."""
        new = rows.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).select(*self._names(CHUNKS))
        found = self.stored().join(rows.select("id"), "id", "left_semi").select("id", F.col("api_id").alias("_api"), F.col("created_at").alias("_created"), "dl").persist()
        new = new.join(found.drop("dl"), "id", "left").withColumn("api_id", F.coalesce("_api", "api_id")).withColumn("created_at", F.coalesce("_created", "created_at"))
        new = new.select(*self._names(CHUNKS)).persist()
        try:
            if new.join(self._sources().select(F.col("id").alias("api_id")), "api_id", "left_anti").limit(1).count():
                raise ValueError("FOREIGN KEY constraint failed")
            gone = found.select("id", F.col("_api").alias("api_id"), "dl")
            self.commit(fresh=new, gone=gone if found.limit(1).count() else None)
        finally:
            new.unpersist()
            found.unpersist()

    def delete_chunk(self, ident: str) -> None:
        """Writes one deletion, whatever the size of the source."""
        gone = self.stored(self._sources_of(ident)).filter(F.col("id") == ident).select("id", "api_id", "dl").collect()
        if gone:
            self.commit(gone=self.spark.createDataFrame(gone, "id string, api_id string, dl int").coalesce(1))

    def delete_chunks_by_api(self, api_id: str) -> None:
        """Writes nothing but the commit."""
        self.commit(dropped=[api_id])

    # --- search
    def index(self, query: str | None = None) -> DataFrame:
        """The inverted index; with a query, its terms only, so that the reader skips other row groups."""
        rows = self._index(self.state["segments"]).drop("seq")
        if query is None:
            return rows
        terms = sorted({t for w in sanitize_query(query) for t in token_list(w)})
        return rows.filter(F.col("term").isin(*terms)) if terms else rows.limit(0)

    def stats(self) -> DataFrame:
        n, dl = (sum(x[i] for x in self.state["stats"].values()) for i in (0, 1))
        return self.spark.createDataFrame([(n, dl / n if n else 0.0)], "n long, avgdl double")

    def search(self, query: str, vector, options: hybrid.SearchOptions = hybrid.SearchOptions(), mode: str = "post") -> list[dict]:
        """Chunks with their scores, best first."""
        rows = self.chunks()
        found = hybrid.search(query, vector, rows.select("id", "api_id", "type"), rows.select("id", "embedding"), self.index(query), self.stats(), options, mode)
        hits = [r.asDict() for r in found.orderBy("position").collect()]  # at most options.limit
        by_id = {c["id"]: c for c in self.chunks_by_ids([h["id"] for h in hits])}
        return [{"chunk": by_id[h["id"]], "score": h["score"]} for h in hits if h["id"] in by_id]


def read_chunk(row) -> dict:
    """A chunk on the driver, with its type checked and its metadata parsed."""
    c = row.asDict()
    if c["type"] not in CHUNK_TYPES:
        raise ValueError(f'Invalid chunk type "{c["type"]}" in chunk "{c["id"]}"')
    if c["metadata"] is not None:
        try:
            c["metadata"] = json.loads(c["metadata"])
        except ValueError as e:
            raise ValueError(f'Corrupted metadata JSON in chunk "{c["id"]}": {e}') from e
    return c
