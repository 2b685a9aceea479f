"""Streaming ingestion of markdown files (an extension): what changes in a folder is merged into the store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import markdown
from ..sources.formats import register
from ..sources.ingest import merge_sources
from ..sources.store import IndexStore


def merge_files(store: IndexStore, api: dict, files: DataFrame, make: Callable | None = None) -> None:
    """Make the stored chunks of some files (path, content; null: the file is gone) those of their contents, in one commit.

    Chunks know the file that they are from. Those of the given files that are no longer in them are deleted; unchanged ones are neither
    embedded nor written. Doing it again changes nothing.
    """
    place = store.scratch(files.select("path", "content"))
    try:
        files = store.spark.read.schema("path string, content string").parquet(place)
        chunks = markdown.split_frame(files.filter("content IS NOT NULL").withColumn("api_id", F.lit(api["id"])))
        of = F.get_json_object("metadata", "$.filePath")
        held = store.stored([api["id"]]).join(files.select("path").distinct(), of == F.col("path"), "left_semi")
        merge_sources(store, chunks, [api["id"]], lambda _: None, make, held=held)
    finally:
        store.drop(place)


def watch_markdown(store: IndexStore, folder: str, api: dict, checkpoint: str, make: Callable | None = None, once: bool = True) -> StreamingQuery:
    """Keep a source as a folder of markdown files is: files that are new, changed or gone. A batch that runs again gives the same store."""
    register(store.spark)
    if api["id"] not in {a["id"] for a in store.get_apis()}:
        store.upsert_api(api)
    files = store.spark.readStream.format("markdown").schema("path string, content string").option("path", folder).load()

    def merge_batch(batch: DataFrame, _epoch: int) -> None:
        merge_files(store, api, batch, make)

    writer = files.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
