"""Command line: ingest one API, or all entries of a registry."""

from __future__ import annotations

import argparse
import os
import sys
import time

from .sources import embed
from .sources.ingest import Source, format_duration, format_result, ingest_api, ingest_sources
from .sources.registry import load_registry
from .sources.store import IndexStore

REGISTRY_VARIABLE = "DOCFATHOM_REGISTRY_PATH"


class CliError(Exception):
    pass


def run(spark, api=None, spec=None, docs=None, all_entries=False, registry=None, force=False, out=print, err=None) -> int:
    """Returns the exit code; CliError for wrong arguments."""
    err = err or (lambda text: print(text, file=sys.stderr))
    try:
        if all_entries:
            path = os.path.abspath(registry or os.environ.get(REGISTRY_VARIABLE) or "apis.yml")
            if not os.path.exists(path):
                raise CliError(f"registry not found: {path}")
            begin, entries = time.perf_counter(), load_registry(path)
            work = [Source(e.name, e.spec, e.docs) for e in entries.apis] + [Source(e.name, None, e.path) for e in entries.docs]
            results, failed = [], 0
            for r in ingest_sources(IndexStore.open(spark, dimension=embed.get_dimension()), work, force) if work else []:
                out(f"Ingesting {r.api}...")
                if r.error:
                    failed += 1
                    err(f"  Error ingesting {r.api}: {r.error}")
                    err(r.trace)
                    continue
                results.append(r)
                out("  unchanged, skipping" if r.unchanged else format_result(r))
            out(summary(results, failed, 1000 * (time.perf_counter() - begin)))
            return 1 if failed else 0
        if not (api and spec):
            raise CliError("provide --api and --spec, or --all")
        out(f"Ingesting {api}...")
        r = ingest_api(IndexStore.open(spark, dimension=embed.get_dimension()), api, spec, docs, force)
        out("  unchanged, skipping" if r.unchanged else format_result(r))
        out(f"Done in {format_duration(r.duration_ms)}.")
        return 0
    finally:
        IndexStore.close()


def summary(results, failed: int, ms: float) -> str:
    total, embedded, skipped, deleted = (sum(getattr(r, k) for r in results) for k in ("total", "embedded", "skipped", "deleted"))
    n, same = len(results), sum(r.unchanged for r in results)
    text = f"\nDone. {n} entr{'y' if n == 1 else 'ies'} processed" + (f", {same} unchanged" if same else "")
    text += f", {total} chunks ({embedded} embedded, {skipped} skipped, {deleted} deleted)" + (f", {failed} failed" if failed else "")
    return text + f" in {format_duration(ms)}" + (f" ({embedded / (ms / 1000):.1f} chunks/s)" if embedded and ms > 0 else "")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("ingest", description="Index API documentation")
    p.add_argument("--api", help="API name")
    p.add_argument("--spec", help="path to an OpenAPI file")
    p.add_argument("--docs", help="folder of markdown files")
    p.add_argument("--all", action="store_true", help="ingest all entries of the registry")
    p.add_argument("--registry", help="path to the registry (default: apis.yml)")
    p.add_argument("--force", action="store_true", help="ingest unchanged sources too")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docfathom-ingest").getOrCreate()
    try:
        return run(spark, a.api, a.spec, a.docs, a.all, a.registry, a.force)
    except CliError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
