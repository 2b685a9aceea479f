"""A tool server over standard input and output: python -m docfathom.server"""

from __future__ import annotations

import signal
import sys

from .sources import embed
from .sources.store import IndexStore
from .sources.tools import serve


class _Stop(Exception):
    pass


def run(spark, lines, write, err, open_store=None) -> int:
    """Serve until the lines end or the process is told to stop; returns the exit code. A store that cannot be opened is reported on err."""
    try:
        store = (open_store or (lambda: IndexStore.open(spark, dimension=embed.get_dimension())))()
    except Exception as e:
        err(f"docfathom startup failed: {e}\n")
        return 1
    try:
        serve(store, lines, write)
    except _Stop:
        pass
    except OSError as e:
        err(f"docfathom lost its connection: {e}\n")
        return 1
    finally:
        IndexStore.close()
    return 0


def main() -> int:
    from pyspark.sql import SparkSession

    def stop(*_):
        raise _Stop

    spark = SparkSession.builder.appName("docfathom-server").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, stop)
    return run(spark, sys.stdin, lambda text: print(text, flush=True), sys.stderr.write)


if __name__ == "__main__":
    sys.exit(main())
