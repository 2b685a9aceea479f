"""WARC archives with a two-level capture index.

Captures are sorted by key (host reversed, then path and query; then page id) and written in that order, one archive per range of keys, one
gzip member per record. Beside each archive lies its part of the index: lines of key, page id, place and length, in compressed blocks
of BLOCK_LINES lines. The block directory has one line per block (its first key, and where it is) and lies beside the archive as well. A
lookup finds the archives by bisection over their first keys, the blocks by bisection over the archive's part of the directory, the
lines by bisection in the block, and reads one range of the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, shared

BLOCK_LINES = 500
#: Blocks that a task reads in a lookup of many URLs, about, and bytes of an archive read at once.
BLOCKS_AT_ONCE, RANGE_BYTES = 8, 4 << 20
#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

DIRECTORY = "archive string, index string, block int, first_key string, first_id long, offset long, length int, lines int"
PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sort_key(url: str | None) -> str:
    """Reversed host, then port, path and query: com,example,www)/a?b. Without a host, the URL itself after '-'."""
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m or not m[1]:
        return f"-{url or ''}"
    return f"{','.join(reversed(m[1].lower().split('.')))}{m[2] or ''}){m[3] or '/'}"


def record_id(page_id: int | None) -> str:
    """A URN that holds the page id: 64 bits of it around the fixed bits of a version-8 UUID."""
    if page_id is None:
        return "urn:uuid:00000000-0000-8000-8000-00000000ffff".replace("0000ffff", "ffffffff")
    n = page_id & (2**64 - 1)
    return f"urn:uuid:{uuid.UUID(int=(n >> 32) << 96 | 8 << 76 | 2 << 62 | 1 << 48 | (n & 0xFFFFFFFF))}"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>")[9:]).int
    if not n >> 48 & 1:
        return None
    n = (n >> 96) << 32 | n & 0xFFFFFFFF
    return n - 2**64 if n >= 2**63 else n


def _line(value: str) -> str:
    """A header value on one line: percent-encoded controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response or revisit record, as one gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """A page's row from the bytes of its record."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    h = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http + b"\r\n")[1])
    digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
    kind = h["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
    return {
        "page_id": page_of(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(h["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _escape(key: str) -> str:
    return key.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t")


def _records(revisits: str):
    """(key, page_id, uid, data): each page's record, given the pages that revisits (by block) refers to others."""

    def run(batches):
        block, refers = None, {}
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block:
                    got, block = exchange.read_block(revisits, b, ["uid", "refers_to"]), b
                    refers = dict(zip(got["uid"], got["refers_to"], strict=True))
                for part in shared.slices(rows, "payload"):
                    uid, page, url, payload = (part.column(c).to_pylist() for c in ("uid", "page_id", "url", "payload"))
                    data = [record(p, u, x, hashlib.sha1(x).hexdigest(), refers.get(i)) for i, p, u, x in zip(uid, page, url, payload, strict=True)]
                    yield pa.record_batch([pa.array(map(sort_key, url), pa.string()), part.column("page_id"), part.column("uid"), pa.array(data, pa.binary())], names=["key", "page_id", "uid", "data"])

    return run


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}"
        system, root = shared.filesystem(folder)
        system.create_dir(root, recursive=True)
        attempt = f"{root}/_{name}-{context.taskAttemptId()}"
        rows, lines, at, index_at = [], [], 0, 0
        with system.open_output_stream(f"{attempt}.warc.gz", compression=None) as archive, system.open_output_stream(f"{attempt}.idx", compression=None) as index:

            def close() -> None:
                nonlocal index_at
                block = zlib.compress("".join(x for _, _, x in lines).encode(), 6)
                index.write(block)
                rows.append((len(rows), lines[0][0], lines[0][1], index_at, len(block), len(lines)))
                index_at += len(block)
                lines.clear()

            for batch in batches:
                for part in shared.slices(batch, "data"):
                    for key, page, data in zip(*(part.column(c).to_pylist() for c in ("key", "page_id", "data")), strict=True):
                        archive.write(data)
                        lines.append((key, page, f"{_escape(key)}\t{'' if page is None else page}\t{at}\t{len(data)}\n"))
                        at += len(data)
                        if len(lines) == BLOCK_LINES:
                            close()
            if lines:
                close()
        with system.open_output_stream(f"{attempt}.dir", compression=None) as directory:
            directory.write("".join(f"{_escape(r[1])}\t{r[3]}\t{r[4]}\n" for r in rows).encode())
        for end in ("warc.gz", "idx", "dir"):  # a task that runs again replaces its files by equal ones
            if rows:
                system.move(f"{attempt}.{end}", f"{root}/{name}.{end}")
            else:
                system.delete_file(f"{attempt}.{end}")
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.record_batch(
            [pa.array([f"{name}.warc.gz"] * len(rows)), pa.array([f"{name}.idx"] * len(rows)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
            names=["archive", "index", "block", "first_key", "first_id", "offset", "length", "lines"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page to archives in folder (a shared one); returns the block directory (DIRECTORY), staged.

    The payload is the text in UTF-8 (null: empty). Of payloads of at least REVISIT_BYTES that are equal, the page with the largest id
    is the response and the others refer to it; rows with that same id are responses too, and so are all if no id is known. A null URL
    sorts first and is left out of the record; a null id is kept as such. Equal rows are records of their own. Only digests and ids are
    joined; payloads move once, as compressed records, to the archive of their key.
    """
    spark = pages.sparkSession
    shared.small_batches(spark, 500)
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base, _ = exchange.blocks(rows, "pages")
    same = F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload")).alias("same")
    large = shared.stage(base.filter(F.octet_length("payload") >= REVISIT_BYTES).select("uid", "block", "page_id", same), "digests")
    kept = large.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    kept = shared.stage(kept, "payloads")
    total = max(1, kept.agg(F.sum("n")).first()[0] or 0)
    revisits = shared.split_join(large, kept, "same", "n", total).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = shared.stage(revisits.select("uid", "block", F.col("first").alias("refers_to")).repartition(F.col("block")), "revisits", "block")
    records = shared.stage(base.mapInArrow(_records(shared.path_of(revisits)), "key string, page_id long, uid long, data binary"), "records")
    shared.discard(base, large, kept, revisits)
    order = ("key", "page_id", "uid")
    ranged = records.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).select("key", "page_id", "data")
    directory = shared.stage(ranged.mapInArrow(_write(folder), DIRECTORY), "directory")
    shared.discard(records)
    return directory


_ESCAPED = re.compile(r"\\(.)")


def _unescape(key: str) -> str:
    return _ESCAPED.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), key) if "\\" in key else key


class Captures:
    """The archives of a folder, for lookups: the first key of each archive is held, its part of the directory and the block searched
    last are read when they are needed.
    """

    def __init__(self, folder: str, archives: list[tuple[str, str]]):
        self.system, self.root = shared.filesystem(folder)
        self.archives = sorted((key.encode(), name) for key, name in archives)
        self.firsts = [key for key, _ in self.archives]
        self.directory: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple[str, int] | None, list] = (None, [])

    def _blocks(self, name: str) -> tuple[list[tuple[int, int]], list[bytes]]:
        """Place and length of each block of an archive, and the first keys: read once for all keys that are looked up in it."""
        if self.directory[0] != name:
            with self.system.open_input_file(f"{self.root}/{name.removesuffix('.warc.gz')}.dir") as f:
                lines = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
            self.directory = (name, [(int(at), int(n)) for _, at, n in lines], [_unescape(key).encode() for key, _, _ in lines])
        return self.directory[1:]

    @staticmethod
    def _span(firsts, want: bytes) -> range:
        """Where a key may be, by first keys: it may begin in the part before the first that is not less."""
        return range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want))

    def places(self, key: str):
        """(archive, block) of each block that may hold a key."""
        want = key.encode()
        for a in self._span(self.firsts, want):
            name = self.archives[a][1]
            for b in self._span(self._blocks(name)[1], want):
                yield name, b

    def lines(self, name: str, block: int, key: str) -> list[tuple[int, int]]:
        """Place and length in the archive of a block's records with a key."""
        if self.block[0] != (name, block):
            at, n = self._blocks(name)[0][block]
            with self.system.open_input_file(f"{self.root}/{name.removesuffix('.warc.gz')}.idx") as f:
                rows = [x.split("\t") for x in zlib.decompress(f.read_at(n, at)).decode().split("\n")[:-1]]
            self.block = ((name, block), [(_unescape(k).encode(), int(at), int(n)) for k, _, at, n in rows])
        want, rows = key.encode(), self.block[1]
        lo = bisect.bisect_left(rows, want, key=lambda x: x[0])
        return [x[1:] for x in rows[lo : bisect.bisect_right(rows, want, lo, key=lambda x: x[0])]]

    def read(self, name: str, spans: list[tuple[int, int]]):
        """The records at ascending places of an archive; neighbours are read as one range of about RANGE_BYTES."""
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            i = 0
            while i < len(spans):
                z = i + 1
                while z < len(spans) and spans[z][0] == sum(spans[z - 1]) and sum(spans[z]) - spans[i][0] <= RANGE_BYTES:
                    z += 1
                lo = spans[i][0]
                data = f.read_at(sum(spans[z - 1]) - lo, lo)
                yield from (parse(data[at - lo : at - lo + n]) for at, n in spans[i:z])
                i = z


_PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _keys(batches):
    for batch in batches:
        yield pa.record_batch([pa.array(map(sort_key, batch.column("url").to_pylist()), pa.string())], names=["key"])


def _find(folder: str, archives: list[tuple[str, str]]):
    def run(batches):
        captures = Captures(folder, archives)
        for batch in batches:
            rows = [(name, block, key) for key in batch.column("key").to_pylist() for name, block in captures.places(key)]
            for k in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array([r[i] for r in rows[k : k + 10_000]], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["archive", "block", "key"])

    return run


def _fetch(folder: str):
    def run(batches):
        captures = Captures(folder, [])
        for batch in batches:
            asked: dict[tuple[str, int], list[tuple[int, int]]] = {}
            for name, block, key in zip(*(batch.column(c).to_pylist() for c in ("archive", "block", "key")), strict=True):
                asked.setdefault((name, block), []).extend(captures.lines(name, block, key))
            for (name, _), spans in asked.items():
                held, size = [], 0
                for row in captures.read(name, spans):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size > shared.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=_PAGE_ARROW)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_PAGE_ARROW)

    return run


def _archives(directory: DataFrame) -> list[tuple[str, str]]:
    """First key and name of each archive: as many as there are partitions in the write."""
    return [(r["first_key"], r["archive"]) for r in directory.filter("block = 0").select("first_key", "archive").collect()]


def lookup(urls: DataFrame, folder: str, directory: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures (PAGE) of the URLs in a column, each once; payload is null for revisits. A null URL asks for those without one.

    Keys are sorted, so that a task walks along a stretch of the directory; what is found there goes to one of many tasks by block, so
    that a URL with very many captures is spread.
    """
    keys = urls.select(F.col(url_col).alias("url")).mapInArrow(_keys, "key string").distinct()
    places = keys.repartitionByRange(F.col("key")).sortWithinPartitions("key").mapInArrow(_find(folder, _archives(directory)), "archive string, block int, key string")
    tasks = max(1, -(-directory.count() // BLOCKS_AT_ONCE))
    return places.repartition(tasks, F.col("archive"), F.col("block")).sortWithinPartitions("archive", "block", "key").mapInArrow(_fetch(folder), PAGE)


class CaptureIndex:
    """Looks up single URLs."""

    def __init__(self, folder: str, directory: DataFrame):
        self.captures = Captures(folder, _archives(directory))

    def lookup(self, url: str | None) -> list[dict]:
        key = sort_key(url)
        return [row for name, block in self.captures.places(key) for row in self.captures.read(name, self.captures.lines(name, block, key))]
