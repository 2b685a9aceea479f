"""Training-order materialisation: token sequences in a keyed random order, as binary shards of fixed stride.

The token streams of the documents are cut into sequences; sequence number i of N goes to slot permute(i), a Feistel network over the
next even power of two, walked on until it lands below N. A shard holds a fixed range of slots, so the slot alone tells file and offset, and
a reader that stopped at a slot goes on from there. A task sends what it has for a shard as one compressed value; the shard's task puts
the records in slot order and writes the file under its final name only when it is whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange, shared
from .hashing import mix

ROUNDS = 6
#: Bytes of shards that a task reads back.
READ_BYTES = 16 << 20
#: What a record's header holds where the document's id is null.
NO_ID = -(2**63)
HEADER = np.dtype([("doc", "<i8"), ("start", "<i8"), ("length", "<u4"), ("check", "<u4")])
INDEX = "shard long, file string, first_slot long, sequences int"


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below n: a bijection of 0 to n - 1 that depends on the key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64))
    out, left = i.astype(np.uint64), np.arange(len(i))
    while len(left):
        x = out[left]
        hi, lo = x >> np.uint64(half), x & mask
        for k in keys:
            hi, lo = lo, hi ^ (mix(lo ^ k) & mask)
        out[left] = hi << np.uint64(half) | lo
        left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def _cut(path: str, size: int, end_id: int):
    """Sequences of a block: number, id of the document it begins in, place there, length, ids."""

    def run(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        encode, block, end = encoder(path).encode, TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        number, held, first, begin = 0, b"", NO_ID, 0
        for batch in batches:
            for part in shared.slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids, at = np.frombuffer(encode(text or "") + end, np.uint32).astype("<u2").tobytes(), 0  # materialise() has made sure that they fit
                    doc = NO_ID if doc is None else doc
                    if not held:
                        first, begin = doc, 0
                    while len(held) + len(ids) - at >= 2 * size:
                        take = 2 * size - len(held)
                        rows.append((number, first, begin, size, held + ids[at : at + take]))
                        number, at, held = number + 1, at + take, b""
                        first, begin = doc, at // 2
                    held += ids[at:]
                yield _sequences(block, rows)
        if held:
            yield _sequences(block, [(number, first, begin, len(held) // 2, held)])

    return run


def _sequences(block: int, rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array([block] * len(rows), pa.int32()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["block", "number", "doc", "start", "length", "ids"])


def _send(bases: dict[int, int], n: int, key: int, size: int, per_shard: int):
    stride = HEADER.itemsize + 2 * size

    def run(batches):
        from zlib import crc32

        held: list[tuple[np.ndarray, bytes]] = []
        codec = pa.Codec("zstd", compression_level=6)

        def flush():
            slots = np.concatenate([s for s, _ in held])
            records = np.frombuffer(b"".join(r for _, r in held), np.uint8).reshape(-1, stride)
            order = np.argsort(slots)
            slots, records = slots[order], records[order]
            shards = slots // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(slots)]
            rows = [(int(shards[a]), slots[a:b].tobytes(), codec.compress(records[a:b].tobytes(), asbytes=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "slots", "records"])

        for batch in batches:
            for b, part in exchange.by_block(batch):
                slots = permute(part.column("number").to_numpy() + bases[b], n, key)
                ids = part.column("ids").to_pylist()
                head = np.zeros(len(ids), HEADER)
                head["doc"], head["start"], head["length"] = (part.column(c).to_numpy() for c in ("doc", "start", "length"))
                head["check"] = [crc32(x) for x in ids]
                heads = head.tobytes()
                k = HEADER.itemsize
                held.append((slots, b"".join(heads[i * k : i * k + k] + x.ljust(2 * size, b"\0") for i, x in enumerate(ids))))
                if sum(len(r) for _, r in held) > 32 << 20:
                    yield flush()
        if held:
            yield flush()

    return run


def _write(folder: str, size: int, per_shard: int):
    stride = HEADER.itemsize + 2 * size

    def run(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        shard = int(table.column("shard")[0].as_py())
        slots = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("slots").to_pylist()])
        counts = [len(x) // 8 for x in table.column("slots").to_pylist()]
        raw = b"".join(pa.decompress(x, n * stride, "zstd", asbytes=True) for x, n in zip(table.column("records").to_pylist(), counts, strict=True))
        records = np.frombuffer(raw, np.uint8).reshape(-1, stride)[np.argsort(slots)]
        slots = np.sort(slots)
        if (slots != shard * per_shard + np.arange(len(slots))).any():
            raise ValueError(f"shard {shard} has gaps")
        system, root = shared.filesystem(folder)
        system.create_dir(root, recursive=True)
        name = f"shard-{shard:08d}.bin"
        attempt = f"{root}/_{name}-{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(attempt, compression=None) as f:
            f.write(records.tobytes())
        system.move(attempt, f"{root}/{name}")
        return pa.table({"shard": pa.array([shard], pa.int64()), "file": pa.array([name], pa.string()), "first_slot": pa.array([shard * per_shard], pa.int64()), "sequences": pa.array([len(slots)], pa.int32())})

    return run


def materialise(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 1024, key: int = 20240229, per_shard: int = 4096, end_id: int = 1) -> DataFrame:
    """Write all texts as shards in folder (a shared one); returns the index of shards (INDEX), staged.

    A text's tokens are its ids by the tokenizers file, and end_id; a file with ids over 65,535 is refused, as is such an end_id. The streams of one input partition follow each
    other in sequences of `size` tokens, the partition's last may be shorter (its record is filled with zeros). Null texts are empty,
    null ids are NO_ID, equal rows are written each, other columns are not read; an empty table writes nothing.
    """
    from .tokens import default_path, largest_id

    if max(largest_id(tokenizer or default_path()), end_id) > 0xFFFF:
        raise ValueError("shards hold ids of 16 bits: the tokenizer or end_id has larger ones")
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    staged = shared.stage(rows.mapInArrow(_cut(tokenizer or default_path(), size, end_id), "block int, number long, doc long, start long, length int, ids binary"), "sequences")
    counts = sorted((r["block"], r["n"]) for r in staged.groupBy("block").agg(F.count("*").alias("n")).collect())  # a row per input partition
    bases, n = {}, 0
    for block, k in counts:
        bases[block], n = n, n + k
    sent = staged.mapInArrow(_send(bases, n, key, size, per_shard), "shard long, slots binary, records binary")
    index = shared.stage(sent.groupBy("shard").applyInArrow(_write(folder, size, per_shard), INDEX), "shards")
    shared.discard(staged)
    return index


ROWS = "slot long, doc_id long, start long, length int, ids binary"


def parse(data: bytes, first_slot: int, size: int) -> list[dict]:
    """The records of a stretch of a shard."""
    from zlib import crc32

    stride = HEADER.itemsize + 2 * size
    out = []
    for k in range(len(data) // stride):
        head = np.frombuffer(data, HEADER, 1, k * stride)[0]
        ids = data[k * stride + HEADER.itemsize :][: 2 * int(head["length"])]
        if crc32(ids) != head["check"]:
            raise ValueError(f"the record at slot {first_slot + k} is damaged")
        doc = int(head["doc"])
        out.append({"slot": first_slot + k, "doc_id": None if doc == NO_ID else doc, "start": int(head["start"]), "length": int(head["length"]), "ids": ids})
    return out


def read_from(folder: str, slot: int, per_shard: int, size: int, count: int | None = None):
    """Sequences in training order, from a slot on: where a reader that stopped goes on."""
    stride = HEADER.itemsize + 2 * size
    system, root = shared.filesystem(folder)
    while count is None or count > 0:
        path = f"{root}/shard-{slot // per_shard:08d}.bin"
        if system.get_file_info(path).type.name != "File":
            return
        with system.open_input_file(path) as f:
            at = slot % per_shard
            have = f.size() // stride - at
            n = min(have, 64 if count is None else min(count, 64))
            if n <= 0:
                return
            rows = parse(f.read_at(n * stride, at * stride), slot, size)
        yield from rows
        slot += n
        count = None if count is None else count - n


def _read(folder: str, size: int):
    stride = HEADER.itemsize + 2 * size
    schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        system, root = shared.filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as f:
                    for at in range(0, row["sequences"], 512):
                        n = min(512, row["sequences"] - at)
                        data = f.read_at(n * stride, at * stride)
                        for k in range(0, n, 512):
                            yield pa.RecordBatch.from_pylist(parse(data, row["first_slot"] + at, size)[k : k + 512], schema=schema)

    return run


def read_shards(spark: SparkSession, folder: str, index: DataFrame, size: int = 1024) -> DataFrame:
    """All sequences (ROWS), shard by shard. index is staged; a task reads about READ_BYTES, by the sequences that the index names."""
    held = index.agg(F.count("*").alias("shards"), F.sum("sequences").alias("sequences")).first()
    stride = HEADER.itemsize + 2 * size
    tasks = max(1, min(held["shards"], -(-(held["sequences"] or 0) * stride // READ_BYTES)))
    return index.repartition(tasks, F.col("shard")).select("file", "first_slot", "sequences").mapInArrow(_read(folder, size), ROWS)
