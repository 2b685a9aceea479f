"""Substring dedup by level-wise doubling.

A window of `window` words is a candidate while every level finds it repeated. At a level of length L each window stands for itself
by the least hash among the L-word windows inside it, which depends on its words alone, so equal windows have equal representatives.
Lengths double from a quarter of the window up to the window itself; only windows whose representative is repeated at one length are
looked at with twice that length, until no candidates survive or the whole window has been compared. What is left is compared once more
by a second hash of the whole window, independent of the first: 128 bits tell windows apart.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import exchange, shared
from .hashing import Words, covered, sliding, starts_within, sums, window_hash


def lengths(window: int) -> list[int]:
    out = [window]
    while len(out) < 3 and out[0] > 4:
        out.insert(0, (out[0] + 1) // 2)
    return out


def steps(window: int) -> list[tuple[int, int]]:
    """The levels: (length, seed of the hash)."""
    return [*((n, 0) for n in lengths(window)), (window, 1)]


def _runs_within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """exchange.found(), for values with long runs of equal entries."""
    if not len(values):
        return np.zeros(0, bool)
    begins = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return np.repeat(exchange.found(values[begins], ordered), np.diff(np.append(begins, len(values))))


class _Levels:
    """Windows of one slice of a block: which survive the levels whose answers are known, and what the next level sends."""

    def __init__(self, window: int, answers: list[str]):
        self.window, self.steps = window, steps(window)
        self.answers = [exchange.Answers(p) for p in answers]

    def alive(self, words: Words, block: int) -> np.ndarray:
        n = len(words.starts)
        count = max(0, n - self.window + 1)
        alive = starts_within(words.first, self.window)[:count]
        for (step, seed), answers in zip(self.steps, self.answers, strict=False):
            if not alive.any():
                break
            least = sliding(self._hashes(words, step, seed), self.window - step + 1, np.minimum)
            alive &= _runs_within(np.where(alive, least, np.uint64(0)), answers.of(block))
        return alive

    def _hashes(self, words: Words, step: int, seed: int) -> np.ndarray:
        return window_hash(sums(words.hash_of(seed), seed), step, seed)

    def sends(self, words: Words, block: int) -> np.ndarray:
        """Hashes of the next level's representatives, one for each place where one stands."""
        alive = self.alive(words, block)
        if not alive.any():
            return np.zeros(0, np.uint64)
        step, seed = self.steps[len(self.answers)]
        width = self.window - step + 1
        h = self._hashes(words, step, seed)
        least = np.where(alive, sliding(h, width, np.minimum), np.uint64(0))
        around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        top = sliding(around, width, np.maximum)
        return h[(h == top) & (top != 0)]


def _send(window: int, answers: list[str], ranges: int):
    def run(batches):
        levels = _Levels(window, answers)
        block, kept = None, []
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block and kept:
                    yield exchange.sent_rows(block, np.concatenate(kept), ranges)
                    kept = []
                block = b
                for part in shared.slices(rows, "text"):
                    if len(h := levels.sends(Words(part.column("text")), b)):
                        kept.append(h)
        if kept:
            yield exchange.sent_rows(block, np.concatenate(kept), ranges)

    return run


def _apply(window: int, answers: list[str], schema: pa.Schema):
    def run(batches):
        levels = _Levels(window, answers)
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                for part in shared.slices(rows, "text"):
                    yield _cut(levels, b, part, schema)

    return run


def _cut(levels: _Levels, block: int, part: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    words = Words(part.column("text"))
    alive = levels.alive(words, block)
    hits = np.zeros(len(words.starts), bool)
    hits[: len(alive)] = alive
    gone = covered(hits, levels.window)
    text, removed, spans = [], [], []
    data, offs = words.data.tobytes(), words.offs
    for i in range(part.num_rows):
        own = data[offs[i] : offs[i + 1]].split()  # bytes.split() splits at exactly the white space of SPACE
        out = gone[words.first[i] : words.first[i + 1]]
        k = int(out.sum())
        if k:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            own = itertools.compress(own, (~out).tolist())
        else:
            spans.append([])
        text.append(b" ".join(own))
        removed.append(k)
    return pa.record_batch(
        [
            *[part.column(c) for c in schema.names[:-4]],
            pa.array(np.diff(words.first), pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(text, pa.binary()).cast(pa.string()),
            pa.array(spans, schema.field("spans").type),
        ],
        schema=schema,
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word of every text that a repeated window covers.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one text, unchanged; it is repeated if its words also start anywhere
    else, in the same text too. Windows are judged on the input. All texts take part whole; a null text is empty, a null id is one more
    row, equal rows count as two texts, other columns are not read. Windows are compared by 64-bit hashes of three lengths
    and a second hash of the whole window; the passes end when no candidate survives.

    Returns id_col, n_words, n_removed, kept (the words left, joined by one space) and spans (removed runs as word positions); with
    carry, instead of id_col the columns named there, unchanged, and columns __removed and __kept.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    through, fields = shared.carried(docs, carry)
    base, n = exchange.blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *through), "substring")
    answers: list[str] = []
    for step, _ in steps(window):
        sent = base.select("block", "text").mapInArrow(_send(window, answers, n), exchange.SENT)
        left = exchange.repeated(sent, f"substring-{step}")
        answers.append(shared.path_of(left))
        if left.isEmpty():
            break
    schema = T.StructType([base.schema["id"], *fields, *T._parse_datatype_string("n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>").fields])
    out = base.mapInArrow(_apply(window, answers, to_arrow_schema(schema)), schema)
    if carry:
        return out.select(*shared.uncarried(out, carry), F.col("n_removed").alias("__removed"), F.col("kept").alias("__kept"))
    return out.withColumnRenamed("id", id_col)
