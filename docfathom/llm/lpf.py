"""Byte-level dedup by longest-previous-factor arrays.

Which texts have to be sorted together is found first: a window of `window` bytes stands for itself by the least hash among the shorter
windows inside it, at two lengths, and only windows whose representatives are repeated go on. They are sent, as pieces of text around one
representative, to the bucket of that representative, so equal windows meet. A bucket sorts the suffixes of its pieces (prefix doubling),
finds for each the previous and next smaller position in suffix order, and from these the longest previous factor: if it is as long as
a window, the window is a later copy, and the place that it repeats is an earlier one.

A representative in more pieces than a bucket should hold has its windows compared by two independent hashes, which blocks send once each, so
that a window in any number of pieces is one entry for a block; for equal strings of a window's length no more is to be sorted. Which of
them is the first is asked with keep_first only: then equal windows are counted, with the first place of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, shared
from .hashing import byte_values, mix, sliding, starts_within, sums, text_buffer, window_hash
from .substring import _runs_within

#: Bytes of pieces in a bucket, about, and pieces with one representative beyond which it counts as hot.
BUCKET_BYTES, HOT_PIECES = 1 << 18, 4000


class SuffixOrder:
    """Suffixes of a text compared up to 256 bytes: ranks by their first 8, 16, ... 128 bytes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[i : i + n]
        tail = np.arange(max(0, n - 8), n)  # a suffix that ends is less than one that goes on with zero bytes
        rank = self._dense(key)
        if len(tail):
            rank = self._dense(rank.astype(np.int64) * 16 + np.minimum(8, n - np.arange(n)))
        self.ranks = {8: rank}
        h = 8
        while h < 128:
            rank = self._dense(self.pair(rank, h))
            h *= 2
            self.ranks[h] = rank

    @staticmethod
    def pair(rank: np.ndarray, h: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - h] = rank[h:].astype(np.int64) + 1
        return rank.astype(np.int64) << 32 | after

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])[: len(key)])
        return rank

    def order(self, starts: np.ndarray) -> np.ndarray:
        """starts in suffix order; suffixes equal for 256 bytes in text order."""
        return starts[np.argsort(self.pair(self.ranks[128], 128)[starts], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b (a < b, pairwise), up to 255."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        for h in (128, 64, 32, 16, 8):
            r = np.append(self.ranks[h], -1)
            x, y = np.minimum(a + out, n), np.minimum(b + out, n)
            out += h * ((r[x] == r[y]) & (b + out + h <= n))
        t = np.append(self.text.astype(np.int16), -1)
        more = np.ones(len(a), bool)
        for _ in range(7):
            x, y = np.minimum(a + out, n), np.minimum(b + out, n)
            more &= (t[x] == t[y]) & (y < n)
            out += more
        return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest place before it with a smaller value, -1 if none; by jumping over larger entries."""
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[values[at[todo]] > values[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def longest_previous_factors(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending starts: length (up to 255) of the longest prefix of its suffix that begins at an earlier start too, and that start (-1)."""
    suffixes = SuffixOrder(text)
    order = suffixes.order(starts)
    length, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    place = np.searchsorted(starts, order)
    n = len(order)
    before = smaller_before(order)
    after = n - 1 - smaller_before(order[::-1])[::-1]
    for near, there in ((before, before >= 0), (after, after < n)):
        i = np.flatnonzero(there)
        got = suffixes.common(order[near[i]], order[i])
        better = got > length[place[i]]
        length[place[i[better]]] = got[better]
        source[place[i[better]]] = order[near[i[better]]]
    return length, source


class _Bytes:
    """Bytes of a batch, their hashes, and which windows survive."""

    def __init__(self, column, window: int):
        self.data, self.first = text_buffer(column)
        self.window = window
        self.prefix = sums(byte_values(self.data))
        self.alive = starts_within(self.first, window)[: max(0, len(self.data) - window + 1)]

    def least(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = window_hash(self.prefix, size)
        return h, sliding(h, self.window - size + 1, np.minimum)

    def keep(self, size: int, answers: np.ndarray) -> None:
        if self.alive.any():
            self.alive &= _runs_within(np.where(self.alive, self.least(size)[1], np.uint64(0)), answers)

    def sends(self, size: int) -> np.ndarray:
        """Representatives at this length, one for each place where one stands."""
        if not self.alive.any():
            return np.zeros(0, np.uint64)
        h, least = self.least(size)
        least = np.where(self.alive, least, np.uint64(0))
        gap = np.zeros(self.window - size, np.uint64)
        top = sliding(np.concatenate([gap, least, gap]), self.window - size + 1, np.maximum)
        return h[(h == top) & (top != 0)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _candidates(batch, flags: dict[int, int]):
    """Rows of a batch that are no later copy of an equal text."""
    take = [i for i, u in enumerate(batch.column("uid").to_pylist()) if flags.get(u, 0) < 2]
    return batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int32()))


class _Flags:
    def __init__(self, path: str | None):
        self.path, self.block, self.flags = path, None, {}

    def of(self, block: int) -> dict[int, int]:
        if self.path and block != self.block:
            got = exchange.read_block(self.path, block, ["uid", "copy"])
            self.flags, self.block = dict(zip(got["uid"], got["copy"], strict=True)), block
        return self.flags


def _send(window: int, size: int, ranges: int, flags_path: str | None):
    def run(batches):
        flags = _Flags(flags_path)
        block, kept = None, []
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block and kept:
                    yield exchange.sent_rows(block, np.concatenate(kept), ranges)
                    kept = []
                block = b
                for part in shared.slices(_candidates(rows, flags.of(b)), "text"):
                    if len(h := _Bytes(part.column("text"), window).sends(size)):
                        kept.append(h)
        if kept:
            yield exchange.sent_rows(block, np.concatenate(kept), ranges)

    return run


_REGION = pa.schema([("block", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()), ("text", pa.binary())])


def _regions(window: int, size: int, path: str, flags_path: str | None):
    """Runs of windows that survive, as stretches of text."""

    def run(batches):
        answers, flags = exchange.Answers(path), _Flags(flags_path)
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                for part in shared.slices(_candidates(rows, flags.of(b)), "text"):
                    x = _Bytes(part.column("text"), window)
                    x.keep(size, answers.of(b))
                    lo, hi = _runs(x.alive)
                    # a run may go from one text's windows to the next text's only through dead windows
                    row = np.searchsorted(x.first, lo, "right") - 1
                    raw = x.data.tobytes()
                    uid = part.column("uid").to_numpy()
                    yield pa.record_batch(
                        [pa.array(np.full(len(lo), b, np.int32)), pa.array(uid[row]), pa.array(lo - x.first[row]), pa.array([raw[a : z + window - 1] for a, z in zip(lo, hi, strict=True)], pa.binary())],
                        schema=_REGION,
                    )

    return run


#: Pieces (text not null; uid and start of the first) and all their places (text null), by block and piece (a hash of the text).
PARTS = "block int, anchor long, piece long, uid long, start long, starts int, n int, text binary"


def _pieces(window: int, small: int, large: int, path: str):
    def run(batches):
        answers = exchange.Answers(path)
        seen: dict[int, list] = {}
        block = None

        def flush():
            rows = [(block, *key, *v) for key, v in seen.items()]
            seen.clear()
            for k in range(0, len(rows), 20_000):
                cols = list(zip(*rows[k : k + 20_000], strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "anchor", "piece", "uid", "start", "starts", "n", "text"])

        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block and seen:
                    yield from flush()
                block = b
                for part in shared.slices(rows, "text"):
                    x = _Bytes(part.column("text"), window)
                    x.keep(large, answers.of(b))
                    lo, hi = _runs(x.alive)
                    if not len(lo):
                        continue
                    anchor = x.least(small)[1]
                    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                    limit = np.concatenate([np.arange(a, z, window) for a, z in zip(lo, hi, strict=True)])  # no piece of more than a window's starts
                    cuts = np.unique(np.concatenate([lo, change, limit]))
                    run_of = np.searchsorted(lo, cuts, "right") - 1
                    cuts = cuts[(run_of >= 0) & (cuts < hi[run_of])]
                    run_of = np.searchsorted(lo, cuts, "right") - 1
                    ends = np.minimum(np.append(cuts[1:], len(anchor)), hi[run_of])
                    # the hash of a piece of any length, from the prefix sums
                    from .hashing import powers

                    code = mix((x.prefix[ends + window - 1] - x.prefix[cuts]) * powers(len(x.data) + 1)[1][cuts] ^ mix((ends - cuts).astype(np.uint64)))
                    row = np.searchsorted(x.first, cuts, "right") - 1
                    uid, base, raw = part.column("uid").to_numpy(), part.column("start").to_numpy(), x.data.tobytes()
                    places = []
                    for a, z, r, c, k in zip(cuts.tolist(), ends.tolist(), row.tolist(), code.view(np.int64).tolist(), anchor[cuts].view(np.int64).tolist(), strict=True):
                        at = int(base[r]) + a - int(x.first[r])
                        own = seen.get((k, c))
                        if own is None:
                            seen[k, c] = [int(uid[r]), at, z - a, 1, raw[a : z + window - 1]]
                        else:
                            own[3] += 1
                            places.append((b, k, c, int(uid[r]), at, z - a))
                    if places:
                        cols = list(zip(*places, strict=True))
                        n = len(places)
                        yield pa.record_batch(
                            [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)] + [pa.array([0] * n, pa.int32()), pa.nulls(n, pa.binary())],
                            names=["block", "anchor", "piece", "uid", "start", "starts", "n", "text"],
                        )
        if seen:
            yield from flush()

    return run


def _hot_alive(x: _Bytes, window: int, block: int, known: list[exchange.Answers]) -> np.ndarray:
    """The window starts of hot pieces that are repeated by each hash that is known."""
    at = np.flatnonzero(x.alive)
    for seed, answers in enumerate(known):
        at = at[exchange.found(_seeded(x, window, seed)[at], answers.of(block))]
    return at


def _seeded(x: _Bytes, window: int, seed: int) -> np.ndarray:
    """The hash of every window; seeds 0 and 1 are independent."""
    return window_hash(sums(byte_values(x.data, seed), seed) if seed else x.prefix, window, seed)


def _hot_send(window: int, ranges: int, paths: list[str]):
    def run(batches):
        known = [exchange.Answers(p) for p in paths]
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                x = _Bytes(rows.column("text"), window)
                at = _hot_alive(x, window, b, known)
                h = _seeded(x, window, len(known))[at]
                counts = rows.column("n").to_numpy()[np.searchsorted(x.first, at, "right") - 1]
                yield exchange.sent_rows(b, np.concatenate([h, h[counts > 1]]), ranges)

    return run


def _hot_told(window: int, paths: list[str]):
    """RESULT for hot pieces: the windows that are repeated by 128 bits."""

    def run(batches):
        known = [exchange.Answers(p) for p in paths]
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                x = _Bytes(rows.column("text"), window)
                at = _hot_alive(x, window, b, known)
                row = np.searchsorted(x.first, at, "right") - 1
                which, first = np.unique(row, return_index=True)
                runs = pa.array([_pack(own) for own in np.split(at - x.first[row], first[1:])] if len(which) else [], pa.binary())
                yield pa.record_batch([pa.array(np.full(len(which), b, np.int32)), rows.column("piece").take(pa.array(which)), runs, runs], schema=_RESULT)

    return run


def _hot_windows(window: int, paths: list[str]):
    """The repeated windows of hot pieces, each by the MD5 of its bytes."""

    def run(batches):
        known = [exchange.Answers(p) for p in paths]
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                x = _Bytes(rows.column("text"), window)
                at = _hot_alive(x, window, b, known)
                row = np.searchsorted(x.first, at, "right") - 1
                shift = at - x.first[row]
                raw = x.data.tobytes()
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(at), b, np.int32)), rows.column("piece").take(pa.array(row)), rows.column("uid").take(pa.array(row)),
                        pa.array(rows.column("start").to_numpy()[row] + shift), pa.array(shift.astype(np.int32)), rows.column("n").take(pa.array(row)),
                        pa.array([hashlib.md5(raw[i : i + window]).hexdigest() for i in at], pa.string()),
                    ],
                    names=["block", "piece", "uid", "start", "shift", "n", "same"],
                )

    return run


def _same_windows(single: DataFrame) -> DataFrame:
    """block, piece, again and old: the places in a hot piece of windows that are repeated, and of those that are not the first (which hashes
    do not tell).

    Equal windows are counted, with partial sums where they lie, and only the count and the first place come together: a window that is in
    any number of pieces is one row. Its longest previous factor is the window itself for all places but the first.
    """
    first = F.struct("uid", "start")
    sums = single.groupBy("same").agg(F.sum("n").alias("copies"), F.count("*").alias("k"), F.min(first).alias("first")).filter("copies > 1")
    known = shared.split_join(single, shared.stage(sums, "hot-sums"), "same", "k", single.count())
    places = lambda c: F.sort_array(F.collect_list(c))
    return known.groupBy("block", "piece").agg(places("shift").alias("again"), places(F.when(first != F.col("first"), F.col("shift"))).alias("old"))


def _packed(batches):
    for batch in batches:
        runs = [pa.array([_pack(np.array(x, np.int64)) for x in batch.column(c).to_pylist()], pa.binary()) for c in ("again", "old")]
        yield pa.record_batch([batch.column("block"), batch.column("piece"), *runs], schema=_RESULT)


RESULT = "block int, piece long, repeated binary, later binary"
_RESULT = pa.schema([("block", pa.int32()), ("piece", pa.int64()), ("repeated", pa.binary()), ("later", pa.binary())])


def _bucket(window: int):
    """Longest previous factors of a bucket's pieces: per piece the runs of its window starts that are repeated, and that are later copies."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("block", "piece", "uid", "start", "shift", "starts", "n")}
        order = np.lexsort((cols["start"], cols["uid"]))
        cols = {c: v[order] for c, v in cols.items()}
        texts = [table.column("text")[int(i)].as_py() for i in order]
        # equal pieces are sorted once, for the first of them
        first_of: dict[bytes, int] = {}
        rep = np.array([first_of.setdefault(t, i) for i, t in enumerate(texts)])
        own = np.unique(rep)
        copies = np.bincount(rep, cols["n"], len(texts))
        begin = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
        n = cols["starts"][own].astype(np.int64)
        of = np.repeat(np.arange(len(own)), n)
        inside = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        starts = inside + begin[of]
        length, source = longest_previous_factors(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), starts)
        later = length >= window
        repeated = later | (copies[own][of] > 1)
        repeated[np.searchsorted(starts, source[later])] = True
        ends = np.searchsorted(of, np.arange(len(own) + 1))
        place = np.searchsorted(own, rep)
        block, piece, again, old = [], [], [], []
        for i in range(len(texts)):
            a, z, shift = ends[place[i]], ends[place[i] + 1], int(cols["shift"][i])
            at = inside[a:z][repeated[a:z]] + shift
            if len(at):
                block.append(int(cols["block"][i]))
                piece.append(int(cols["piece"][i]))
                again.append(_pack(at))
                old.append(_pack(inside[a:z][later[a:z]] + shift) if rep[i] == i else again[-1])
        return pa.table([pa.array(block, pa.int32()), pa.array(piece, pa.int64()), pa.array(again, pa.binary()), pa.array(old, pa.binary())], schema=_RESULT)

    return run


def _pack(at: np.ndarray) -> bytes:
    """Ascending numbers as runs (first, end)."""
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)] + 1], axis=1).astype(np.int32).tobytes()


def _apply(window: int, keep_first: bool, cuts_path: str, flags_path: str, schema: pa.Schema):
    def run(batches):
        flags = _Flags(flags_path)
        block, cuts = None, {}
        for batch in batches:
            for b, rows in exchange.by_block(batch):
                if b != block:
                    cuts, block = {}, b
                    got = exchange.read_block(cuts_path, b, ["uid", "start", "runs"])
                    for u, s, r in zip(*got.values(), strict=True):
                        cuts.setdefault(u, []).append((s, r))
                copy = flags.of(b)
                for part in shared.slices(rows, "text"):
                    data, first = text_buffer(part.column("text"))
                    out = []
                    for i, u in enumerate(part.column("uid").to_pylist()):
                        own = data[first[i] : first[i + 1]]
                        gone, flag = np.zeros(len(own) + 1, np.int32), copy.get(u, 0)
                        if len(own) >= window and (flag == 2 or flag == 1 and not keep_first):
                            gone[0], gone[-1] = 1, -1
                        for s, r in cuts.get(u, ()):
                            for a, z in np.frombuffer(r, np.int32).reshape(-1, 2) + s:
                                gone[a] += 1
                                gone[z + window - 1] -= 1
                        mask = np.cumsum(gone[:-1]) > 0
                        lo, hi = _runs(mask)
                        out.append((len(own), int(mask.sum()), [{"start": int(a), "end": int(z)} for a, z in zip(lo, hi, strict=True)], own[~mask].tobytes() if len(lo) else own.tobytes()))
                    yield pa.record_batch([part.column("id"), *[pa.array([x[k] for x in out], schema.field(k + 1).type) for k in range(4)]], schema=schema)

    return run


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, keep_first: bool = False) -> DataFrame:
    """Remove every byte of every text, in UTF-8, that a repeated string of `window` bytes covers; window is from 128 to 255.

    A string is repeated if it also starts anywhere else, in the same text too; matches stay within a text; strings are judged on the
    input. With keep_first, the first place of each string (in the order of the staged rows) does not count as repeated. A null text is
    empty, a null id is one more row, equal rows count as two texts, other columns are not read.

    Returns id_col, n_bytes, n_removed, spans (removed runs, in bytes) and kept (the bytes left; they may cut a character).
    """
    if not 128 <= window <= 255:
        raise ValueError("window must be from 128 to 255")
    spark = docs.sparkSession
    shared.small_batches(spark)
    small, large = window // 5, window // 2
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    base, ranges = exchange.blocks(rows, "lpf")

    # equal texts: only the first takes part, for all
    long_ = shared.stage(base.filter(F.octet_length("text") >= window).select("uid", F.md5("text").alias("same")), "digests")
    copies = shared.stage(long_.groupBy("same").agg(F.count("*").alias("k"), F.min("uid").alias("first")).filter("k > 1"), "copies")
    flags = shared.split_join(long_, copies, "same", "k", long_.count())
    flags = flags.select("uid", F.when(F.col("uid") == F.col("first"), 1).otherwise(2).alias("copy"), F.shiftright("uid", 33).cast("int").alias("block"))
    flags = shared.stage(flags.repartition(F.col("block")), "flags", "block")
    shared.discard(long_, copies)
    flags_path = shared.path_of(flags)

    cols = ["block", "uid", "text"]
    one = exchange.repeated(base.select(cols).mapInArrow(_send(window, small, ranges, flags_path), exchange.SENT), "lpf-small")
    regions = shared.stage(base.select(cols).mapInArrow(_regions(window, small, shared.path_of(one), flags_path), "block int, uid long, start long, text binary"), "regions")
    two = exchange.repeated(regions.mapInArrow(_send(window, large, ranges, None), exchange.SENT), "lpf-large")
    parts = shared.stage(regions.mapInArrow(_pieces(window, small, large, shared.path_of(two)), PARTS), "pieces")
    shared.discard(regions)

    pieces, hot_told = parts.filter("text IS NOT NULL").withColumn("shift", F.lit(0)), None
    hot = shared.stage(pieces.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > HOT_PIECES).select("anchor"), "hot")
    n_hot = hot.count()  # at most a HOT_PIECES-th of the pieces
    if n_hot:
        known = F.broadcast(hot) if n_hot <= 10_000 else hot
        own = shared.stage(pieces.join(known, "anchor", "left_semi").select("block", "piece", "uid", "start", "starts", "n", "text"), "hot-pieces")
        paths: list[str] = []
        for name in ("lpf-hot", "lpf-hot-again"):
            paths.append(shared.path_of(exchange.repeated(own.mapInArrow(_hot_send(window, ranges, paths[:]), exchange.SENT), name)))
        if keep_first:
            single = own.mapInArrow(_hot_windows(window, paths), "block int, piece long, uid long, start long, shift int, n int, same string")
            hot_told = _same_windows(shared.stage(single, "hot-windows")).mapInArrow(_packed, RESULT)
        else:
            hot_told = own.mapInArrow(_hot_told(window, paths), RESULT)
        pieces = pieces.join(known, "anchor", "left_anti")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    told = pieces.withColumn("r", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("r").applyInArrow(_bucket(window), RESULT)
    told = shared.stage(told if hot_told is None else told.unionByName(hot_told), "factors")

    places = parts.select("block", "piece", "uid", "start", F.col("text").isNotNull().alias("first"))
    cuts = places.join(told, ["block", "piece"])
    runs = F.when(F.col("first"), F.col("later")).otherwise(F.col("repeated")) if keep_first else F.col("repeated")
    cuts = shared.stage(cuts.select("block", "uid", "start", runs.alias("runs")).repartition(F.col("block")), "cuts", "block")
    shared.discard(parts, told)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([base.schema["id"], *T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary").fields])
    out = base.mapInArrow(_apply(window, keep_first, shared.path_of(cuts), flags_path, to_arrow_schema(schema)), schema)
    return out.withColumnRenamed("id", id_col)
