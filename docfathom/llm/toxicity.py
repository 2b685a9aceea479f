"""Toxicity scores over deobfuscated text.

Three parts: a character language model counted over all texts; a noisy-channel decoder that turns suspicious stretches (letters mixed
with look-alike signs, letters spelled apart, letters repeated) into character lattices and takes the cheapest path under the model
(Viterbi over the last three characters); and precisions of words and word beginnings learned from labelled rows, whose hits in a text a
logistic regression turns into a score.
A stretch that is not suspicious has a lattice of one path, itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .hashing import text_buffer

#: Symbols of the model: 0 ends a word, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS = 28
#: A state's code modulo this is the state without its oldest symbol.
FORGET = SYMBOLS**2
#: Labelled rows used for fitting, at most.
FIT_ROWS = 30_000
#: Lengths of word beginnings; rows that a word counts for in its beginnings, at most; least precision, surely reached, of what has a weight.
BEGINNINGS, WORD_CAP, LEAST_PRECISION = (4, 5), 3.0, 0.5

# Signs that stand for letters.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h", "%": "o",
}
LOOKALIKE_PAIRS = {"|_|": "u", "()": "o", "[]": "o", "\\/": "v", "/\\": "a", "|<": "k", "vv": "w", "ph": "f"}
SUBSTITUTED, JOINED, SPLIT, SQUEEZED, LITERAL = 1.0, 0.4, 2.5, 0.6, 6.0
#: What it costs that stars at a token's start or end are emphasis and no letters; stars in a row that are a drawn line, not letters.
MARKUP, LINE = 1.0, 24

_SIGN = r"[0-9@$!|+(<€£¢*#%]"
_ONE = r"(?:[A-Za-z0-9@$!|+€£]|(?<![^\s.\-_~])\*(?![^\s.\-_~]))"
#: Letters spelled apart. A star is one of them only where it stands between separators; next to letters it is a separator.
APART = re.compile(rf"(?<![^\s])(?:{_ONE}[ .\-_*~]{{1,2}}){{2,}}{_ONE}(?![^\s.,;:!?])")
#: A stretch whose letters are spelled apart: separators, among them stars, and others take turns from its start on.
_TURNS = re.compile(r"\**[^\s*][ .\-_*~]{1,2}[^\s*][ .\-_*~]")
#: Places that make the word around them suspicious: signs among letters, before or after them (closing punctuation may follow), a letter
#: twice, a separator between letters.
MARKED = re.compile(
    rf"(?<=[A-Za-z]){_SIGN}+(?=[A-Za-z])|{_SIGN}[A-Za-z]{_SIGN}|(?<![^\s]){_SIGN}+(?=[A-Za-z]{{2}})|(?<=[A-Za-z])(?!!+[.,;:?\"')\]]*(?![^\s])){_SIGN}+(?=[.,;:!?\"')\]]*(?![^\s]))"
    r"|([A-Za-z])(?i:\1)|(?<=[A-Za-z])[.\-_~](?=[A-Za-z])"
)
#: A letter three times, three double letters: such words are restored to whatever is cheapest, those with fewer doubles to likely words only.
REPEATED = re.compile(r"([a-z])\1(?:\1|[a-z]*([a-z])\2[a-z]*([a-z])\3)")
#: Addresses are no words.
ADDRESS = re.compile(r"[^\s@]{2,}@\w[^\s@]*\.[^\s@]{2,}")
#: What separates words for the features.
_PUNCTUATION = {ord(c): " " for c in ".,;:!?\"'()[]{}<>|/\\*_-=+"}

_CODE = np.zeros(256, np.int64)
for _c in range(26):
    _CODE[[65 + _c, 97 + _c]] = _c + 1
_CODE[128:] = 27


def symbol(c: str) -> int:
    return int(_CODE[ord(c)]) if c < "\x80" else 27


def gram_counts(column) -> np.ndarray:
    """Counts of four symbols in a row, by code, with everything before a word's end forgotten."""
    data, offs = text_buffer(column)
    cut = np.zeros(len(data) + len(offs) - 1, np.int64)  # a word's end after each text
    at = np.arange(len(data)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    cut[at] = _CODE[data]
    last = cut
    p1 = np.concatenate([[0], last[:-1]])
    p2 = np.where(p1 == 0, 0, np.concatenate([[0], p1[:-1]]))
    p3 = np.where(p2 == 0, 0, np.concatenate([[0, 0], p1[:-2]])[: len(p1)])
    return np.bincount(((p3 * SYMBOLS + p2) * SYMBOLS + p1) * SYMBOLS + last, minlength=SYMBOLS**4)


def _count(batches):
    total = np.zeros(SYMBOLS**4, np.int64)
    for batch in batches:
        for part in shared.slices(batch, "text"):
            if part.num_rows:
                total += gram_counts(part.column("text"))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["gram", "n"])


def language_model(counts: np.ndarray) -> np.ndarray:
    """Cost (negative logarithm) of a symbol after three symbols, smoothed with shorter contexts."""
    c4 = counts.reshape((SYMBOLS,) * 4).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
        weight = 5.0
        p = (c + weight * p) / (c.sum(-1, keepdims=True) + weight)
    return -np.log(p).astype(np.float32)


#: Words remembered by a worker's decoder; beyond that it starts anew, which costs time and changes no result.
MEMO_WORDS = 800_000
_decoders: dict[bytes, Decoder] = {}
shared.remembers("toxicity", _decoders.clear)


def decoder_of(costs: np.ndarray) -> Decoder:
    """This worker's decoder for a model; workers live on from task to task."""
    key = hashlib.sha1(costs.tobytes()).digest()
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(costs)
    return _decoders[key]


class Decoder:
    """Viterbi decoding of suspicious stretches: the cheapest path of all, whatever a stretch's length."""

    def __init__(self, costs: np.ndarray):
        # what stands between white space: tokens that are a word in lower case, the words of others; what suspicious ones are restored to
        self.plain: set[str] = set()
        self.words: dict[str, tuple[str, ...]] = {}
        self.decoded: dict[str, tuple[str, str] | None] = {}
        self.restored: dict[str, tuple[str, str]] = {}
        self.costs = costs
        self.flat = costs.reshape(-1, SYMBOLS).astype(float)
        self.prices = self.flat.ravel().tolist()
        # by the number of stars that end a stretch, for each state before them: the cheapest cost up to the end, and the edge it takes
        self.ends: list[tuple[np.ndarray, np.ndarray | None]] = [(self.flat[:, 0], None)]

    def edges(self, raw: str, i: int, apart: bool, run: int | None = None):
        """(what is written, next place, cost) for each edge that leaves place i of the lattice; run: where the run of equal signs ends."""
        c = raw[i]
        if c in " .-_~" or apart and c == "*" and {*raw[max(i - 1, 0) : i], *raw[i + 1 : i + 2]} - set(" .-_~"):
            yield "", i + 1, JOINED
            yield " ", i + 1, SPLIT
            if c != "*":
                return
        if run is None:
            run = i
            while run < len(raw) and raw[run] == c:
                run += 1
        if c == "*":
            if run - i > LINE:  # places inside of it are not reached
                yield " ", run, LITERAL
                return
            if i == 0 or run == len(raw):
                yield "", run, MARKUP
        if c.isalpha():
            yield c, i + 1, 0.0
            if run - i > 1:
                yield c, run, SQUEEZED
                if run - i > 2:
                    yield c + c, run, SQUEEZED
        else:
            yield " ", i + 1, LITERAL
        for letter in LOOKALIKE.get(c, ""):
            yield letter, i + 1, SUBSTITUTED
            if run - i > 1 and c != "*":  # each star is one letter
                yield letter, run, SUBSTITUTED + SQUEEZED
        for k in (3, 2):
            if (letter := LOOKALIKE_PAIRS.get(raw[i : i + k])) and len(raw) >= i + k:
                yield letter, i + k, SUBSTITUTED * k

    def _end(self, stars: int) -> tuple[np.ndarray, np.ndarray | None]:
        """What so many stars at a stretch's end cost; edges 0 to 25 read one star, 26 takes all as emphasis, 27 is a star that is no letter."""
        while len(self.ends) <= stars:
            code = np.arange(SYMBOLS**3)
            after = (code % SYMBOLS**2 * SYMBOLS)[:, None] + np.arange(1, 27)
            one = SUBSTITUTED + self.flat[:, 1:27] + self.ends[-1][0][after]
            every = np.concatenate([one, (MARKUP + self.flat[:, 0])[:, None], (LITERAL + self.flat[:, 0] + self.ends[-1][0][0])[:, None]], 1)
            edge = every.argmin(1)
            self.ends.append((every[code, edge], edge.astype(np.int8)))
        return self.ends[stars]

    def _many(self, here: dict, steps: list, best: dict) -> None:
        """A step from many states at once: over all states for each edge."""
        cost = np.full(SYMBOLS**3, np.inf)
        cost[np.fromiter(here.keys(), np.int64, len(here))] = np.fromiter((x[0] for x in here.values()), float, len(here))
        for out, to, price in steps:
            code, total, source = np.arange(SYMBOLS**3), cost + price, np.arange(SYMBOLS**3)
            for ch in out:
                s = symbol(ch) if ch != " " else 0
                total = total + self.flat[code, s]
                if len(code) == SYMBOLS**3 and s:  # states that differ in their first symbol only meet
                    total = total.reshape(SYMBOLS, -1)
                    source, tail = total.argmin(0), np.arange(SYMBOLS**2)
                    total, source, code = total[source, tail], source * SYMBOLS**2 + tail, tail * SYMBOLS + s
                elif s:
                    code = code % SYMBOLS**2 * SYMBOLS + s
                else:
                    k = total.argmin()
                    total, source, code = total[k : k + 1], source[k : k + 1], np.zeros(1, np.int64)
            there, known = best.setdefault(to, {}), np.isfinite(total)
            for z, t, k in zip(code[known].tolist(), total[known].tolist(), source[known].tolist(), strict=True):
                old = there.get(z)
                if old is None or t < old[0]:
                    there[z] = (t, (here[k][1], out))

    def _decode(self, raw: str) -> str:
        apart = "***" not in raw and bool(_TURNS.match(raw))  # in longer runs stars mask letters
        ends = [len(raw)] * len(raw)  # of runs of equal signs
        for i in range(len(raw) - 2, -1, -1):
            ends[i] = ends[i + 1] if raw[i] == raw[i + 1] else i + 1
        # best[i]: by the last three symbols, (cost, what was written before and last); paths share what they have in common
        best: dict[int, dict[int, tuple[float, tuple | None]]] = {0: {0: (0.0, None)}}
        prices = self.prices
        last = len(raw) if apart else len(raw.rstrip("*"))
        if len(raw) - last > LINE:
            last = len(raw)
        # letters by themselves have one edge each
        single = [e == i + 1 and "a" <= raw[i] <= "z" and raw[i : i + 2] != "ph" for i, e in enumerate(ends)]
        i = -1
        while (i := i + 1) < last:
            here = best.pop(i, None)
            if not here:
                continue
            if single[i]:
                n = i + 1
                if len(here) == 1:  # one path: on to the place where it may part or meet others
                    while n < last and single[n] and n not in best:
                        n += 1
                there, written = best.setdefault(n, {}), raw[i:n]
                symbols = [ord(c) - 96 for c in written]
                for z, (cost, path) in here.items():
                    for s in symbols:
                        cost += prices[z * SYMBOLS + s]
                        z = z % FORGET * SYMBOLS + s
                    old = there.get(z)
                    if old is None or cost < old[0]:
                        there[z] = (cost, (path, written))
                i = n - 1
                continue
            steps = list(self.edges(raw, i, apart, ends[i]))
            if len(here) * len(steps) > 3000:
                self._many(here, steps, best)
                continue
            for out, to, price in steps:
                there = best.setdefault(to, {})
                symbols = [symbol(ch) if ch != " " else 0 for ch in out]
                for z, (cost, path) in here.items():
                    total = cost + price
                    for s in symbols:
                        total += prices[z * SYMBOLS + s]
                        z = z % FORGET * SYMBOLS + s if s else 0
                    old = there.get(z)
                    if old is None or total < old[0]:
                        there[z] = (total, (path, out))
        stars = len(raw) - last
        after = self._end(stars)[0]
        _, z, path = min(((cost + after.item(z), z, path) for z, (cost, path) in best[last].items()), key=lambda x: x[0])
        while stars:
            edge = self._end(stars)[1].item(z)
            if edge == 26:
                break
            path, z = (path, " " if edge == 27 else chr(97 + edge)), 0 if edge == 27 else z % SYMBOLS**2 * SYMBOLS + edge + 1
            stars -= 1
        out = []
        while path:
            path, written = path
            out.append(written)
        return "".join(reversed(out))

    def likely(self, text: str) -> bool:
        """Whether no symbol of a text is dearer than a sign that is read as nothing."""
        z = 0
        for ch in text + " ":
            s = symbol(ch) if ch != " " else 0
            if self.prices[z * SYMBOLS + s] > LITERAL:
                return False
            z = z % FORGET * SYMBOLS + s if s else 0
        return True

    def _restored(self, stretch: str) -> tuple[str, str] | None:
        core = stretch.lower().strip(".,;:?\"'")
        if core and not ADDRESS.fullmatch(core):
            got = self._decode(core).strip()
            if got != core and got != core.rstrip("!") and (not core.isalpha() or REPEATED.search(core) or self.likely(got)):
                return stretch, got
        return None

    def look(self, token: str) -> None:
        """Remember a token: its words in lower case, and what it is restored to if it is suspicious."""
        words = tuple(token.lower().translate(_PUNCTUATION).split())
        if words == (token,):
            self.plain.add(token)
        else:
            self.words[token] = words
        if MARKED.search(token):
            if token not in self.decoded:
                self.decoded[token] = self._restored(token)
            if got := self.decoded[token]:
                self.restored[token] = got

    def read(self, text: str) -> tuple[set[str], list[tuple[str, str]]]:
        """The lower-case words of a text, and (stretch, restored) for each suspicious stretch that decodes to something else.

        Suspicious are letters spelled apart, and tokens (what stands between white space) with a marked place outside of those. Nothing
        in a token depends on its neighbours, so each is looked at once.
        """
        if len(self.words) + len(self.plain) >= MEMO_WORDS:  # between texts only
            self.words.clear()
            self.plain.clear()
            self.restored.clear()
        if len(self.decoded) >= MEMO_WORDS:
            self.decoded.clear()
        words: set[str] = set()
        apart = [m.span() for m in APART.finditer(text)]
        pieces = [text]
        out = []
        if apart:  # they begin a token, and may end within one, which is looked at too if it has a marked place beyond
            cuts, tails = [0], []
            for start, end in apart:
                if got := self._restored(text[start:end]):
                    out.append(got)
                first, inside = end, end
                while first and not text[first - 1].isspace():
                    first -= 1
                while end < len(text) and not text[end].isspace():
                    end += 1
                if any(m.start() >= inside - first for m in MARKED.finditer(text[first:end])) and (got := self._restored(text[first:end])):
                    tails.append(got)
                cuts += [start, end]
            cuts.append(len(text))
            out += tails
            pieces = [text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
            for start, end in zip(cuts[1:-1:2], cuts[2::2], strict=True):
                words.update(text[start:end].lower().translate(_PUNCTUATION).split())
        for piece in pieces:
            tokens = piece.split()
            distinct = {*tokens}
            for t in distinct - self.plain:
                if (own := self.words.get(t)) is None:
                    self.look(t)
                    own = self.words.get(t, (t,))
                words.update(own)
            words |= distinct & self.plain
            if not self.restored.keys().isdisjoint(tokens):
                out += [self.restored[t] for t in tokens if t in self.restored]
        return words, out

    def restore(self, text: str) -> list[tuple[str, str]]:
        return self.read(text)[1]


def features(text: str, decoder: Decoder) -> tuple[set[str], list[tuple[str, str]]]:
    """Lower-case words of the text and of what it restores to."""
    words, restored = decoder.read(text)
    for _, x in restored:
        words.update(x.split())
    return words, restored


def _learn(costs: np.ndarray):
    def run(batches):
        decoder = decoder_of(costs)
        counts = [[Counter(), Counter()], [Counter(), Counter()]]
        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                words, _ = features(text or "", decoder)
                counts[fold][bool(label)].update(words)
        for fold in (0, 1):
            clean, toxic = counts[fold]
            keys = list(toxic.keys() | clean.keys())
            yield pa.record_batch(
                [pa.array(keys, pa.string()), pa.array([fold] * len(keys), pa.int32()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                names=["word", "fold", "toxic", "clean"],
            )

    return run


class Weights:
    """Precisions of words and word beginnings."""

    def __init__(self, known: dict[str, float]):
        self.words = {k[2:]: v for k, v in known.items() if k[0] == "w"}
        self.begins = {n: {k[2:]: v for k, v in known.items() if k[0] == str(n)} for n in BEGINNINGS}

    def hits(self, words: set[str]) -> dict[str, float]:
        """The words that have a precision, themselves or by their beginning."""
        hit = {w: self.words[w] for w in words & self.words.keys()}
        for n, known in self.begins.items():
            if known and not known.keys().isdisjoint(w[:n] for w in words):
                for w in words:
                    p = known.get(w[:n])
                    if p is not None and p > hit.get(w, 0.0):
                        hit[w] = p
        return hit


def noisy_or(hits: dict[str, float]) -> float:
    return 1.0 - math.exp(math.fsum(math.log1p(-p) for p in hits.values()))


def evidence(hits: dict[str, float], n_words: int) -> list[float]:
    """What the calibration sees of a text: its hits and their weight, alone and for the text's length; all grow with a hit's precision."""
    mass = math.fsum(-math.log1p(-p) for p in hits.values())
    share = lambda x: math.log1p(100 * x / (n_words + 20))
    return [1.0, mass, math.log1p(mass), max(hits.values(), default=0.0), noisy_or(hits), math.log1p(len(hits)), share(len(hits)), share(mass), math.log1p(n_words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression, by Newton's method with a ridge on all but the first."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _observe(costs: np.ndarray, by_fold: list[Weights]):
    """Evidence of labelled rows, under the weights of the other fold."""

    def run(batches):
        decoder = decoder_of(costs)
        for batch in batches:
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                words, _ = features(text or "", decoder)
                out.append(evidence(by_fold[1 - fold].hits(words), len(words)))
            yield pa.record_batch([batch.column("label"), pa.array(out, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _score(costs: np.ndarray, weights: Weights, beta: np.ndarray | None, carry: list[str]):
    def run(batches):
        decoder = decoder_of(costs)
        for batch in batches:
            score, restored = [], []
            for text in batch.column("text").to_pylist():
                words, changes = features(text or "", decoder)
                hits = weights.hits(words)
                if not hits or beta is None:
                    score.append(noisy_or(hits))
                else:
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(beta, evidence(hits, len(words)))))))))
                restored.append([{"raw": a, "text": b} for a, b in changes])
            kind = pa.list_(pa.struct([("raw", pa.string()), ("text", pa.string())]))
            own = [batch.column(c) for c in ("id", *carry)]
            yield pa.record_batch([*own, pa.array(score, pa.float64()), pa.array(restored, kind)], names=["id", *carry, "score", "restored"])

    return run


def precisions(seen: DataFrame, toxic: F.Column, clean: F.Column, base: float) -> dict[str, float]:
    """Words and beginnings (keys "w ...", "4 ...") that toxic rows hold more often than chance over all words explains."""
    seen = seen.select("word", toxic.cast("double").alias("toxic"), clean.cast("double").alias("clean")).filter("toxic + clean > 0")
    counts = seen.select(F.concat(F.lit("w "), "word").alias("key"), "toxic", "clean")
    # a beginning is known by its words: each counts for at most WORD_CAP rows, so that one frequent word does not speak for others
    part = F.least(F.lit(1.0), WORD_CAP / (F.col("toxic") + F.col("clean")))
    for k in BEGINNINGS:
        begun = seen.filter(F.length("word") >= k).groupBy(F.concat(F.lit(f"{k} "), F.substring("word", 1, k)).alias("key"))
        begun = begun.agg(F.sum(part * F.col("toxic")).alias("toxic"), F.sum(part * F.col("clean")).alias("clean"), F.count("*").alias("words"))
        counts = counts.unionByName(begun.filter(F.col("words") >= 3).drop("words"))
    tests = max(1, seen.count())
    gain = lambda x, p: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    sure = counts.filter(F.col("toxic") > base * (F.col("toxic") + F.col("clean"))).filter(gain("toxic", base) + gain("clean", 1 - base) > math.log(tests / 0.01))
    out = {}
    for r in sure.collect():  # bounded by the rows fitted on
        n, z2 = r["toxic"] + r["clean"], 4.0
        p = r["toxic"] / n
        low = (p + z2 / 2 / n - 2 * math.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n)
        if low >= LEAST_PRECISION:
            out[r["key"]] = min(0.999, (low - base) / (1 - base))
    return out


def held_out(column) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every text for toxicity as labels mark it.

    The language model counts all texts. Precisions are learned from at most fit_rows labelled rows that are not held out (those with
    the least hash of the id; equal texts count once); a word or word beginning has a weight if toxic rows hold it more often than chance
    over all words explains, and most rows that hold it are surely toxic. The calibration is fitted however few labels there are; only where
    no labelled row holds what the other fold has learned is there nothing to fit, and a score is the noisy-or of the precisions. Only the text is an input of a score. A null or empty text scores 0; so does every text where no label
    is known or all labels are equal. A null id is scored and never learned from; equal rows score equally; null labels are left out, of
    several labels for an id, or for equal texts, the largest counts; other columns are not read.

    Returns id_col, held_out, score, predicted (1 if score >= 0.7) and restored (stretches that were decoded); with carry, instead of
    id_col the columns named there, unchanged, and a column __predicted.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    through, fields = shared.carried(docs, carry)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *through)
    counts = np.zeros(SYMBOLS**4, np.int64)
    for r in texts.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["gram"]] = r["n"]
    costs = language_model(counts)

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # a bounded table, so it may be broadcast
    rows = texts.select("id", "text").join(F.broadcast(known), "id").groupBy("text").agg(F.max("label").alias("label"))
    rows = shared.stage(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "fit")
    total = rows.agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    weights, beta = Weights({}), None
    if total["n"] and 0 < total["t"] < total["n"]:
        base = total["t"] / total["n"]
        of = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
        seen = rows.mapInArrow(_learn(costs), "word string, fold int, toxic long, clean long").groupBy("word").agg(*[of(c, f) for c in ("toxic", "clean") for f in (0, 1)])
        seen = shared.stage(seen, "features")
        by_fold = [Weights(precisions(seen, F.col(f"toxic{f}"), F.col(f"clean{f}"), base)) for f in (0, 1)]
        weights = Weights(precisions(seen, F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), base))
        # calibrated on each fold with what the other has learned
        told = rows.mapInArrow(_observe(costs, by_fold), "label int, x array<double>").collect()  # at most fit_rows
        x, y = np.array([r["x"] for r in told]), np.array([float(r["label"] > 0) for r in told])
        if 0 < y.sum() < len(y) and x[:, 1].any():
            beta = fit_logistic(x, y)
        shared.discard(seen)
    shared.discard(rows)
    from pyspark.sql import types as T

    schema = T.StructType([texts.schema["id"], *fields, T.StructField("score", T.DoubleType()), *T._parse_datatype_string("restored array<struct<raw:string,text:string>>").fields])
    out = texts.mapInArrow(_score(costs, weights, beta, [f.name for f in fields]), schema)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    if carry:
        return out.select(*shared.uncarried(out, carry), predicted.alias("__predicted"))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", predicted.alias("predicted"), "restored")
