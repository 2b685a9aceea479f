"""Text functions as column expressions; the few that need Python are for driver-side strings."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_TYPES = ("overview", "endpoint", "schema", "glossary", "use-case", "guide")
#: Characters that a full-text query treats as spaces.
QUERY_NOISE = "'\"*()-:^~@{}"


@cache
def accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and c == c.lower() and base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]):
            marked.append(c)
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def tokens(text: Column) -> Column:
    """Index terms: lower case, without marks, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(text), *accent_table()), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_list(text: str) -> list[str]:
    """tokens() for a string on the driver."""
    folded = text.lower().translate(str.maketrans(*accent_table()))
    return re.findall(r"[^\W_]+", folded)


def sanitize_query(query: str) -> list[str]:
    """The words of a full-text query; each is a phrase, all have to match."""
    return query.translate({ord(c): " " for c in QUERY_NOISE}).split()


def sanitized(query: Column) -> Column:
    """sanitize_query() as a column."""
    return F.array_remove(F.split(F.translate(query, QUERY_NOISE, " " * len(QUERY_NOISE)), r"\s+"), "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(text: str) -> str:
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", text.lower()))


def trim(text: Column) -> Column:
    """Without the Unicode white space around it."""
    space = r"[\s\x{FEFF}\x{0B}\p{Z}]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def chunk_type(path: Column) -> Column:
    """Kind of a document by its file name."""
    name = F.lower(basename(path))
    return F.when(name.contains("glossary"), "glossary").when(name.contains("use-case") | name.contains("use_case"), "use-case").otherwise("guide")


def source_id(name: Column) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def valid_type(kind: Column, chunk: Column) -> Column:
    """kind, or an error for one that is none of CHUNK_TYPES."""
    told = F.concat(F.lit('Invalid chunk type "'), kind, F.lit('" in chunk "'), chunk, F.lit('"'))
    return F.when(kind.isin(*CHUNK_TYPES), kind).otherwise(F.raise_error(told).cast("string"))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _from_utf16(units: Column) -> Column:
    """The text of some UTF-16 code units (big-endian bytes). Half of a character, which a cut leaves at an end, is U+FFFD."""
    between = lambda at, lo, hi: F.hex(F.substring(units, at, F.lit(1))).between(lo, hi)
    front, back = between(F.lit(1), "DC", "DF"), between(F.lit(-2), "D8", "DB")
    whole = F.substring(units, F.when(front, 3).otherwise(1), F.octet_length(units) - F.when(front, 2).otherwise(0) - F.when(back, 2).otherwise(0))
    half = lambda is_half: F.when(is_half, "\ufffd").otherwise("")
    return F.concat(half(front), F.decode(whole, "UTF-16BE"), half(back))


def hard_split(text: Column, size: int = 3000) -> Column:
    """Pieces of at most size UTF-16 code units."""
    starts = lambda u: F.sequence(F.lit(0), F.greatest(F.octet_length(u) - 2, F.lit(0)), F.lit(2 * size))
    pieces = lambda u: F.transform(starts(u), lambda i: _from_utf16(F.substring(u, i + 1, F.lit(2 * size))))
    return F.element_at(F.transform(F.array(F.encode(text, "UTF-16BE")), pieces), 1)  # encoded once, not for each piece


def pack_paragraphs(text: Column, size: int = 3000, delimiter: str = "\n\n") -> Column:
    """Greedy packing: paragraphs joined as long as a part has at most size UTF-16 code units; larger single paragraphs are cut hard."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, part):
        joined = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(delimiter), part))
        full = (utf16_length(joined) > size) & (acc["open"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("open"))

    packed = F.aggregate(F.split(text, re.escape(delimiter)), first, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.flatten(F.transform(packed, lambda p: hard_split(p, size)))
