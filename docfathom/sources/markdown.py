"""Markdown files as chunks: cut at headings of level 1 to 3, long sections at paragraphs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.text import slug
from .openapi import CHUNK_FIELDS, chunk, chunk_batches

MAX_CHUNK = 3000
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r"^ {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|(!--)|(\?)|(![A-Za-z])|(!\[CDATA\[)|(/?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$)))", re.I)
_HTML_END = ("</{}>", "-->", "?>", ">", "]]>")
_SPACE = " \t\n\r\x0b\x0c\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TRIM = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")


def trimmed(text: str) -> str:
    return _TRIM.sub("", text)


def utf16(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


def heading_text(raw: str) -> str:
    """Plain text of a heading's inline markup: code, links, emphasis, escapes and references."""
    import html

    held: list[str] = []

    def hold(text: str) -> str:
        held.append(text)
        return f"\x00{len(held) - 1}\x00"

    t = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: hold(m[2][1:-1] if m[2].startswith(" ") and m[2].endswith(" ") and m[2].strip() else m[2]), raw)
    t = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), t)
    t = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", t)
    t = re.sub(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"<((?:https?|mailto):[^ >]*)>", r"\1", t)
    for mark in (r"\*\*", "__", r"\*", "_"):
        edge = r"(?<![A-Za-z0-9_])" if "_" in mark else ""
        after = r"(?![A-Za-z0-9_])" if "_" in mark else ""
        t = re.sub(rf"{edge}{mark}(?=\S)(.+?)(?<=\S){mark}{after}", r"\1", t)
    t = html.unescape(t)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], t)


def headings(source: str) -> Iterator[tuple[int, str, int, int]]:
    """(level, text, start, end) of the headings that stand at the top of the document, not in lists, quotes, code or HTML."""
    fence = html_end = None
    paragraph: list[tuple[int, str]] = []  # lines of an open paragraph, with their places
    item = 0  # indentation of an open list item
    blank = True
    at = 0
    for line in source.splitlines(keepends=True) if "\x0b" not in source and "\x0c" not in source else re.findall(r"[^\n]*\n|[^\n]+$", source):
        start, text = at, line.rstrip("\r\n")
        at += len(line)
        indent = len(text) - len(text.lstrip(" "))
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", text):
                fence = None
            continue
        if html_end is not None:
            if html_end == "" and not text.strip() or html_end and html_end in text.lower():
                html_end = None
            continue
        if not text.strip():
            paragraph, blank = [], True
            continue
        if item and (indent >= item or not blank and not _starts_block(text)):
            blank = False
            continue  # inside the list item, or a lazy line of it
        blank, item = False, 0
        if not paragraph and (indent >= 4 or text.startswith("\t")):
            continue  # indented code
        if m := _FENCE.match(text):
            fence, paragraph = m[1], []
            continue
        if paragraph and (m := _SETEXT.match(text)):
            first = paragraph[0]
            yield (1 if m[1][0] == "=" else 2), heading_text("\n".join(p[1].strip() for p in paragraph)), first[0] + len(first[1]) - len(first[1].lstrip()), start + len(text.rstrip())
            paragraph = []
            continue
        if m := _ATX.match(text):
            paragraph = []
            yield len(m[1]), heading_text((m[2] or "").strip()), start + indent, start + len(text.rstrip(" \t"))
            continue
        if _BREAK.match(text):
            paragraph = []
            continue
        if re.match(r"^ {0,3}>", text):
            paragraph, item = [], 1000  # lazy lines go on until a blank one
            continue
        if (m := _ITEM.match(text)) and not (paragraph and (not text[m.end() :].strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
            paragraph, item = [], len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) < 5 else 1)
            continue
        if m := _HTML.match(text):
            kind = next(i for i in range(1, 7) if m[i])
            end = "" if kind == 6 else _HTML_END[kind - 1].format((m[1] or "").lower())
            if not (end and end in text.lower()[m.end() :]):
                html_end = end
            paragraph = []
            continue
        paragraph.append((start, text))


def _starts_block(text: str) -> bool:
    return bool(_ATX.match(text) or _FENCE.match(text) or _BREAK.match(text) or _ITEM.match(text) or _HTML.match(text) or re.match(r"^ {0,3}>", text))


def sections(source: str) -> Iterator[tuple[list[str], str]]:
    """(headings, text) of each section. Text before the first heading belongs to none; a further level-1 heading drops the section before it."""
    title = second = None
    path: list[str] | None = None
    begin = 0
    for level, text, start, end in headings(source):
        if level > 3:
            continue
        if level > 1:
            if path is not None:
                yield path, source[begin:start]
            if level == 2:
                second = text
            path = [x for x in (title, second if level == 3 else None) if x] + [text]
        else:
            title, path = text, [text]
        begin = end
    if path is not None:
        yield path, source[begin:]


def pack(content: str, size: int = MAX_CHUNK) -> list[str]:
    """Paragraphs joined as long as they fit, larger ones cut hard; sizes are in UTF-16 units."""
    parts, current = [], ""
    for paragraph in content.split("\n\n"):
        joined = f"{current}\n\n{paragraph}" if current else paragraph
        if utf16(joined) > size and current:
            parts.append(current)
            current = paragraph
        else:
            current = joined
    if current:
        parts.append(current)
    out = []
    for part in parts:
        if utf16(part) <= size:
            out.append(part)
        else:
            units = part.encode("utf-16-le", "surrogatepass")
            out += [units[i : i + 2 * size].decode("utf-16-le", "replace") for i in range(0, len(units), 2 * size)]  # a character cut in two is U+FFFD twice
    return out


def kind_of(path: str) -> str:
    name = os.path.basename(path).lower()
    return "glossary" if "glossary" in name else "use-case" if "use-case" in name or "use_case" in name else "guide"


def parse_markdown_text(source: str, api_id: str, path: str) -> list[dict]:
    """Chunks of a markdown text; two sections under one path of headings have one id, and the later is meant to win."""
    name = os.path.basename(path).removesuffix(".md")
    out = []
    for heads, text in sections(source):
        content = trimmed(text)
        if not content:
            continue
        ident = f"{api_id}:doc:{name}:{'/'.join(map(slug, heads))}"
        meta = {"filePath": path, "headings": heads}
        if utf16(content) > MAX_CHUNK:
            for i, part in enumerate(pack(content)):
                out.append(chunk(f"{ident}:{i}", api_id, kind_of(path), heads[-1], part, {**meta, "chunkIndex": i}, len(out)))
        else:
            out.append(chunk(ident, api_id, kind_of(path), heads[-1], content, meta, len(out)))
    return out


def parse_markdown_file(path: str, api_id: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            source = f.read()
    except OSError as e:
        raise ValueError(f'Failed to read markdown file for "{api_id}" at {path}: {e}') from e
    return parse_markdown_text(source, api_id, path)


def markdown_files(folder: str) -> list[str]:
    """The .md files of a folder itself, by name; none if it is absent."""
    return sorted((f for f in os.listdir(folder) if f.endswith(".md")), key=lambda f: f.encode("utf-16-be", "surrogatepass")) if os.path.isdir(folder) else []


def parse_markdown_dir(folder: str, api_id: str) -> list[dict]:
    out = [c for f in markdown_files(folder) for c in parse_markdown_file(os.path.join(folder, f), api_id)]
    for i, c in enumerate(out):
        c["seq"] = i
    return out


def read_frame(spark, folder: str, api_id: str) -> DataFrame:
    """The markdown files of a folder as rows (path, content, api_id), read by Spark."""
    from pyspark.sql import functions as F

    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.lit(api_id).alias("api_id"))


def split_frame(files: DataFrame) -> DataFrame:
    """Chunks of a table of markdown texts (path, content, api_id), on the executors."""
    one = lambda text, api_id, path: parse_markdown_text(text or "", api_id, path)
    return files.select("path", "content", "api_id").mapInArrow(lambda batches: chunk_batches(batches, one), CHUNK_FIELDS)
