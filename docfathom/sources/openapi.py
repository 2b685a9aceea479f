"""OpenAPI 3.x files as chunks: one overview, one per endpoint, one per schema of three properties or more."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame

from . import yamlish

# The order of methods, and the least number of properties of a schema chunk.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
LEAST_PROPERTIES = 3
#: Chunks that a worker gathers before it gives them away, about; those of one file stay together.
CHUNKS_AT_ONCE = 500
CHUNK_FIELDS = "id string, api_id string, type string, title string, content string, content_hash string, metadata string, seq int"


def entries(mapping) -> list[tuple[str, object]]:
    """A mapping's items as JavaScript lists them: whole numbers first, ascending, then the others as written."""
    items = list((mapping or {}).items())
    number = [x for x in items if x[0].isdigit() and str(int(x[0])) == x[0] and int(x[0]) < 2**32 - 1]
    return sorted(number, key=lambda x: int(x[0])) + [x for x in items if x not in number]


def there(value) -> bool:
    """Whether a value counts as given: empty mappings and lists do."""
    return value is not None and value is not False and value != 0 and value != ""


def shown(value) -> str:
    """A value in a text: lists by commas, absent ones by name."""
    if isinstance(value, list):
        return ",".join("" if v is None else shown(v) for v in value)
    if value is None:
        return "undefined"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


class Resolver:
    """Follows $ref, inside a document and to files beside it; a reference to itself is empty.

    A reference stands for a place in the file that it is written in: the file it names lies beside that one, and a bare #/... is that
    file's own. Pointers may lead through other references.
    """

    def __init__(self, document, path: str, read: Callable[[str], str]):
        self.root, self.read = os.path.normpath(path), read
        self.files = {self.root: document}

    def target(self, ref: str, base: str, steps: int = 0) -> tuple[object, str]:
        """What a reference written in the file base stands for, and the file that this is in."""
        if steps > 100:
            raise ValueError(f"{ref} refers to itself")
        name, _, pointer = ref.partition("#")
        file = os.path.normpath(os.path.join(os.path.dirname(base), unquote(name))) if name else base
        if file not in self.files:
            self.files[file] = yamlish.load(self.read(file))
        node = self.files[file]
        for part in pointer.strip("/").split("/") if pointer.strip("/") else []:
            part = unquote(part).replace("~1", "/").replace("~0", "~")
            if isinstance(node, dict) and part not in node and isinstance(node.get("$ref"), str):
                node, file = self.target(node["$ref"], file, steps + 1)
            try:
                node = node[int(part)] if isinstance(node, list) else node[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise ValueError(f'Token "{part}" does not exist.') from None
        return node, file

    def deep(self, node, base: str | None = None, open_refs: tuple[tuple[str, str], ...] = ()):
        base = base or self.root
        if isinstance(node, list):
            return [self.deep(x, base, open_refs) for x in node]
        if not isinstance(node, dict):
            return node
        ref = node.get("$ref")
        if isinstance(ref, str):
            name, _, pointer = ref.partition("#")
            place = (os.path.normpath(os.path.join(os.path.dirname(base), unquote(name))) if name else base, pointer.strip("/"))
            if place in open_refs:
                return {}
            found, file = self.target(ref, base)
            got = self.deep(found, file, (*open_refs, place))
            rest = {k: self.deep(v, base, open_refs) for k, v in node.items() if k != "$ref"}
            return {**got, **rest} if isinstance(got, dict) else got
        return {k: self.deep(v, base, open_refs) for k, v in node.items()}


def _schema_lines(schema: dict) -> str:
    kind = schema.get("type")
    if kind == "object" and there(schema.get("properties")):
        out = ["- type: object", "  properties:"]
        for name, p in entries(schema["properties"]):
            out.append(f"    - {name} ({shown(p['type']) if p.get('type') is not None else 'unknown'})" + (f" - {p['description']}" if p.get("description") else ""))
        return "\n".join(out)
    if kind == "array" and "items" in schema:
        of = (schema["items"] or {}).get("type")
        return f"- type: array of {shown(of) if of is not None else 'object'}"
    return f"- type: {shown(kind)}" if kind else ""


def _media(content, lead: str) -> Iterator[str]:
    for kind, media in entries(content):
        yield f"{lead}Content-Type: {kind}"
        if there((media or {}).get("schema")):
            yield _schema_lines(media["schema"])


def _overview(doc: dict) -> tuple[str, list[str]]:
    info = doc.get("info") or {}
    lines = [f"# {shown(info.get('title'))}", f"\nVersion: {shown(info.get('version'))}"]
    if info.get("description"):
        lines.append(f"\n{info['description']}")
    if doc.get("servers"):
        lines.append("\n## Servers\n")
        lines += [f"- {shown(s.get('url'))}" + (f" ({s['description']})" if s.get("description") else "") for s in doc["servers"]]
    return shown(info.get("title")), lines


def _endpoint(method: str, path: str, op: dict) -> list[str]:
    lines = [f"# {method.upper()} {path}"]
    lines += [f"\n{op[k]}" for k in ("summary", "description") if op.get(k)]
    if op.get("parameters"):
        lines.append("\n## Parameters\n")
        for p in op["parameters"]:
            kind = (p.get("schema") or {}).get("type")
            lines.append(f"- **{shown(p.get('name'))}** [{shown(p.get('in'))}]" + (f" : {shown(kind)}" if kind else "") + (" (required)" if p.get("required") else ""))
    if there((op.get("requestBody") or {}).get("content")):
        lines += ["\n## Request Body\n", *_media(op["requestBody"]["content"], "")]
    if there(op.get("responses")):
        lines.append("\n## Responses\n")
        for status, r in entries(op["responses"]):
            lines.append(f"### {status}: {shown((r or {}).get('description'))}")
            if there((r or {}).get("content")):
                lines += _media(r["content"], "\n")
    return lines


def _schema(name: str, s: dict) -> list[str]:
    lines = [f"# {name}"]
    if s.get("description"):
        lines.append(f"\n{s['description']}")
    lines.append("\n## Properties\n")
    for key, p in entries(s["properties"]):
        kind = shown(p["type"]) if p.get("type") is not None else "unknown"
        lines.append(f"- **{key}** ({kind})" + (" (required)" if key in (s.get("required") or []) else "") + (f" - {p['description']}" if p.get("description") else ""))
    return lines


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def chunk(ident: str, api_id: str, kind: str, title: str, content: str, metadata=None, seq: int = 0) -> dict:
    digest = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
    return {"id": ident, "api_id": api_id, "type": kind, "title": title, "content": content, "content_hash": digest, "metadata": None if metadata is None else compact(metadata), "seq": seq}


def parse_openapi_text(text: str, api_id: str, path: str, read: Callable[[str], str] | None = None) -> list[dict]:
    """Chunks of a specification."""
    try:
        raw = yamlish.load(text)
        if not isinstance(raw, dict):
            raise ValueError(f'"{path}" is not a valid JSON Schema')
        raw = Resolver(raw, path, read or (lambda p: open(p, encoding="utf-8").read())).deep(raw)
    except Exception as e:
        raise ValueError(f'Failed to parse OpenAPI spec for "{api_id}" at {path}: {e}') from e
    version = raw.get("openapi")
    if not isinstance(version, str) or not version.startswith("3."):
        found = next((raw[k] for k in ("openapi", "swagger") if raw.get(k) is not None), "unknown")
        raise ValueError(f"Spec at {path} is not OpenAPI 3.x (found: {shown(found)}). Only OpenAPI 3.x is supported.")
    title, lines = _overview(raw)
    out = [chunk(f"{api_id}:overview", api_id, "overview", title, "\n".join(lines))]
    for route, item in entries(raw.get("paths")):
        for method in METHODS:
            op = (item or {}).get(method)
            if there(op):
                meta = {"path": route, "method": method, "tags": op["tags"] if op.get("tags") is not None else [], "operationId": op.get("operationId")}
                out.append(chunk(f"{api_id}:endpoint:{method}:{route}", api_id, "endpoint", f"{method.upper()} {route}", "\n".join(_endpoint(method, route, op)), meta))
    for name, s in entries((raw.get("components") or {}).get("schemas")):
        n = len((s or {}).get("properties") or {})
        if n >= LEAST_PROPERTIES:
            out.append(chunk(f"{api_id}:schema:{name}", api_id, "schema", name, "\n".join(_schema(name, s)), {"schemaName": name, "propertyCount": n}))
    for i, c in enumerate(out):
        c["seq"] = i
    return out


def parse_openapi_file(path: str, api_id: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ValueError(f'Failed to parse OpenAPI spec for "{api_id}" at {path}: {e}') from e
    return parse_openapi_text(text, api_id, path)


def chunk_batches(batches: Iterable, parse: Callable[[str, str, str], list[dict]]) -> Iterator:
    """Chunks of batches of files (path, content, api_id) by parse(content, api_id, path): one file after the other is taken from a batch,
    and chunks are given away before there are many more than CHUNKS_AT_ONCE."""
    import pyarrow as pa

    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (f.split() for f in CHUNK_FIELDS.split(", "))])
    out: list[dict] = []
    for batch in batches:
        path, content, api_id = (batch.column(c) for c in ("path", "content", "api_id"))
        for i in range(batch.num_rows):
            out += parse(content[i].as_py(), api_id[i].as_py(), path[i].as_py())
            if len(out) >= CHUNKS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def split_frame(specs: DataFrame) -> DataFrame:
    """Chunks of a table of specifications (path, content, api_id), on the executors; they may refer to themselves only.

    They are dealt out first: a parser takes milliseconds for a kilobyte, and a table of one file would be one task.
    """

    def absent(path: str) -> str:
        raise ValueError(f"{path} is another file")

    spark = specs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = specs.select("path", "content", "api_id").repartition(n)
    return dealt.mapInArrow(lambda batches: chunk_batches(batches, lambda text, api_id, path: parse_openapi_text(text, api_id, path, absent)), CHUNK_FIELDS)
