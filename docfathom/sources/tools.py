"""The five query tools; each gives a text, and whether it is an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators.hybrid import SearchOptions
from . import embed
from .format import format_api_list, format_endpoint_list, format_search_results
from .store import CHUNK_TYPES, IndexStore, read_chunk


@dataclass(frozen=True)
class ToolResult:
    text: str
    is_error: bool = False

    def message(self) -> dict:
        """The result as a tool server sends it."""
        out: dict = {"content": [{"type": "text", "text": self.text}]}
        return out | ({"isError": True} if self.is_error else {})


def _guarded(what: str, run: Callable[[], ToolResult]) -> ToolResult:
    try:
        return run()
    except Exception as e:
        return ToolResult(f"{what}: {e}", True)


def list_apis(store: IndexStore) -> ToolResult:
    return _guarded("Failed to list APIs", lambda: ToolResult(format_api_list(store.get_apis())))


def _search(store: IndexStore, query: str, options: SearchOptions, apis: list[dict]) -> ToolResult:
    found = store.search(query, embed.embed_query(query), options)
    return ToolResult(format_search_results([f["chunk"] for f in found], {a["id"]: a["name"] for a in apis}))


def search_api_docs(store: IndexStore, query: str, api_name: str | None = None, types: list[str] | None = None) -> ToolResult:
    """Search one API, or everything, document sources too."""

    def run() -> ToolResult:
        apis, api = store.get_apis(), None
        if api_name:
            api = next((a for a in apis if a["name"] == api_name), None)
            if api is None:
                return ToolResult(f'API "{api_name}" not found.', True)
        return _search(store, query, SearchOptions(api_id=api and api["id"], types=types), apis)

    return _guarded("Search failed", run)


def search_docs(store: IndexStore, query: str, name: str | None = None, types: list[str] | None = None) -> ToolResult:
    """Search sources without a specification."""

    def run() -> ToolResult:
        apis = store.get_apis()
        docs = [a for a in apis if not a["spec_path"]]
        if not docs:
            return ToolResult("No documentation indexed. Run ingestion first.", True)
        chosen = [a for a in docs if a["name"] == name] if name else docs
        if not chosen:
            return ToolResult(f'Doc source "{name}" not found. Available: {", ".join(a["name"] for a in docs)}', True)
        return _search(store, query, SearchOptions(api_ids=[a["id"] for a in (chosen[:1] if name else chosen)], types=types), apis)

    return _guarded("Search failed", run)


def get_api_endpoints(store: IndexStore, api_name: str) -> ToolResult:
    def run() -> ToolResult:
        api = next((a for a in store.get_apis() if a["name"] == api_name), None)
        if api is None:
            return ToolResult(f'API "{api_name}" not found.', True)
        return ToolResult(format_endpoint_list(api_name, [read_chunk(r) for r in store.chunks_by_api(api["id"], "endpoint").collect()]))

    return _guarded("Failed to get endpoints", run)


def get_api_spec(store: IndexStore, api_name: str) -> ToolResult:
    def run() -> ToolResult:
        if not any(a["name"] == api_name for a in store.get_apis()):
            return ToolResult(f'API "{api_name}" not found.', True)
        content = store.spec_content(api_name)
        return ToolResult(content) if content else ToolResult(f'No spec content stored for "{api_name}".', True)

    return _guarded("Failed to get spec", run)


@dataclass(frozen=True)
class Tool:
    """A tool as a server offers it: its function, and its arguments in order (name, whether required, schema)."""

    run: Callable[..., ToolResult]
    title: str
    description: str
    arguments: tuple[tuple[str, bool, dict], ...] = ()

    def schema(self) -> dict:
        out: dict = {"type": "object", "properties": {name: kind for name, _, kind in self.arguments}}
        needed = [name for name, required, _ in self.arguments if required]
        return out | ({"required": needed} if needed else {})

    def wrong(self, given: dict) -> str | None:
        """What is wrong with arguments, if anything is."""
        for name, required, kind in self.arguments:
            value = given.get(name)
            if name not in given:
                if required:
                    return f"{name} is required"
            elif kind["type"] == "string" and not isinstance(value, str):
                return f"{name} must be a string"
            elif kind["type"] == "array":
                known = kind["items"]["enum"]
                if not isinstance(value, list) or any(v not in known for v in value):
                    return f"{name} must be a list of {', '.join(known)}"
        return None


def _string(text: str) -> dict:
    return {"type": "string", "description": text}


_TYPES = ("types", False, {"type": "array", "items": {"type": "string", "enum": list(CHUNK_TYPES)}, "description": f"Only chunks of these types: {', '.join(CHUNK_TYPES)}"})
_API = ("apiName", True, _string("The name of the API, as list-apis gives it"))

#: Tools by the names a server offers them under.
TOOLS = {
    "list-apis": Tool(list_apis, "List APIs", "All sources in the index, with their versions. Ask this first to learn the names that the other tools take."),
    "search-api-docs": Tool(
        search_api_docs, "Search API Documentation", "Search what is indexed about APIs: endpoints, schemas, formats of requests and responses, behaviour.",
        (("query", True, _string("What to look for, in plain words")), ("apiName", False, _string("Only this API")), _TYPES),
    ),
    "search-docs": Tool(
        search_docs, "Search Documentation", "Search documentation that belongs to no API, such as architecture notes and guides.",
        (("query", True, _string("What to look for, in plain words")), ("name", False, _string("Only this source; all sources without it")), _TYPES),
    ),
    "get-api-endpoints": Tool(get_api_endpoints, "Get API Endpoints", "All endpoints of an API, with methods and paths.", (_API,)),
    "get-api-spec": Tool(get_api_spec, "Get API Spec", "The specification of an API as it was ingested.", (_API,)),
}


def serve(store: IndexStore, lines, write: Callable[[str], None]) -> None:
    """JSON-RPC over lines: initialize, ping, tools/list and tools/call. Lines that are no requests are answered by errors, notifications not at all."""
    import json

    def fail(ident, code: int, message: str) -> None:
        write(json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}))

    for line in lines:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
        except ValueError as e:
            fail(None, -32700, f"not JSON: {e}")
            continue
        if not isinstance(asked, dict):
            fail(None, -32600, "not a request")
            continue
        if "id" not in asked:
            continue
        method, params = asked.get("method"), asked.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "docfathom", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "title": t.title, "description": t.description, "inputSchema": t.schema()} for n, t in TOOLS.items()]}
        elif method == "tools/call" and params.get("name") in TOOLS:
            tool, given = TOOLS[params["name"]], params.get("arguments") or {}
            if wrong := tool.wrong(given):
                fail(asked["id"], -32602, f"Invalid arguments for tool {params['name']}: {wrong}")
                continue
            result = tool.run(store, *[given.get(name) for name, _, _ in tool.arguments]).message()
        else:
            fail(asked["id"], -32601, f"Unknown method or tool: {params.get('name', method)}")
            continue
        write(json.dumps({"jsonrpc": "2.0", "id": asked["id"], "result": result}, ensure_ascii=False))
