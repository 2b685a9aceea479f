"""The registry of sources: a YAML file with lists of APIs and document folders."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from . import yamlish


@dataclass(frozen=True)
class ApiEntry:
    name: str
    spec: str
    docs: str | None = None


@dataclass(frozen=True)
class DocEntry:
    name: str
    path: str


@dataclass(frozen=True)
class Registry:
    apis: list[ApiEntry] = field(default_factory=list)
    docs: list[DocEntry] = field(default_factory=list)


def _text(value) -> bool:
    return isinstance(value, str) and value != ""


def load_registry(path: str) -> Registry:
    """Read and check a registry; paths in it are relative to its folder."""
    with open(path, encoding="utf-8") as f:
        data = yamlish.load(f.read())
    if not isinstance(data, dict) or not any(isinstance(data.get(k), list) for k in ("apis", "docs")):
        raise ValueError(f'Invalid apis.yml: expected top-level "apis" or "docs" array in {path}')
    base = os.path.dirname(os.path.abspath(path))
    place = lambda p: os.path.normpath(os.path.join(base, p))
    apis, docs, section_of = [], [], {}
    for i, entry in enumerate(data.get("apis") or []):
        e = entry if isinstance(entry, dict) else {}
        if not _text(e.get("name")):
            raise ValueError(f'apis.yml entry {i}: missing or invalid "name"')
        if not _text(e.get("spec")):
            raise ValueError(f'apis.yml entry {i} ({e["name"]}): missing or invalid "spec"')
        if e.get("docs") and not isinstance(e["docs"], str):
            raise ValueError(f'apis.yml entry {i} ({e["name"]}): "docs" must be a string')
        apis.append(ApiEntry(e["name"], place(e["spec"]), place(e["docs"]) if e.get("docs") else None))
    for i, entry in enumerate(data.get("docs") or []):
        e = entry if isinstance(entry, dict) else {}
        if not _text(e.get("name")):
            raise ValueError(f'apis.yml docs entry {i}: missing or invalid "name"')
        if not _text(e.get("path")):
            raise ValueError(f'apis.yml docs entry {i} ({e["name"]}): missing or invalid "path"')
        docs.append(DocEntry(e["name"], place(e["path"])))
    for a in apis:
        if a.name in section_of:
            raise ValueError(f'apis.yml: duplicate name "{a.name}" within apis section')
        section_of[a.name] = "apis"
    for x in docs:
        if x.name in section_of:
            raise ValueError(f'apis.yml: duplicate name "{x.name}" (appears in both {section_of[x.name]} and docs sections)')
        section_of[x.name] = "docs"
    return Registry(apis, docs)
