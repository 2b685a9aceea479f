"""YAML as version 1.2 reads it: only true, false, null and numbers are not text, and mapping keys are text."""

from __future__ import annotations

import re

import yaml


class _Loader(yaml.SafeLoader):
    pass


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def _mapping(loader, node):
    loader.flatten_mapping(node)
    out = {}
    for k, v in node.value:
        key = k.value if isinstance(k, yaml.ScalarNode) else str(loader.construct_object(k, deep=True))
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def load(text: str):
    """Parse YAML or JSON (its subset)."""
    return yaml.load(text, Loader=_Loader)  # noqa: S506  a safe loader
