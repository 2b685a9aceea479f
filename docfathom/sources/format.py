"""Results as markdown, as columns and for rows on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of empty results, and the separators.
NO_APIS, NO_RESULTS = "No APIs indexed yet.", "No results found for your query."
BETWEEN = "\n\n---\n\n"


def _api_line() -> Column:
    version = F.when(F.coalesce(F.col("version"), F.lit("")) != "", F.concat(F.lit(" (v"), F.col("version"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- **"), F.col("name"), F.lit("**"), version)


def api_list(apis: DataFrame) -> DataFrame:
    """One row, text: the list of APIs (name, version) by name."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name", _api_line().alias("line")))), lambda x: x["line"])
    told = apis.agg(lines.alias("lines"))
    return told.select(F.when(F.size("lines") == 0, NO_APIS).otherwise(F.concat(F.lit("## Indexed APIs\n\n"), F.array_join("lines", "\n"))).alias("text"))


def endpoint_lines(method: Column, path: Column, title: Column) -> Column:
    full = (F.coalesce(method, F.lit("")) != "") & (F.coalesce(path, F.lit("")) != "")
    return F.when(full, F.concat(F.lit("- **"), F.upper(method), F.lit("** `"), path, F.lit("` — "), title)).otherwise(F.concat(F.lit("- "), title))


def result_sections() -> Column:
    """A found chunk (title, type, content, and name or api_id of its source)."""
    return F.concat(F.lit("### "), F.col("title"), F.lit("\n`"), F.col("type"), F.lit("` · "), F.coalesce("name", "api_id"), F.lit("\n\n"), F.col("content"))


def format_api_list(apis: Sequence[Mapping]) -> str:
    if not apis:
        return NO_APIS
    return "## Indexed APIs\n\n" + "\n".join(f"- **{a['name']}**" + (f" (v{a['version']})" if a.get("version") else "") for a in apis)


def format_search_results(found: Sequence[Mapping], names: Mapping[str, str]) -> str:
    if not found:
        return NO_RESULTS
    return "## Search Results\n\n" + BETWEEN.join(f"### {c['title']}\n`{c['type']}` · {names.get(c['api_id'], c['api_id'])}\n\n{c['content']}" for c in found)


def format_endpoint_list(api: str, endpoints: Sequence[Mapping]) -> str:
    if not endpoints:
        return f'No endpoints found for "{api}".'
    lines = []
    for c in endpoints:
        told = c.get("metadata") or {}
        method, path = (told.get("method") or "").upper(), told.get("path") or ""
        lines.append(f"- **{method}** `{path}` — {c['title']}" if method and path else f"- {c['title']}")
    return f"## {api} Endpoints\n\n" + "\n".join(lines)
