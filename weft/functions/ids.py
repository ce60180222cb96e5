"""Stable identifiers and text predicates as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s+|\s+$"
#: Quotes and brackets that may enclose a part of a table name.
_QUOTES = r"(?U)^[\s`'\"\[\]]+|[\s`'\"\[\]]+$"

#: First words of SQL statements; fixed values.
SQL_STARTS = ("select", "insert", "update", "delete", "create", "merge", "with", "replace", "upsert", "truncate")


def strip(column: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(column, _BLANK, "")


def node_id(kind: str, *parts: Column) -> Column:
    """``kind:part[:part...]`` with parts stripped and blank ones left out; an error if none is left."""
    kept = F.filter(F.transform(F.array(*parts), strip), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) > 0, F.concat(F.lit(kind + ":"), F.array_join(kept, ":"))).otherwise(
        F.raise_error(F.lit(f"a node id of type {kind} needs at least one part"))
    )


def relation_key(name: Column) -> Column:
    """A table name in lower case without quotes, brackets and blanks around its dotted parts; null if nothing is left."""
    parts = F.transform(F.split(name, r"\.", -1), lambda p: F.lower(F.regexp_replace(p, _QUOTES, "")))
    return F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), "."), F.lit(""))


def table_name(name: Column) -> Column:
    """As ``relation_key``, but an empty name is an error."""
    return F.coalesce(relation_key(name), F.raise_error(F.lit("an empty table name")).cast("string"))


def sql_table_id(name: Column) -> Column:
    return F.concat(F.lit("sql_table:"), table_name(name))


def python_module_id(module: Column) -> Column:
    return node_id("python_module", module)


def python_function_id(module: Column, function: Column) -> Column:
    """Module and function joined by a dot, in their own case."""
    dotted = F.array_join(F.filter(F.array(strip(module), strip(function)), lambda p: p.isNotNull() & (p != "")), ".")
    return F.concat(F.lit("python_function:"), F.regexp_replace(dotted, r"^\.+|\.+$", ""))


def dbt_model_id(name: Column) -> Column:
    return node_id("dbt_model", name)


def dbt_source_id(source: Column, table: Column) -> Column:
    return F.concat(F.lit("dbt_source:"), strip(source), F.lit("."), strip(table))


def route_path(path: Column) -> Column:
    """A path with its leading slash; a blank one is ``/``."""
    p = F.coalesce(F.nullif(strip(path), F.lit("")), F.lit("/"))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def api_route_id(method: Column, path: Column) -> Column:
    return node_id("api_route", F.upper(method), route_path(path))


def join_paths(prefix: Column, path: Column) -> Column:
    """A route below a prefix; the prefix ``/`` changes nothing and slashes are not doubled."""
    left, right = route_path(prefix), route_path(path)
    return F.when(left == "/", right).otherwise(F.concat(F.regexp_replace(left, "/+$", ""), right))


def pipeline_dataset_id(name: Column) -> Column:
    return node_id("pipeline_dataset", relation_key(name))


def temp_view_id(module: Column, name: Column) -> Column:
    """Temporary views belong to their module; a blank module is ``__main__``."""
    owner = F.coalesce(F.nullif(strip(module), F.lit("")), F.lit("__main__"))
    return node_id("temp_view", owner, relation_key(name))


def django_model_id(module: Column, name: Column) -> Column:
    """Module and class, without a trailing ``.models`` of the module."""
    owner = F.regexp_replace(strip(module), r"(^|\.)models$", "")
    return F.concat(F.lit("django_model:"), F.array_join(F.filter(F.array(owner, strip(name)), lambda p: p != ""), "."))


def sqlalchemy_model_id(module: Column, name: Column) -> Column:
    return F.concat(F.lit("sqlalchemy_model:"), strip(module), F.lit("."), strip(name))


def llm_id(model: Column, provider: Column) -> Column:
    return node_id("llm", provider, model)


def embedding_model_id(name: Column) -> Column:
    return node_id("embedding_model", name)


def vector_store_id(vendor: Column) -> Column:
    return node_id("vector_store", F.lower(vendor))


def vector_collection_id(name: Column, vendor: Column | None = None) -> Column:
    return node_id("vector_collection", *([F.lower(vendor)] if vendor is not None else []), name)


def langgraph_node_id(name: Column, scope: Column | None = None) -> Column:
    return node_id("langgraph_node", *([scope] if scope is not None else []), name)


def host_of(address: Column) -> Column:
    """The lower-case host of an address, without scheme, user, port and path; brackets of IPv6 are dropped."""
    h = F.regexp_replace(F.lower(strip(address)), r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_replace(h, r"[/?#].*$", ""), r"^.*@", "")
    return F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(h, r":.*$", ""))


def external_system_id(host: Column) -> Column:
    return node_id("external_system", host_of(host))


def http_host(url: Column) -> Column:
    """The host of an absolute http or https address; null for anything else."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")))


def module_of_path(path: Column) -> Column:
    """The dotted module of a Python file: no suffix, no leading ``src/``, no trailing ``__init__``."""
    p = F.regexp_replace(F.regexp_replace(path, r"(?i)\.py$", ""), r"^src/", "")
    return F.translate(F.regexp_replace(p, r"(^|/)__init__$", ""), "/", ".")


def looks_like_sql(text: Column) -> Column:
    """Whether the first word, after blanks and opening brackets, begins a statement."""
    first = F.lower(F.regexp_extract(text, r"^[\s(]*([^\s(;]+)", 1))
    return F.coalesce(first.isin(*SQL_STARTS), F.lit(False))


def looks_like_jinja(text: Column) -> Column:
    return F.coalesce(text.contains("{{") | text.contains("{%") | text.contains("{#"), F.lit(False))


def jinja_is_unbalanced(text: Column) -> Column:
    count = lambda t: F.regexp_count(text, F.lit(t))
    return (count(r"\{\{") != count(r"\}\}")) | (count(r"\{%") != count(r"%\}"))


def mermaid_id(column: Column) -> Column:
    """Characters other than letters, digits and ``_`` become ``_``, which is trimmed at the ends; ``n_`` goes before a
    digit, and nothing left is ``n``."""
    clean = F.regexp_replace(F.regexp_replace(column, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(clean == "", "n").when(clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean)


def display_name(name: Column, kind: Column) -> Column:
    """Functions are shown with ``()``."""
    return F.when((kind == "python_function") & ~name.endswith("()"), F.concat(name, F.lit("()"))).otherwise(name)


#: Layers in the order in which they are looked for; fixed values.
LAYERS = ("bronze", "silver", "gold")


def layer_of(identifier: Column) -> Column:
    """bronze, silver or gold if the part after the type begins with it or has it as an inner dotted part; else null."""
    part = F.lower(F.regexp_replace(identifier, r"^[^:]*:", ""))
    out = F.lit(None).cast("string")
    for layer in reversed(LAYERS):
        out = F.when(part.startswith(layer + ".") | part.contains(f".{layer}."), F.lit(layer)).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``**/`` spans directories, ``**`` anything, ``*`` and ``?`` stay in a segment."""
    import re

    out, i = "", 0
    while i < len(pattern):
        for token, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(token, i):
                out, i = out + regex, i + len(token)
                break
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_globs(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last segment matches a pattern; leading dots and slashes are ignored on both sides."""
    rel, base = F.regexp_replace(path, r"^[./]+", ""), F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        regex = glob_regex(p.lstrip("./"))
        hit = hit | rel.rlike(regex) | base.rlike(regex)
    return hit


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; no inclusion pattern includes everything."""
    kept = matches_globs(path, include) if include else F.lit(True)
    return kept & ~matches_globs(path, exclude)


def evidence_metadata(**values: Column) -> Column:
    """A map of JSON texts without nulls and blanks; ``line_number`` only if above 0."""
    pairs = []
    for key, value in values.items():
        shown = F.when(value > 0, value.cast("string")) if key == "line_number" else F.when(value != "", F.to_json(F.struct(value.alias("v"))))
        if key != "line_number":
            shown = F.regexp_extract(shown, r'^\{"v":(.*)\}$', 1)
        pairs += [F.lit(key), shown]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))
