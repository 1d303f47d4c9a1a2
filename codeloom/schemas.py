"""Schemas of the graph's tables and of what extractors say about a file."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _cut(text: str) -> list[str]:
    """At commas outside angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def _type(text: str) -> T.DataType:
    if text in _SIMPLE:
        return _SIMPLE[text]
    outer, inner = text[:-1].split("<", 1)
    if outer == "array":
        return T.ArrayType(_type(inner))
    return T.StructType([T.StructField(name.strip(" `"), _type(kind.strip())) for name, kind in (f.split(":", 1) for f in _cut(inner))])


def _struct(text: str) -> T.StructType:
    """A schema from its text, read here: workers import this module and have no session to ask."""
    return T.StructType([T.StructField(name.strip("`"), _type(kind)) for name, kind in (f.split(" ", 1) for f in _cut(text))])


DOMAIN_META = "struct<entities: array<string>, business_rules: array<string>, cross_domain_interactions: array<string>, entry_point: string, entry_type: string>"
KNOWLEDGE_META = "struct<wikilinks: array<string>, backlinks: array<string>, category: string, content: string>"
NODE = _struct(
    "id string, type string, name string, file_path string, line_start int, line_end int, summary string, tags array<string>, complexity string, "
    f"language_notes string, domain_meta {DOMAIN_META}, knowledge_meta {KNOWLEDGE_META}"
)
EDGE = _struct("source string, target string, type string, direction string, description string, weight double")
LAYER = _struct("id string, name string, description string, node_ids array<string>")
TOUR_STEP = _struct("`order` int, title string, description string, node_ids array<string>, language_lesson string")
PROJECT = _struct("name string, languages array<string>, frameworks array<string>, description string, analyzed_at string, git_commit_hash string")
META = _struct("last_analyzed_at string, git_commit_hash string, version string, analyzed_files int")
ISSUE = _struct("level string, category string, message string, path string")
FINGERPRINT = _struct(
    "file_path string, content_hash string, "
    "functions array<struct<name: string, params: array<string>, return_type: string, exported: boolean, line_count: int>>, "
    "classes array<struct<name: string, methods: array<string>, properties: array<string>, exported: boolean, line_count: int>>, "
    "imports array<struct<source: string, specifiers: array<string>>>, exports array<string>, total_lines int, has_structural_analysis boolean"
)

_METHOD = "struct<name: string, line_start: int, line_end: int, params: array<string>, return_type: string>"
_NAMED = "name: string, line_start: int, line_end: int"
#: One row for each file: the fourteen lists that its extractor fills, and the calls and references in it.
ANALYSIS = _struct(
    "file_path string, language string, "
    f"functions array<struct<{_NAMED}, params: array<string>, return_type: string>>, "
    f"classes array<struct<{_NAMED}, methods: array<{_METHOD}>, properties: array<string>, extends: array<string>, implements: array<string>>>, "
    f"variables array<struct<{_NAMED}, type_annotation: string>>, "
    f"enums array<struct<{_NAMED}, `values`: array<string>, methods: array<{_METHOD}>>>, "
    f"interfaces array<struct<{_NAMED}, methods: array<{_METHOD}>, properties: array<string>, extends: array<string>>>, "
    f"type_aliases array<struct<{_NAMED}>>, "
    "imports array<struct<source: string, specifiers: array<string>, line: int>>, "
    "exports array<struct<name: string, line: int, is_default: boolean>>, "
    f"sections array<struct<{_NAMED}, level: int>>, "
    f"definitions array<struct<{_NAMED}, kind: string, fields: array<string>>>, "
    f"services array<struct<{_NAMED}, image: string, ports: array<int>>>, "
    "endpoints array<struct<method: string, path: string, line_start: int, line_end: int>>, "
    f"steps array<struct<{_NAMED}>>, "
    f"resources array<struct<{_NAMED}, kind: string>>, "
    "calls array<struct<caller: string, callee: string, line: int>>, "
    "refs array<struct<target: string, kind: string, line: int>>"
)
#: A file as sources hand it on.
FILE = _struct("path string, content string")
