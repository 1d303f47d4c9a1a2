"""Column expressions: identities, paths, text and small lookups. All of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import tables


def mapped(col: Column, table: dict[str, str]) -> Column:
    """``table[col]``, null where there is no such key. The table is a literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col)


def one_of(col: Column, values) -> Column:
    return col.isin(*values)


# identities


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(kind: str | Column, path: Column, *names: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, path, *names)


def layer_id(name: Column) -> Column:
    """``layer:`` and the name in lower case with hyphens for spaces."""
    return F.concat(F.lit("layer:"), F.replace(F.lower(name), F.lit(" "), F.lit("-")))


# paths


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """From the last dot of the file name, in lower case; empty for none, and for a name whose only dot comes first or last."""
    name = base_name(path)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def top_directory(path: Column) -> Column:
    """The first real segment above the file; null for a file at the top. Backslashes count as slashes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) > 1, parts[0])


def language_of(path: Column) -> Column:
    """Language id by file name (whatever its case), else by what follows the last dot; null if unknown."""
    name = F.lower(base_name(path))
    dotted = F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    return F.coalesce(mapped(name, tables.BY_FILE), mapped(dotted, tables.BY_EXTENSION))


def parser_language_of(path: Column) -> Column:
    """The language whose parser gets a file: as configured, with what only extractors know, and .tsx as its own."""
    dotted = suffix(path)
    name = F.lower(base_name(path))
    return F.coalesce(F.when(dotted == ".tsx", "typescript"), language_of(path), mapped(dotted, tables.EXTRACTOR_SUFFIXES), F.when(name == ".dockerignore", "dockerfile"))


def node_type_of(path: Column) -> Column:
    """Type of the node of a file that holds no code."""
    end, name = suffix(path), F.lower(base_name(path))
    return (
        F.when(end.isin(".md", ".mdx", ".rst", ".txt"), "document")
        .when(end.isin(".json", ".jsonc", ".toml", ".yaml", ".yml", ".env"), "config")
        .when(end.isin(".gql", ".graphql", ".proto", ".sql"), "schema")
        .when(name.isin("jenkinsfile", "makefile", "dockerfile") | end.isin(".mk", ".zsh", ".bash", ".sh"), "pipeline")
        .when(end.isin(".tf", ".tfvars"), "resource")
        .otherwise("document")
    )


def layer_of(path: Column) -> Column:
    """Layer by folder names: the first group of which any path segment is a member, singular or plural."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    out = F.lit(tables.CORE_LAYER)
    for name, words in reversed(tables.LAYERS):
        known = F.array(*[F.lit(w) for word in words.split() for w in (word, word + "s")])
        out = F.when(F.arrays_overlap(parts, known), name).otherwise(out)
    return out


# text


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def _ladder(value: Column, simple: int, moderate: int) -> Column:
    return F.when(value <= simple, "simple").when(value <= moderate, "moderate").otherwise("complex")


def complexity_of_text(content: Column) -> Column:
    """By lines: up to 50 simple, up to 200 moderate."""
    return _ladder(line_count(content), 50, 200)


def complexity_of_symbols(n: Column) -> Column:
    """By functions and classes: up to 2 simple, up to 8 moderate."""
    return _ladder(n, 2, 8)


def summary_of(path: Column, content: Column) -> Column:
    return F.concat(base_name(path), F.lit(" ("), line_count(content).cast("string"), F.lit(" lines)"))


def tags_of(path: Column, services: Column | None = None, endpoints: Column | None = None, resources: Column | None = None, definitions: Column | None = None) -> Column:
    """Sorted distinct tags: language, role of the file, and what its analysis found (booleans; none if left out)."""
    end, name = suffix(path), F.lower(base_name(path))
    language = mapped(end, {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".c": "c"})
    found = [
        language,
        F.when(name.isin("makefile", "dockerfile"), "build"),
        F.when(F.contains(F.lower(path), F.lit("test")), "test"),
        F.when(end.isin(".env", ".json", ".toml", ".yml", ".yaml"), "config"),
        F.when(end.isin(".mdx", ".md"), "documentation"),
    ]
    for flag, tag in ((services, "services"), (endpoints, "api"), (resources, "infrastructure"), (definitions, "schema")):
        if flag is not None:
            found.append(F.when(flag, tag))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def concepts_of(tags: Column, summary: Column, notes: Column, extra: list[str] | None = None) -> Column:
    """Concepts of which a keyword occurs in tags, summary and notes; language concepts after the common ones."""
    text = F.lower(F.concat_ws(" ", F.array_join(F.coalesce(tags, F.array()), " "), F.coalesce(summary, F.lit("")), F.coalesce(notes, F.lit(""))))
    have = dict(tables.CONCEPTS)
    every = [*tables.CONCEPTS, *((c, (c,)) for c in dict.fromkeys(extra or []) if c not in have)]
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words]), name) for name, words in every]))


def display_name(language: Column) -> Column:
    named = mapped(language, {r["id"]: r["name"] for r in tables.LANGUAGES})
    return F.coalesce(named, F.concat(F.upper(F.substring(language, 1, 1)), F.lower(F.substring(language, 2, 1 << 30))))


def call_name(name: Column, known: Column) -> Column:
    """``name`` if it is known, else what follows its last dot if that is; else null."""
    last = F.substring_index(name, ".", -1)
    return F.when(F.array_contains(known, name), name).when((F.instr(name, ".") > 0) & F.array_contains(known, last), last)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def is_builtin(symbol: Column, language: Column) -> Column:
    """Whether the language brings the symbol; for a language without a list, whether any does."""
    lists = {}
    for lang, words in tables.BUILTINS.items():
        lists.setdefault(words, []).append(lang)
    known = reduce(lambda a, b: a | b, [F.coalesce(language.isin(*langs), F.lit(False)) & symbol.isin(*sorted(words)) for words, langs in lists.items()])
    unknown = ~F.coalesce(language.isin(*tables.BUILTINS), F.lit(False))
    return known | (unknown & symbol.isin(*sorted(frozenset().union(*lists))))


# canonical ids


def split_prefix(raw: Column) -> tuple[Column, Column]:
    """(prefix, rest) after junk segments and doubled prefixes; prefix null where there is no valid one.

    Segments are dropped from the left until one is valid and is not followed by another valid one. An empty
    segment stops the search, as does the last.
    """
    parts = F.split(raw, ":", -1)
    n = F.size(parts)
    valid = F.array(*[F.lit(p) for p in tables.PREFIX_TYPES])

    def stops(k: Column) -> Column:
        here, then = F.get(parts, k), F.get(parts, k + 1)
        doubled = (k + 1 < n - 1) & F.array_contains(valid, then)
        return (here == "") | (F.array_contains(valid, here) & ~doubled)

    found = F.when(n > 1, F.get(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), stops), F.lit(0)))
    at = F.coalesce(found, n - 1)
    prefix = F.when(found.isNotNull() & (F.get(parts, at) != ""), F.get(parts, at))
    begin = F.when(prefix.isNull(), at).otherwise(at + 1)
    return prefix, F.array_join(F.slice(parts, begin + 1, n), ":")


def canonical_id(raw: Column, kind: Column, path: Column, name: Column, flow: Column) -> Column:
    """``prefix:path`` for a node id however an unreliable producer wrote it. Idempotent.

    Functions and classes without a prefix are rebuilt from path and name, steps from path and slug, with the
    slug of their flow before it. An unknown type leaves an id without prefix as it is. Blank stays blank.
    """
    trimmed = F.trim(raw)
    kind = F.coalesce(kind, F.lit("file"))
    prefix, rest = split_prefix(trimmed)
    expected = mapped(kind, tables.ID_PREFIXES)
    has_path = F.coalesce(path != "", F.lit(False))
    parts = F.split(rest, ":", -1)
    step_flow = F.when(F.size(parts) > 1, F.nullif(F.element_at(parts, -2), F.lit("")))
    with_prefix = F.when((kind == "step") & has_path, F.concat_ws(":", prefix, step_flow, path, F.element_at(parts, -1))).otherwise(F.concat_ws(":", prefix, rest))
    slug = F.replace(F.lower(rest), F.lit(" "), F.lit("-"))
    bare = (
        F.when(kind.isin("function", "class") & has_path & F.coalesce(name != "", F.lit(False)), F.concat_ws(":", expected, path, name))
        .when((kind == "step") & has_path, F.concat_ws(":", expected, F.nullif(flow, F.lit("")), path, slug))
        .otherwise(F.concat_ws(":", expected, rest))
    )
    return F.when(trimmed == "", trimmed).when(prefix.isNotNull(), with_prefix).when(expected.isNotNull(), bare).otherwise(trimmed)


def type_of_id(raw: Column) -> Column:
    """Node type by the text before the first colon; file if that is no prefix."""
    prefix = F.when(F.instr(raw, ":") > 1, F.substring_index(raw, ":", 1))
    return F.coalesce(mapped(prefix, tables.PREFIX_TYPES), F.lit("file"))


def canonical_complexity(text: Column, number: Column | None = None) -> Column:
    """simple, moderate or complex from a word, or from a scale (1-3, 4-6, more); moderate if nothing fits."""
    word = F.lower(F.trim(text))
    named = F.when(word.isin(*tables.COMPLEXITIES), word).otherwise(mapped(word, tables.BATCH_COMPLEXITIES))
    if number is None:
        return F.coalesce(named, F.lit("moderate"))
    scale = F.when((number >= 1) & ~F.isnan(number), _ladder(number, 3, 6))
    return F.coalesce(F.when(text.isNull(), scale).otherwise(named), F.lit("moderate"))


# model replies


def json_of_reply(reply: Column, shape: str = "object") -> Column:
    """The JSON text of a reply: a fenced block, else from the first bracket to the last, else all of it, trimmed.

    ``shape`` is ``object`` or ``array``. An array is also looked for inside a fenced block, and null if missing.
    """
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    block = F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced)
    if shape == "array":
        found = F.regexp_extract(F.coalesce(block, F.trim(reply)), r"(?s)\[.*\]", 0)
        return F.nullif(found, F.lit(""))
    outer = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(block, outer, F.trim(reply))
