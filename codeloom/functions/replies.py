"""Replies of language models: typed columns out of JSON that may be fenced, wrapped in prose, or broken.

Fields of the wrong type take their default; a reply without readable JSON is null (or an empty array).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import tables
from codeloom.functions import columns as C

_EMPTY = "cast(array() as array<string>)"


def _parsed(reply: Column, shape: str = "object") -> Column:
    return F.try_parse_json(C.json_of_reply(reply, shape))


def _text(v: Column, path: str, default: Column) -> Column:
    value = F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", value).otherwise(default)


def _texts(v: Column, path: str) -> Column:
    """Strings of an array; members of other types are left out."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.expr(_EMPTY))


def _map(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "map<string, string>"), F.expr("cast(map() as map<string, string>)"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def file_analysis(reply: Column) -> Column:
    """Struct of file_summary, tags, complexity, function_summaries, class_summaries, language_notes; null if unreadable."""
    v = _parsed(reply)
    level = _text(v, "$.complexity", F.lit("moderate"))
    made = F.struct(
        _text(v, "$.fileSummary", F.lit("")).alias("file_summary"),
        _texts(v, "$.tags").alias("tags"),
        F.when(level.isin(*tables.COMPLEXITIES), level).otherwise("moderate").alias("complexity"),
        _map(v, "$.functionSummaries").alias("function_summaries"),
        _map(v, "$.classSummaries").alias("class_summaries"),
        _text(v, "$.languageNotes", F.lit(None).cast("string")).alias("language_notes"),
    )
    return F.when(_is(v, "OBJECT"), made)


def _layers(items: Column) -> Column:
    named = F.filter(items, lambda x: _is(x, "OBJECT") & (F.schema_of_variant(F.try_variant_get(x, "$.name", "variant")) == "STRING"))
    return F.transform(named, lambda x: F.struct(F.try_variant_get(x, "$.name", "string").alias("name"), _text(x, "$.description", F.lit("")).alias("description"), _texts(x, "$.filePatterns").alias("file_patterns")))


def project_summary(reply: Column) -> Column:
    """Struct of description, frameworks, layers; null if unreadable."""
    v = _parsed(reply)
    made = F.struct(
        _text(v, "$.description", F.lit("")).alias("description"),
        _texts(v, "$.frameworks").alias("frameworks"),
        F.coalesce(_layers(F.try_variant_get(v, "$.layers", "array<variant>")), F.expr("cast(array() as array<struct<name: string, description: string, file_patterns: array<string>>>)")).alias("layers"),
    )
    return F.when(_is(v, "OBJECT"), made)


def layer_list(reply: Column) -> Column:
    """Array of (name, description, file_patterns); null if there is no layer in the reply."""
    found = _layers(F.try_variant_get(_parsed(reply, "array"), "$", "array<variant>"))
    return F.when(F.size(found) > 0, found)


def tour_steps(reply: Column) -> Column:
    """Array of (order, title, description, node_ids, language_lesson); incomplete steps are left out."""
    items = F.try_variant_get(_parsed(reply), "$.steps", "array<variant>")

    def whole(x: Column) -> Column:
        texts = [_text(x, f"$.{k}", F.lit("")) != "" for k in ("title", "description")]
        number = F.try_variant_get(x, "$.order", "double").isNotNull() & (F.schema_of_variant(F.try_variant_get(x, "$.order", "variant")) != "STRING")
        return _is(x, "OBJECT") & number & texts[0] & texts[1] & F.coalesce(F.size(F.try_variant_get(x, "$.nodeIds", "array<variant>")) > 0, F.lit(False))

    made = F.transform(F.filter(items, whole), lambda x: F.struct(F.try_variant_get(x, "$.order", "double").cast("int").alias("order"), F.try_variant_get(x, "$.title", "string").alias("title"), F.try_variant_get(x, "$.description", "string").alias("description"), _texts(x, "$.nodeIds").alias("node_ids"), _text(x, "$.languageLesson", F.lit(None).cast("string")).alias("language_lesson")))
    return F.coalesce(made, F.expr("cast(array() as array<struct<order: int, title: string, description: string, node_ids: array<string>, language_lesson: string>>)"))


def language_lesson(reply: Column) -> Column:
    """Struct of language_notes and concepts (name, explanation); empty ones if unreadable."""
    v = _parsed(reply)
    items = F.try_variant_get(v, "$.concepts", "array<variant>")

    def whole(x: Column) -> Column:
        return _is(x, "OBJECT") & _text(x, "$.name", F.lit(None).cast("string")).isNotNull() & _text(x, "$.explanation", F.lit(None).cast("string")).isNotNull()

    concepts = F.transform(F.filter(items, whole), lambda x: F.struct(F.try_variant_get(x, "$.name", "string").alias("name"), F.try_variant_get(x, "$.explanation", "string").alias("explanation")))
    return F.struct(F.coalesce(_text(v, "$.languageNotes", F.lit("")), F.lit("")).alias("language_notes"), F.coalesce(concepts, F.expr("cast(array() as array<struct<name: string, explanation: string>>)")).alias("concepts"))


# prompts: text alone, no model is ever called


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def file_prompt(path: Column, content: Column, context: Column) -> Column:
    """What to ask about one file."""
    return _lines("Describe this source file for a graph of the project.", F.concat(F.lit("Project: "), context), F.concat(F.lit("File: "), path), "```", content, "```", "Reply with a JSON object: fileSummary, tags, complexity (simple, moderate or complex), functionSummaries, classSummaries, languageNotes.")


def project_prompt(paths: Column, samples: Column) -> Column:
    """What to ask about a project, by its paths and some files as text (arrays)."""
    return _lines("Describe this project.", "Files:", F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), p)), "\n"), "Samples:", F.array_join(samples, "\n\n"), "Reply with a JSON object: description, frameworks, layers (name, description, filePatterns).")


def layer_prompt(paths: Column) -> Column:
    return _lines("Group these files into architecture layers.", F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), p)), "\n"), "Reply with a JSON array of objects: name, description, filePatterns.")


def tour_prompt(nodes: Column, edges: Column, layers: Column, most: int = 50) -> Column:
    """By nodes, edges (the first ``most``) and layers as text (arrays)."""
    return _lines("Plan a guided tour of this project.", "Nodes:", F.array_join(nodes, "\n"), "Edges:", F.array_join(F.slice(edges, 1, most), "\n"), "Layers:", F.array_join(layers, "\n"), "Reply with a JSON object: steps (order, title, description, nodeIds, languageLesson).")


def lesson_prompt(name: Column, summary: Column, language: Column, relations: Column, concepts: Column) -> Column:
    return _lines(F.concat(F.lit("Explain what "), C.display_name(language), F.lit(" brings to this part of a project.")), F.concat(F.lit("Part: "), name, F.lit(" — "), summary), "Relations:", F.array_join(relations, "\n"), F.concat(F.lit("Concepts: "), F.array_join(concepts, ", ")), "Reply with a JSON object: languageNotes, concepts (name, explanation).")
