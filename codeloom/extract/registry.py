"""Which parser gets which file, and the one pass over all files that runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom import schemas
from codeloom.extract import braces, config_files, python_source
from codeloom.functions import columns as C

Parser = Callable[[str], dict]


class Registry:
    """Plugins: a name, languages, and a function from text to lists of records. The last one of a language has it."""

    def __init__(self) -> None:
        self._plugins: list[tuple[str, tuple[str, ...], Parser]] = []
        self._suffixes: dict[str, str] = {}
        self._names: dict[str, str] = {}

    def register(self, name: str, languages: tuple[str, ...], parse: Parser) -> None:
        self._plugins.append((name, tuple(languages), parse))

    def register_extractor(self, language: str, parse: Parser, extensions: tuple[str, ...] = (), filenames: tuple[str, ...] = ()) -> None:
        """A parser for a language, new or known, and the files that are of it; these go before the built-in ones."""
        self.register(f"extractor:{language}", (language,), parse)
        self._suffixes |= {e.lower() if e.startswith(".") else f".{e.lower()}": language for e in extensions}
        self._names |= {n.lower(): language for n in filenames}

    def language_of(self, path: Column) -> Column:
        """The language of a file: own file names, own suffixes, then the built-in rules."""
        name = F.lower(C.base_name(path))
        out = C.parser_language_of(path)
        for suffix, language in self._suffixes.items():
            out = F.when(F.endswith(name, F.lit(suffix)), language).otherwise(out)
        for full, language in self._names.items():
            out = F.when(name == full, language).otherwise(out)
        return out

    def unregister(self, name: str) -> None:
        self._plugins = [p for p in self._plugins if p[0] != name]

    @property
    def entries(self) -> list[tuple[str, tuple[str, ...], Parser]]:
        return list(self._plugins)

    @property
    def plugins(self) -> list[str]:
        return [p[0] for p in self._plugins]

    @property
    def languages(self) -> list[str]:
        return list(self.parsers())

    def parsers(self) -> dict[str, Parser]:
        return {lang: parse for _, languages, parse in self._plugins for lang in languages}


def default_registry() -> Registry:
    made = Registry()
    for source in (config_files.PARSERS, {"python": python_source.python}, braces.PARSERS):
        for parse in dict.fromkeys(source.values()):
            made.register(parse.__name__, tuple(k for k, v in source.items() if v is parse), parse)
    return made


_SCHEMA = to_arrow_schema(schemas.ANALYSIS)
_LISTS = [f.name for f in _SCHEMA if f.name not in ("file_path", "language")]


def _filled(kind: pa.DataType, value):
    """``value`` (lists, records, scalars) with every field that the type has; nothing where it says nothing."""
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_filled(kind.value_type, v) for v in value or ()]
    if pa.types.is_struct(kind):
        return {f.name: _filled(f.type, value.get(f.name)) for f in kind}
    return value


def analyze(files: DataFrame, registry: Registry | None = None, lists: tuple[str, ...] | None = None) -> DataFrame:
    """One row of ``schemas.ANALYSIS`` for each file (``path, content``) whose language has a parser; the rest is left out.

    Every text is parsed once, in one Arrow pass without a shuffle. Null content (binary) gives no row. Whoever reads
    some ``lists`` alone names them: the others stay empty and are not sent.
    """
    registry = registry or default_registry()
    parsers = registry.parsers()
    known = files.select("path", "content", registry.language_of(F.col("path")).alias("language")).where(F.col("language").isin(*parsers) & F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                paths, texts, languages = (part.column(c).to_pylist() for c in ("path", "content", "language"))
                found = [parsers[lang](text) for lang, text in zip(languages, texts)]
                columns = [pa.array(paths, pa.string()), pa.array(languages, pa.string())]
                columns += [pa.array([_filled(_SCHEMA.field(k).type, f.get(k)) if lists is None or k in lists else [] for f in found], _SCHEMA.field(k).type) for k in _LISTS]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return known.mapInArrow(run, schemas.ANALYSIS)
