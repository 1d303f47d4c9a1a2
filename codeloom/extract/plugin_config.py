"""Configuration of plugins as JSON: which plugin is on, for which languages, with what options."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from codeloom.extract import registry


@dataclass
class Entry:
    """One plugin; ``options`` are its own."""

    name: str
    languages: list[str]
    enabled: bool = True
    options: dict | None = None


@dataclass
class Config:
    plugins: list[Entry] = field(default_factory=list)


def default() -> Config:
    """Every parser that is built in, switched on; a new object each time."""
    return Config([Entry(name, list(languages)) for name, languages, _ in registry.default_registry().entries])


def _entry(raw: object) -> Entry | None:
    if not isinstance(raw, dict) or not isinstance(raw.get("name"), str) or not isinstance(raw.get("languages"), list):
        return None
    languages = [x for x in raw["languages"] if isinstance(x, str) and x]
    if not raw["name"] or not languages:
        return None
    on, options = raw.get("enabled"), raw.get("options")
    return Entry(raw["name"], languages, on if isinstance(on, bool) else True, options if isinstance(options, dict) else None)


def parse(text: str) -> Config:
    """Entries without a name or languages are left out; what is no configuration at all gives the default one."""
    try:
        raw = json.loads(text)
    except ValueError:
        return default()
    if not isinstance(raw, dict) or not isinstance(raw.get("plugins"), list):
        return default()
    return Config([e for e in map(_entry, raw["plugins"]) if e])


def serialize(config: Config) -> str:
    rows = [{"name": e.name, "enabled": e.enabled, "languages": e.languages} | ({} if e.options is None else {"options": e.options}) for e in config.plugins]
    return json.dumps({"plugins": rows}, indent=2, ensure_ascii=False)


def applied(config: Config, known: registry.Registry | None = None) -> registry.Registry:
    """The plugins of ``known`` (the default ones) that the configuration has switched on, for its languages alone."""
    wanted = {e.name: e.languages for e in config.plugins if e.enabled}
    made = registry.Registry()
    for name, languages, run in (known or registry.default_registry()).entries:
        mine = tuple(x for x in languages if x in wanted.get(name, ()))
        if mine:
            made.register(name, mine, run)
    return made
