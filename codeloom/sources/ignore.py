"""Ignore rules in gitignore syntax: ordered patterns, of which the last that matches decides."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import tables

OWN_FILE = ".codeloomignore"


def lines_of(text: str) -> list[str]:
    """Rules of an ignore file: no blank lines, no comments."""
    return [line for raw in text.splitlines() if (line := raw.strip()) and not line.startswith("#")]


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def regex_of(rule: str) -> tuple[str, bool] | None:
    """(regular expression for whole relative paths of files, whether it takes back); None for a rule that says nothing."""
    back = rule.startswith("!")
    body = rule[1:] if back else rule
    folder = body.endswith("/")
    body = body.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    core = _glob(body.lstrip("/"))
    head = "" if anchored else "(?:.*/)?"
    return head + core + ("/.*" if folder else "(?:/.*)?"), back


def spec(*groups: list[str], defaults: bool = True) -> list[tuple[str, bool]]:
    """All rules in order: the built-in ones, then those of each group."""
    rules = [*(tables.DEFAULT_IGNORES if defaults else ()), *(r for g in groups for r in g)]
    return [r for r in map(regex_of, rules) if r]


def load_spec(root: str | Path, gitignore: bool = True, own: bool = True) -> list[tuple[str, bool]]:
    """Built-in rules, the project's gitignore, the engine's internal file, the project's own file; the last wins."""
    root = Path(root)
    names = ([".gitignore"] if gitignore else []) + [f".codeloom/{OWN_FILE}"] + ([OWN_FILE] if own else [])
    return spec(*[lines_of((root / n).read_text()) for n in names if (root / n).is_file()])


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it. Runs of rules that say the same are one expression."""
    runs: list[tuple[list[str], bool]] = []
    for pattern, back in rules:
        if runs and runs[-1][1] == back:
            runs[-1][0].append(pattern)
        else:
            runs.append(([pattern], back))
    out = F.lit(False)
    for patterns, back in runs:
        out = F.when(path.rlike("^(?:" + "|".join(patterns) + ")$"), F.lit(not back)).otherwise(out)
    return out


def keep(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    return files.where(~ignored(F.col("path"), rules))


def suggested_rules(languages: list[str] = (), frameworks: list[str] = (), large_files: list[str] = ()) -> list[str]:
    """Sorted rules for the output of the given languages and frameworks, and for some large files."""
    found = [r for name in languages for r in tables.LANGUAGE_IGNORES.get(name.lower(), "").split()]
    found += [r for name in frameworks for r in tables.FRAMEWORK_IGNORES.get(name.lower(), "").split()]
    return sorted({*found, *large_files})


def write_ignore_file(root: str | Path, name: str | None = None, overwrite: bool = False, **what: list[str]) -> Path:
    """Write the suggested rules to the project's own file, unless there is one."""
    target = Path(root) / OWN_FILE
    if overwrite or not target.exists():
        head = ["# Files that the graph leaves out, beyond those that git ignores.", "# One gitignore rule a line; a leading ! takes back.", *([f"# Project: {name}"] if name else []), ""]
        target.write_text("\n".join([*head, *suggested_rules(**what), ""]))
    return target


def starter_text(root: str | Path, name: str | None = None) -> str:
    """Commented suggestions: git's rules that are not built in, usual folders that are there, test files."""
    root = Path(root)
    built_in = {d.rstrip("/") for d in tables.DEFAULT_IGNORES}
    rules = lines_of((root / ".gitignore").read_text()) if (root / ".gitignore").is_file() else []
    own = [r for r in rules if r.rstrip("/") not in built_in]
    folders = [f"{d}/" for d in tables.SUGGESTED_DIRS if (root / d).is_dir()]
    out = ["# Suggestions; remove the leading # of a line to use it.", *([f"# Project: {name}"] if name else []), ""]
    for title, found in (("From .gitignore", own), ("Detected directories", folders), ("Test file patterns", tables.SUGGESTED_FILES)):
        if found:
            out += [f"# --- {title} (uncomment to exclude) ---", *(f"# {r}" for r in found), ""]
    return "\n".join(out)
