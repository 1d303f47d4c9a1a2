"""Structure of configuration, schema and build files. Each function takes the text and returns lists of records."""

from __future__ import annotations

import json
import re

import yaml


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _spans(found: list[dict], n_lines: int) -> list[dict]:
    """Each section ends before the next one, the last at the end of the text."""
    for one, then in zip(found, [*found[1:], None]):
        one["line_end"] = then["line_start"] - 1 if then else n_lines
    return found


def _section(name: str, level: int, line: int) -> dict:
    return {"name": name, "level": level, "line_start": line, "line_end": line}


def closing(text: str, opened: int) -> int:
    """Place of the brace that closes the first one from ``opened`` on; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, opened):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def _block_end(text: str, begin: int) -> int:
    """Line of the brace that closes the block begun at ``begin``."""
    return text.count("\n", 0, closing(text, begin) + 1) + 1


def markdown(text: str) -> dict:
    """Headings outside code fences, and links to local files and images."""
    found, fence = [], None
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        if line.startswith(("```", "~~~")):
            fence = line[0] if fence is None else None if line[0] == fence else fence
        elif fence is None and (m := re.match(r"(#{1,6})\s+(.+)", line)):
            found.append(_section(m[2].strip(), len(m[1]), i))
    refs = []
    for m in re.finditer(r"(!?)\[[^]]*\]\((?!http)([^)]+)\)", text):
        refs.append({"target": m[2], "kind": "image" if m[1] else "file", "line": _line(text, m.start())})
    return {"sections": _spans(found, len(lines)), "refs": refs}


def toml(text: str) -> dict:
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        if m := re.match(r"\s*\[(?P<array>\[)?(?P<name>[^]]+)\]", line):
            name = m["name"].strip()
            found.append(_section(f"[[{name}]]" if m["array"] else name, name.count(".") + 1, i))
    return {"sections": _spans(found, len(lines))}


def env(text: str) -> dict:
    found = []
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"([^\W\d]\w*)=", line.strip(), re.ASCII):
            found.append({"name": m[1], "kind": "variable", "line_start": i, "line_end": i, "fields": []})
    return {"definitions": found}


_STEPS = frozenset("from run copy add workdir cmd entrypoint env arg expose volume user healthcheck".split())


def dockerfile(text: str) -> dict:
    """Build stages with their image and ports, and instructions as steps."""
    lines = text.split("\n")
    stages, steps = [], []
    for i, line in enumerate(lines, 1):
        m = re.match(r"([A-Za-z]+)\s", line)
        word = m[1].lower() if m else ""
        if word in _STEPS:
            steps.append({"name": f"{word.upper()} {line[m.end():].strip()[:60]}".strip(), "line_start": i, "line_end": i})
        if word == "from" and (rest := line[m.end() :].split()):
            if stages:
                stages[-1]["line_end"] = i - 1
            alias = rest[2] if len(rest) > 2 and rest[1].lower() == "as" else None
            stages.append({"name": alias or rest[0].split(":")[0].split("/")[-1], "image": rest[0], "ports": [], "line_start": i, "line_end": len(lines)})
        elif word == "expose" and stages:
            stages[-1]["ports"] += [int(p) for p in line[m.end() :].split() if re.fullmatch(r"[+-]?\d+", p)]
    return {"services": stages, "steps": steps}


_QUOTE = '[`"]?'
_SQL = (
    ("table", re.compile(rf"create\s+table\s+(?:if\s+not\s+exists\s+)?{_QUOTE}(\w+)", re.I)),
    ("view", re.compile(rf"create\s+(?:or\s+replace\s+)?view\s+{_QUOTE}(\w+)", re.I)),
    ("index", re.compile(rf"create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?{_QUOTE}(\w+)", re.I)),
)
_CONSTRAINTS = frozenset("primary foreign unique check constraint index key".split())


def _columns(body: str) -> list[str]:
    out = []
    for part in body.split(","):
        m = re.match(rf"{_QUOTE}(\w+){_QUOTE}\s+", part.strip())
        if m and not (m[1].lower() in _CONSTRAINTS and part.strip()[0] not in "`\""):
            out.append(m[1])
    return out


def sql(text: str) -> dict:
    """Tables with their columns, views and indexes."""
    found = []
    for kind, pattern in _SQL:
        for m in pattern.finditer(text):
            start = end = _line(text, m.start())
            fields = []
            if kind == "table":
                stop = text.find(");", m.start())
                end = start + 5 if stop < 0 else _line(text, stop + 2)
                opened = text.find("(", m.start())
                shut = text.find(");", opened) if opened >= 0 else -1
                fields = _columns(text[opened + 1 : shut]) if shut >= 0 else []
            found.append({"name": m[1], "kind": kind, "line_start": start, "line_end": end, "fields": fields})
    return {"definitions": found}


_ROOTS = ("Query", "Mutation", "Subscription")


def _first_words(body: str) -> list[tuple[int, str]]:
    return [(i, m[0]) for i, line in enumerate(body.split("\n")) if (m := re.match(r"\w+", line.strip()))]


def graphql(text: str) -> dict:
    """Types and their like with fields; fields of the root types are endpoints."""
    definitions, endpoints = [], []
    for m in re.finditer(r"^(type|input|enum|interface|union|scalar)\s+(\w+)", text, re.M):
        opened = text.find("{", m.start())
        shut = closing(text, opened) if opened >= 0 else -1
        if m[2] in _ROOTS:
            if m[1] == "type" and opened >= 0 and not text[m.end() : opened].strip():
                first = _line(text, opened + 1)
                endpoints += [{"method": m[2], "path": w, "line_start": first + i, "line_end": first + i} for i, w in _first_words(text[opened + 1 : shut])]
            continue
        begin, brace = _line(text, m.start()), text.find("}", m.start())
        fields = [w for _, w in _first_words(text[opened + 1 : shut])] if opened >= 0 else []
        definitions.append({"name": m[2], "kind": m[1], "line_start": begin, "line_end": _line(text, brace + 1) if brace >= 0 else begin, "fields": fields})
    return {"definitions": definitions, "endpoints": endpoints}


_PROTO_FIELD = re.compile(r"^[ \t]*(?:(?:repeated|optional|required)\s+)?(?:map<[^>]+>|\w+)\s+(\w+)\s*=", re.M)


def protobuf(text: str) -> dict:
    """Messages and enums at the top with their members; methods of services are endpoints."""
    definitions, endpoints = [], []
    for kind in ("message", "enum"):
        for m in re.finditer(rf"^{kind}\s+(\w+)\s*\{{", text, re.M):
            body = text[m.end() : closing(text, m.start())]
            fields = _PROTO_FIELD.findall(body) if kind == "message" else re.findall(r"^\s*(\w+)\s*=", body, re.M)
            definitions.append({"name": m[1], "kind": kind, "line_start": _line(text, m.start()), "line_end": _block_end(text, m.start()), "fields": fields})
    for m in re.finditer(r"^service\s+(\w+)\s*\{", text, re.M):
        for r in re.compile(r"rpc\s+(\w+)\s*\(").finditer(text, m.end(), closing(text, m.start())):
            line = _line(text, r.start())
            endpoints.append({"method": "rpc", "path": f"{m[1]}.{r[1]}", "line_start": line, "line_end": line})
    return {"definitions": definitions, "endpoints": endpoints}


def terraform(text: str) -> dict:
    """Resources, data sources and modules; variables and outputs as definitions."""
    resources, definitions = [], []
    for word, labels in (("resource", 2), ("data", 2), ("module", 1), ("variable", 1), ("output", 1)):
        label = r'\s+"([^"]+)"'
        for m in re.finditer(rf"^{word}{label * labels}\s*\{{", text, re.M):
            span = {"line_start": _line(text, m.start()), "line_end": _block_end(text, m.start())}
            names = m.groups()
            if word in ("variable", "output"):
                definitions.append({"name": names[0], "kind": word, "fields": [], **span})
            else:
                prefix = "" if word == "resource" else f"{word}."
                kind = "module" if word == "module" else prefix + names[0]
                resources.append({"name": prefix + ".".join(names), "kind": kind, **span})
    return {"resources": resources, "definitions": definitions}


def makefile(text: str) -> dict:
    """Targets with their recipes; no names that begin with a dot, no assignments."""
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines):
        m = re.match(r"([A-Za-z_][\w.-]*)(?:\s.*)?:", line, re.ASCII)
        if m and ":=" not in line and "?=" not in line:
            end = i + 1
            while end < len(lines) and (not lines[end] or lines[end][0] == "\t" or lines[end].startswith("  ")):
                end += 1
            found.append({"name": m[1], "line_start": i + 1, "line_end": end})
    return {"steps": found}


def shell(text: str) -> dict:
    """Functions of either style, and sourced files."""
    lines, functions, refs = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if r := re.match(r"\s*(?:source|\.)[ \t]+[\"']?([^\"'\s]+)", line):
            refs.append({"target": r[1], "kind": "file", "line": i + 1})
        m = re.match(r"(?:function\s+)?(\w+)\s*\(\s*\)", line) or re.match(r"function\s+(\w+)", line)
        if not m:
            continue
        after = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
        begin = i if "{" in line else after if after is not None and lines[after].strip().startswith("{") else None
        if begin is None:
            continue
        depth, end = 0, begin
        for k in range(begin, len(lines)):
            depth += lines[k].count("{") - lines[k].count("}")
            if not depth:
                end = k
                break
        functions.append({"name": m[1], "line_start": i + 1, "line_end": end + 1, "params": [], "return_type": None})
    return {"functions": functions, "refs": refs}


def yaml_file(text: str) -> dict:
    """Top-level keys; items of a top-level list by their name, id or kind. Keys by lines where YAML cannot be read."""
    lines = text.split("\n")
    try:
        doc = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except Exception:  # whatever a broken text makes the parser raise: read it by lines
        keys = [(m[1], i) for i, line in enumerate(lines, 1) if (m := re.match(r"(\w[\w-]*)\s*:", line))]
        return {"sections": _spans([_section(k, 1, i) for k, i in keys], len(lines))}
    if isinstance(doc, dict):
        found = []
        for key in map(str, doc):
            pattern = re.compile(rf"[\"']?{re.escape(key)}[\"']?\s*:")
            at = next((i for i, line in enumerate(lines, 1) if pattern.match(line)), None)
            if at:
                found.append(_section(key, 1, at))
        return {"sections": _spans(found, len(lines))}
    if isinstance(doc, list):
        names = []
        for i, item in enumerate(doc):
            given = [item.get(k) for k in ("name", "id", "kind")] if isinstance(item, dict) else []
            names.append(next((g for g in given if isinstance(g, str)), f"[{i}]"))
        return {"sections": [{"name": n, "level": 1, "line_start": 1, "line_end": len(lines)} for n in names]}
    return {}


_JSONC = re.compile(r'("(?:\\.|[^"\\])*(?:"|$))|//[^\n]*|/\*.*?(?:\*/|$)', re.S)


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are.

    Trailing commas are looked for in the text as a whole, inside strings too.
    """
    return re.sub(r",(\s*[\]}])", r"\1", _JSONC.sub(lambda m: m[1] or "", text))


def json_file(text: str) -> dict:
    """Top-level keys and references to other schemas; no sections where the text is no JSON object."""
    refs = []
    for m in re.finditer(r'"\$ref"\s*:\s*"([^#"][^"]*)"', text):
        refs.append({"target": m[1], "kind": "schema", "line": _line(text, m.start())})
    try:
        doc = json.loads(strip_jsonc(text))
    except ValueError:
        return {"refs": refs}
    if not isinstance(doc, dict):
        return {"refs": refs}
    lines, found = text.split("\n"), []
    for key in doc:
        wanted = json.dumps(key)
        at = next((i for i, line in enumerate(lines, 1) if wanted in line), None)
        if at:
            found.append(_section(key, 1, at))
    return {"sections": _spans(found, len(lines)), "refs": refs}


#: Language -> parser. Where two claim a language the later registration has it.
PARSERS = {
    "markdown": markdown,
    **dict.fromkeys(("yaml", "kubernetes", "docker-compose", "github-actions"), yaml_file),
    **dict.fromkeys(("json", "jsonc", "json-schema", "openapi"), json_file),
    "toml": toml,
    "env": env,
    "dockerfile": dockerfile,
    "sql": sql,
    "graphql": graphql,
    "protobuf": protobuf,
    "terraform": terraform,
    "makefile": makefile,
    **dict.fromkeys(("shell", "jenkinsfile"), shell),
}
