"""Structure of TypeScript, JavaScript, Java and C++ sources, by scanning text whose strings and comments are blanked.

A scanner of this kind reads declarations, not expressions: what macros or generated tokens make is not seen.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_NO_CALLS = frozenset("if for while switch catch return function new throw typeof sizeof await super assert synchronized else do case delete void".split())
_CALL = re.compile(r"(new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,<>.\[\]?]*>)?\s*\(")


class Text:
    """A source with its lines, and the same text with strings and comments turned to blanks."""

    def __init__(self, raw: str, keep_strings: bool = False) -> None:
        self.raw = raw
        self.bare = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), raw)
        self.starts = [0, *(m.end() for m in re.finditer("\n", raw))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def close(self, opened: int) -> int:
        """Place of the bracket that closes the one at ``opened``; the end if none does."""
        a = self.bare[opened]
        b = {"{": "}", "(": ")", "<": ">"}[a]
        depth = 0
        for m in re.compile(f"[{re.escape(a + b)}]").finditer(self.bare, opened):
            depth += 1 if m[0] == a else -1
            if not depth:
                return m.start()
        return len(self.bare) - 1

    def depths(self, begin: int, end: int) -> list[int]:
        """Depth of braces before each character of a stretch."""
        out, depth = [], 0
        for c in self.bare[begin:end]:
            out.append(depth)
            depth += (c == "{") - (c == "}")
        return out


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _names(text: str | None) -> list[str]:
    return [re.sub(r"<.*", "", x, flags=re.S).strip() for x in _split(text or "")]


def _calls(src: Text, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Calls inside the given bodies; the innermost body's name is the caller."""
    out = []
    for m in _CALL.finditer(src.bare):
        inside = [s for s in spans if s[0] <= m.start() < s[1]]
        if inside and m[2] not in _NO_CALLS:
            name = m[2] if not m[1] else f"new {m[2]}"
            out.append({"caller": max(inside)[2], "callee": name, "line": src.line(m.start())})
    return out


def _record(src: Text, name: str, begin: int, end: int, **more) -> dict:
    return {"name": name, "line_start": src.line(begin), "line_end": src.line(end), **more}


# TypeScript and JavaScript

_TS_TYPE = r"(?:\s*:\s*(?P<ret>[^={;]+?))?"
_TS_FUNCTION = re.compile(rf"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(]*>)?\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\){_TS_TYPE}\s*\{{")
_TS_ARROW = re.compile(rf"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?\((?P<params>[^()]*)\){_TS_TYPE}\s*=>\s*(?P<brace>\{{)?")
_TS_CLASS = re.compile(r"\bclass\s+(?P<name>[\w$]+)\s*(?:<[^{]*?>)?\s*(?:extends\s+(?P<ext>[\w$.]+)(?:<[^{]*?>)?)?\s*(?:implements\s+(?P<imp>[^{]+?))?\s*\{")
_TS_METHOD = re.compile(rf"(?:^|[;}}\n])[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?P<name>[\w$#]+)\s*(?:<[^(]*>)?\((?P<params>[^()]*)\){_TS_TYPE}\s*\{{")
_TS_FIELD = re.compile(r"(?:^|[;}\n])[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*(?P<name>[\w$#]+)[?!]?\s*(?::[^;={(\n]+)?(?:=[^;\n]*)?;")
_TS_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?:(?P<what>[^;'\"]+?)\s+from\s+)?['\"](?P<source>[^'\"]+)['\"]", re.M)
_TS_EXPORT = re.compile(r"\bexport\s+(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?:function\s*\*?|class|interface|enum|type|const\s+enum|const|let|var)\s+)?(?P<name>[\w$]+)")


def _ts_params(text: str) -> list[str]:
    out = []
    for p in _split(text):
        m = re.match(r"(?:(?:public|private|protected|readonly)\s+)*(\.\.\.)?([\w$]+)", p)
        if m and m[2] != "this":
            out.append((m[1] or "") + m[2])
    return out


def typescript(text: str) -> dict:
    src = Text(text)
    functions, spans = [], []
    for m in _TS_FUNCTION.finditer(src.bare):
        end = src.close(m.end() - 1)
        functions.append(_record(src, m["name"], m.start(), end, params=_ts_params(m["params"]), return_type=m["ret"] and m["ret"].strip()))
        spans.append((m.end(), end, m["name"]))
    for m in _TS_ARROW.finditer(src.bare):
        end = src.close(m.end() - 1) if m["brace"] else (src.bare.find("\n", m.end()) if "\n" in src.bare[m.end() :] else len(text) - 1)
        functions.append(_record(src, m["name"], m.start(), end, params=_ts_params(m["params"]), return_type=m["ret"] and m["ret"].strip()))
        spans.append((m.end(), end, m["name"]))
    functions.sort(key=lambda f: f["line_start"])
    classes = []
    for m in _TS_CLASS.finditer(src.bare):
        end = src.close(m.end() - 1)
        depth = src.depths(m.end(), end)
        methods, fields = [], []
        for x in _TS_METHOD.finditer(src.bare, m.end() - 1, end):
            at = x.start("name") - m.end()
            if depth[at] == 0 and x["name"] not in _NO_CALLS:
                stop = src.close(x.end() - 1)
                methods.append(_record(src, x["name"], x.start("name"), stop, params=_ts_params(x["params"]), return_type=x["ret"] and x["ret"].strip()))
                spans.append((x.end(), stop, x["name"]))
        for x in _TS_FIELD.finditer(src.bare, m.end() - 1, end):
            if depth[x.start("name") - m.end()] == 0 and x["name"] not in ("return", "constructor"):
                fields.append(x["name"])
        classes.append(_record(src, m["name"], m.start(), end, methods=methods, properties=fields, extends=[m["ext"]] if m["ext"] else [], implements=_names(m["imp"])))
    interfaces = []
    for m in re.finditer(r"\binterface\s+(?P<name>[\w$]+)\s*(?:<[^{]*?>)?\s*(?:extends\s+(?P<ext>[^{]+?))?\s*\{", src.bare):
        end = src.close(m.end() - 1)
        body, methods, fields = src.bare[m.end() : end], [], []
        for x in re.finditer(r"(?:^|[;\n,{])\s*(?:readonly\s+)?(?P<name>[\w$]+)\??\s*(?:<[^(]*>)?(?:\((?P<params>[^()]*)\))?\s*:\s*(?P<ret>[^;,\n]+)", body):
            if x["params"] is None:
                fields.append(x["name"])
            else:
                methods.append(_record(src, x["name"], m.end() + x.start("name"), m.end() + x.end() - 1, params=_ts_params(x["params"]), return_type=x["ret"].strip()))
        interfaces.append(_record(src, m["name"], m.start(), end, methods=methods, properties=fields, extends=_names(m["ext"])))
    enums = []
    for m in re.finditer(r"\benum\s+([\w$]+)\s*\{", src.bare):
        end = src.close(m.end() - 1)
        enums.append(_record(src, m[1], m.start(), end, values=[re.split(r"[\s=]", v)[0] for v in _split(src.bare[m.end() : end])], methods=[]))
    aliases = [_record(src, m[1], m.start(), m.end() - 1) for m in re.finditer(r"^[ \t]*(?:export\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=[^;\n]*;?", src.bare, re.M)]
    arrows = {f["name"] for f in functions}
    variables = []
    for m in re.finditer(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::\s*([^=;\n]+?))?\s*(?:=|;|$)", src.bare, re.M):
        if m[1] not in arrows:
            variables.append(_record(src, m[1], m.start(), m.end() - 1, type_annotation=m[2]))
    imports = []
    for m in _TS_IMPORT.finditer(text):
        if not src.bare[m.start() : m.end()].strip().startswith("import"):
            continue
        what, names = m["what"] or "", []
        if star := re.search(r"\*\s+as\s+([\w$]+)", what):
            names.append(f"* as {star[1]}")
        elif head := re.match(r"[\w$]+", what):
            names.append(head[0])
        if braces := re.search(r"\{([^}]*)\}", what):
            names += [x.split()[-1] for x in _split(braces[1])]
        imports.append({"source": m["source"], "specifiers": names, "line": src.line(m.start("source"))})
    exports = []
    for m in _TS_EXPORT.finditer(src.bare):
        exports.append({"name": m["name"] if m["name"] not in ("function", "class") else "default", "line": src.line(m.start()), "is_default": bool(m["default"])})
    return {"functions": functions, "classes": classes, "interfaces": interfaces, "enums": enums, "type_aliases": aliases, "variables": variables, "imports": imports, "exports": exports, "calls": _calls(src, spans)}


# Java

_MODIFIERS = r"(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*)"
_JAVA_TYPE = re.compile(rf"{_MODIFIERS}(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)\s*(?:<[^{{]*?>)?\s*(?:\([^)]*\)\s*)?(?P<heritage>[^{{;]*)\{{")
_JAVA_METHOD = re.compile(rf"{_MODIFIERS}(?:<[^>]+>\s*)?(?:(?P<ret>[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+)?(?P<name>\w+)\s*\((?P<params>[^()]*)\)\s*(?:throws\s+[\w.,\s]+)?(?P<body>[{{;])")
_JAVA_FIELD = re.compile(rf"{_MODIFIERS}(?P<type>[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?:=[^;]*)?;")


def _typed_params(text: str) -> list[str]:
    return [m[0] for p in _split(text) if (m := re.search(r"\w+(?=\s*(?:\[\s*\])*\s*(?:=.*)?$)", p))]


def java(text: str, supertypes: bool = False) -> dict:
    """``supertypes`` adds extends and implements of classes, which are left out otherwise."""
    src = Text(text)
    out: dict[str, list] = {k: [] for k in ("functions", "classes", "interfaces", "enums", "imports", "exports")}
    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", src.bare, re.M):
        out["imports"].append({"source": m[1], "specifiers": ["*" if m[2] else m[1].rsplit(".", 1)[-1]], "line": src.line(m.start(1))})
    top = src.depths(0, len(src.bare))
    for m in _JAVA_TYPE.finditer(src.bare):
        if top[m.start("kind")]:
            continue
        end = src.close(m.end() - 1)
        depth = src.depths(m.end(), end)
        body_at, values = m.end(), []
        if m["kind"] == "enum":
            stop = next((i for i, d in enumerate(depth) if d == 0 and src.bare[m.end() + i] == ";"), len(depth))
            values = [v[0] for x in _split(src.bare[m.end() : m.end() + stop]) if (v := re.match(r"\w+", x))]
            body_at = m.end() + stop
        methods, fields = [], []
        taken = []
        for x in _JAVA_METHOD.finditer(src.bare, body_at, end):
            if depth[x.start("name") - m.end()] or x["name"] in _NO_CALLS or x["ret"] in ("return", "new", "throw", "else") or (not x["ret"] and x["name"] != m["name"]):
                continue
            stop = src.close(x.end() - 1) if x["body"] == "{" else x.end() - 1
            one = _record(src, x["name"], x.start(), stop, params=_typed_params(x["params"]), return_type=x["ret"])
            methods.append(one)
            taken.append((x.start(), stop))
            spans.append((x.end(), stop, x["name"]))
            out["functions"].append(one)
            if "public" in x["mods"]:
                out["exports"].append({"name": x["name"], "line": one["line_start"], "is_default": False})
        for x in _JAVA_FIELD.finditer(src.bare, body_at, end):
            if not depth[x.start("name") - m.end()] and not any(a <= x.start("name") <= b for a, b in taken):
                fields.append(x["name"])
                if "public" in x["mods"]:
                    out["exports"].append({"name": x["name"], "line": src.line(x.start("name")), "is_default": False})
        if "public" in m["mods"]:
            out["exports"].append({"name": m["name"], "line": src.line(m.start("kind")), "is_default": False})
        heritage = re.sub(r"\s+", " ", m["heritage"])
        extends = _names(e[1]) if supertypes and (e := re.search(r"extends ([^{]*?)(?: implements|$)", heritage)) else []
        implements = _names(e[1]) if supertypes and (e := re.search(r"implements (.*)$", heritage)) else []
        record = _record(src, m["name"], m.start("kind"), end, methods=methods)
        if m["kind"] == "interface":
            out["interfaces"].append({**record, "properties": fields, "extends": extends})
        elif m["kind"] == "enum":
            out["enums"].append({**record, "values": values})
        else:
            out["classes"].append({**record, "properties": fields, "extends": extends, "implements": implements})
    return {**out, "calls": _calls(src, spans)}


# C and C++

_CPP_FUNCTION = re.compile(r"(?:^|[;}\n])[ \t]*(?:template\s*<[^>]*>\s*)?(?P<head>(?:(?:static|inline|constexpr|virtual|explicit|extern|friend)\s+)*)(?P<ret>[\w:]+(?:<[^;{}()]*>)?(?:\s+(?:const|unsigned|long|int|char|short))*)?\s+(?P<name>~?\w+(?:::~?\w+)*)\s*\((?P<params>[^()]*)\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{]*)?\{")
_CPP_CLASS = re.compile(r"\b(?P<kind>class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[^{;]+))?\{")
_CPP_WORDS = frozenset("if for while switch catch return else do namespace class struct enum union".split())


def _cpp_function(src: Text, m: re.Match, end: int) -> dict:
    return _record(src, m["name"].rsplit("::", 1)[-1], m.start("head") if m["head"] else m.start("ret") if m["ret"] else m.start("name"), end, params=[] if m["params"].strip() == "void" else _typed_params(m["params"]), return_type=m["ret"])


def cpp(text: str) -> dict:
    src = Text(text)
    out: dict[str, list] = {k: [] for k in ("functions", "classes", "enums", "imports", "exports")}
    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text, re.M):
        out["imports"].append({"source": m[1], "specifiers": [m[1]], "line": src.line(m.start(1))})
    inside: list[tuple[int, int]] = []
    by_name: dict[str, dict] = {}
    for m in _CPP_CLASS.finditer(src.bare):
        if re.search(r"\benum\s*$", src.bare[: m.start()]):
            continue
        end = src.close(m.end() - 1)
        inside.append((m.end(), end))
        depth, methods, fields = src.depths(m.end(), end), [], []
        access = [(m.end(), "public" if m["kind"] == "struct" else "private"), *((x.start(), x[1]) for x in re.finditer(r"\b(public|private|protected)\s*:", src.bare[: end]) if x.start() > m.end())]
        for x in _CPP_FUNCTION.finditer(src.bare, m.end() - 1, end):
            at = x.start("name")
            if depth[at - m.end()] or x["name"] in _CPP_WORDS or x["ret"] in _CPP_WORDS:
                continue
            stop = src.close(x.end() - 1)
            one = _cpp_function(src, x, stop)
            methods.append(one)
            out["functions"].append(one)
            spans.append((x.end(), stop, one["name"]))
            if max(a for a in access if a[0] <= at)[1] == "public":
                out["exports"].append({"name": one["name"], "line": one["line_start"], "is_default": False})
        for x in re.finditer(r"(?:^|[;{}:\n])\s*(?:(?:static|const|mutable|constexpr)\s+)*[\w:]+(?:<[^;{}()]*>)?[\s*&]+(\w+)\s*(?:=[^;()]*|\[[^\]]*\])?;", src.bare[m.end() : end]):
            if depth[x.start(1)] == 0:
                fields.append(x[1])
        bases = [re.sub(r"\b(?:public|private|protected|virtual)\s+", "", b).strip() for b in _names(m["bases"])]
        made = _record(src, m["name"], m.start(), end, methods=methods, properties=fields, extends=bases, implements=[])
        by_name[m["name"]] = made
        out["classes"].append(made)
        out["exports"].append({"name": m["name"], "line": made["line_start"], "is_default": False})
    for m in re.finditer(r"\benum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::\s*[\w:]+\s*)?\{", src.bare):
        end = src.close(m.end() - 1)
        out["enums"].append(_record(src, m[1], m.start(), end, values=[re.split(r"[\s=]", v)[0] for v in _split(src.bare[m.end() : end])], methods=[]))
        out["exports"].append({"name": m[1], "line": src.line(m.start()), "is_default": False})
    spaces = [(m.end(), src.close(m.end() - 1)) for m in re.finditer(r"\bnamespace\s+[\w:]*\s*\{", src.bare)]
    for m in _CPP_FUNCTION.finditer(src.bare):
        at = m.start("name")
        if any(a <= at < b for a, b in inside) or m["name"] in _CPP_WORDS or m["ret"] in _CPP_WORDS:
            continue
        if any(a <= at < b for a, b, _ in spans) or src.bare.count("{", 0, at) - src.bare.count("}", 0, at) != sum(a <= at < b for a, b in spaces):
            continue
        stop = src.close(m.end() - 1)
        one = _cpp_function(src, m, stop)
        out["functions"].append(one)
        spans.append((m.end(), stop, one["name"]))
        owner = m["name"].rsplit("::", 2)[-2] if "::" in m["name"] else None
        if owner in by_name:
            by_name[owner]["methods"].append(one)
        if "static" not in m["head"]:
            out["exports"].append({"name": one["name"], "line": one["line_start"], "is_default": False})
    out["functions"].sort(key=lambda f: f["line_start"])
    return {**out, "calls": _calls(src, spans)}


PARSERS = {**dict.fromkeys(("typescript", "tsx", "javascript"), typescript), "java": java, **dict.fromkeys(("cpp", "c"), cpp)}
