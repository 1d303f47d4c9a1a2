"""Structure of Python sources, by the standard parser. A text with a syntax error has none."""

from __future__ import annotations

import ast
from collections.abc import Iterator

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Source:
    def __init__(self, text: str) -> None:
        self.lines = text.encode().split(b"\n")

    def text(self, node: ast.AST | None) -> str | None:
        """As written."""
        if node is None:
            return None
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode()
        inner = [self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]
        return b"\n".join(inner).decode()


def _params(args: ast.arguments) -> list[str]:
    """Names in order, without self and cls; starred ones with their stars, unless they are annotated."""
    named = [a.arg for a in (*args.posonlyargs, *args.args) if a.arg not in ("self", "cls")]
    star = [f"*{args.vararg.arg}"] if args.vararg and not args.vararg.annotation else []
    only = [a.arg for a in args.kwonlyargs if a.arg not in ("self", "cls")]
    double = [f"**{args.kwarg.arg}"] if args.kwarg and not args.kwarg.annotation else []
    return [*named, *star, *only, *double]


def _function(node, src: _Source) -> dict:
    return {"name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "params": _params(node.args), "return_type": src.text(node.returns)}


def _with_nested(node, src: _Source) -> Iterator[dict]:
    """Functions defined directly in a function's body, and in theirs."""
    for inner in node.body:
        if isinstance(inner, _DEFS):
            yield _function(inner, src)
            yield from _with_nested(inner, src)


def _protocol(name: str) -> bool:
    return name.lower() == "protocol" or name.endswith("Protocol")


def _class(node: ast.ClassDef, src: _Source) -> dict:
    extends, implements = [], []
    for base in node.bases:
        if isinstance(base, ast.Name):
            (implements if _protocol(base.id) or base.id.lower() == "abc" else extends).append(base.id)
        elif isinstance(base, ast.Attribute):
            extends.append(src.text(base))
    return {
        "name": node.name,
        "line_start": node.lineno,
        "line_end": node.end_lineno,
        "methods": [_function(m, src) for m in node.body if isinstance(m, _DEFS)],
        "properties": [m.target.id for m in node.body if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name)],
        "extends": extends,
        "implements": implements,
    }


def _variable(node, src: _Source) -> dict | None:
    """The first plain name of a top-level assignment, unless it is private."""
    left = node.target if isinstance(node, ast.AnnAssign) else node.targets[0]
    right = node.value if isinstance(node, ast.AnnAssign) or len(node.targets) == 1 else None
    name = next((x.id for x in (left, right) if isinstance(x, ast.Name)), "_")
    if name.startswith("_"):
        return None
    return {"name": name, "line_start": node.lineno, "line_end": node.end_lineno, "type_annotation": src.text(node.annotation) if isinstance(node, ast.AnnAssign) else None}


def _calls(tree: ast.AST, src: _Source) -> list[dict]:
    """Calls by name or attribute within functions, in the order of the text."""
    out: list[dict] = []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, ast.Call) and owner and isinstance(node.func, (ast.Name, ast.Attribute)):
            out.append({"caller": owner, "callee": src.text(node.func), "line": node.lineno})
        below = [(c, owner) for c in ast.iter_child_nodes(node)]
        if isinstance(node, _DEFS):
            outside = {id(d) for d in node.decorator_list}
            inside = [(c, owner if id(c) in outside else node.name) for c, _ in below]
            below = sorted(inside, key=lambda x: id(x[0]) not in outside)
        stack += reversed(below)
    return out


def python(text: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return {}
    src = _Source(text)
    out: dict[str, list] = {k: [] for k in ("functions", "classes", "variables", "enums", "interfaces", "imports", "exports")}
    for node in tree.body:
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            out["exports"].append({"name": node.name, "line": min([node.lineno, *(d.lineno for d in node.decorator_list)]), "is_default": False})
        if isinstance(node, _DEFS):
            out["functions"] += [_function(node, src), *_with_nested(node, src)]
        elif isinstance(node, ast.ClassDef):
            made = _class(node, src)
            out["classes"].append(made)
            own = {k: made[k] for k in ("name", "line_start", "line_end", "methods")}
            for base in made["extends"]:
                if base.lower() in ("enum", "intenum", "strnum"):
                    out["enums"].append({**own, "values": made["properties"]})
                    break
                if _protocol(base):
                    out["interfaces"].append({**own, "properties": made["properties"], "extends": made["extends"]})
                    break
            out["functions"] += [f for m in node.body if isinstance(m, _DEFS) for f in _with_nested(m, src)]
        elif isinstance(node, ast.Import):
            for a in sorted(node.names, key=lambda a: a.asname is not None):
                out["imports"].append({"source": a.name, "specifiers": [a.asname or a.name], "line": node.lineno})
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            plain = [a.name for a in node.names if not a.asname and a.name != "*"]
            renamed = [a.asname for a in node.names if a.asname]
            star = ["*"] if any(a.name == "*" for a in node.names) else []
            out["imports"].append({"source": "." * node.level + (node.module or ""), "specifiers": [*plain, *renamed, *star], "line": node.lineno})
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and (v := _variable(node, src)):
            out["variables"].append(v)
    return {**out, "calls": _calls(tree, src)}
