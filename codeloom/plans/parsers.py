"""Queries over generated project files, one or more for each parser: a text for each row of a table, in some variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.plans.catalogue import query
from codeloom.sources import testgraph as G

#: Name -> (list of the analysis, its columns, path, variants of (text, rows)); ``@k`` stands for the row's key.
PLANTED: dict[str, tuple[str, list[str], str, list[tuple[str, list[tuple]]]]] = {
    "markdown_sections": (
        "sections",
        ["name", "level", "line_start", "line_end"],
        "docs/c@k.md",
        [
            ("# Customer @k\n\ntext\n\n## Orders\n```\n# no heading\n```\n### Lines @k\n", [("Customer @k", 1, 1, 4), ("Orders", 2, 5, 8), ("Lines @k", 3, 9, 10)]),
            ("intro\n~~~\n## code\n```\n~~~\n## Notes @k\n#hash\n###### Deep", [("Notes @k", 2, 6, 7), ("Deep", 6, 8, 8)]),
        ],
    ),
    "markdown_links": (
        "refs",
        ["target", "kind", "line"],
        "docs/l@k.md",
        [("[a](src/c@k.py) and [b](http://x.y)\n![i](img/@k.png)\n", [("src/c@k.py", "file", 1), ("img/@k.png", "image", 2)]), ("no link\n", [])],
    ),
    "yaml_keys": (
        "sections",
        ["name", "level", "line_start", "line_end"],
        "conf/c@k.yaml",
        [
            ("name: c@k\nspec:\n  size: 1\n\nlist@k:\n  - a\n", [("name", 1, 1, 1), ("spec", 1, 2, 4), ("list@k", 1, 5, 7)]),
            ("- name: first@k\n- id: second\n- 3\n", [("first@k", 1, 1, 4), ("second", 1, 1, 4), ("[2]", 1, 1, 4)]),
            ("a@k: [\nb: }\n", [("a@k", 1, 1, 1), ("b", 1, 2, 3)]),
        ],
    ),
    "json_keys": (
        "sections",
        ["name", "level", "line_start", "line_end"],
        "conf/c@k.json",
        [
            ('{\n  // note\n  "name": "c@k",\n  "size@k": 1,\n}\n', [("name", 1, 3, 3), ("size@k", 1, 4, 6)]),
            ("[1, @k]\n", []),
            ('{"a": {"$ref": "other@k.json"}}', [("a", 1, 1, 1)]),
        ],
    ),
    "json_refs": ("refs", ["target", "kind", "line"], "conf/r@k.json", [('{\n "a": {"$ref": "other@k.json"},\n "b": {"$ref": "#/x"}\n}', [("other@k.json", "schema", 2)]), ("{", [])]),
    "toml_tables": (
        "sections",
        ["name", "level", "line_start", "line_end"],
        "conf/c@k.toml",
        [("x = 1\n[tool]\na = 1\n[tool.c@k]\nb = 2\n[[list@k]]\n", [("tool", 1, 2, 3), ("tool.c@k", 2, 4, 5), ("[[list@k]]", 1, 6, 7)])],
    ),
    "dockerfile_stages": (
        "services",
        ["name", "image", "ports", "line_start", "line_end"],
        "deploy/c@k/Dockerfile",
        [
            ("FROM python:3.@k AS build@k\nRUN pip install x\nFROM org/alpine:3\nCOPY --from=build@k /a /b\nEXPOSE 80 90@k\n", [("build@k", "python:3.@k", "", 1, 2), ("alpine", "org/alpine:3", "80,90@k", 3, 6)]),
            ("from scratch\nEXPOSE 8@k\n", [("scratch", "scratch", "8@k", 1, 3)]),
        ],
    ),
    "dockerfile_steps": ("steps", ["name", "line_start", "line_end"], "deploy/s@k/Dockerfile", [("FROM a:@k\n# RUN no\nRUN make c@k\nENV A=@k\n", [("FROM a:@k", 1, 1), ("RUN make c@k", 3, 3), ("ENV A=@k", 4, 4)])]),
    "graphql_types": (
        "definitions",
        ["name", "kind", "fields", "line_start", "line_end"],
        "api/c@k.graphql",
        [("type Customer@k {\n  id: ID!\n  orders(first: Int): [Order]\n}\n\ninput Filter@k {\n  name: String\n}\nenum Level {\n  LOW\n  HIGH\n}\n", [("Customer@k", "type", "id,orders", 1, 4), ("Filter@k", "input", "name", 6, 8), ("Level", "enum", "LOW,HIGH", 9, 12)])],
    ),
    "graphql_endpoints": ("endpoints", ["method", "path", "line_start", "line_end"], "api/q@k.graphql", [("type Query {\n  customer@k: Int\n  all: Int\n}\ntype Mutation {\n  save@k(x: Int): Int\n}\n", [("Query", "customer@k", 2, 2), ("Query", "all", 3, 3), ("Mutation", "save@k", 6, 6)])]),
    "protobuf_messages": (
        "definitions",
        ["name", "kind", "fields", "line_start", "line_end"],
        "api/c@k.proto",
        [('syntax = "proto3";\nmessage Customer@k {\n  int64 id = 1;\n  repeated string tags@k = 2;\n}\nenum Kind {\n  NONE = 0;\n  BIG@k = 1;\n}\n', [("Customer@k", "message", "id,tags@k", 2, 5), ("Kind", "enum", "NONE,BIG@k", 6, 9)])],
    ),
    "protobuf_services": ("endpoints", ["method", "path", "line_start", "line_end"], "api/s@k.proto", [("service Shop@k {\n  rpc Get (A) returns (B);\n  rpc Put@k (B) returns (A);\n}\n", [("rpc", "Shop@k.Get", 2, 2), ("rpc", "Shop@k.Put@k", 3, 3)])]),
    "terraform_resources": (
        "resources",
        ["name", "kind", "line_start", "line_end"],
        "infra/c@k.tf",
        [('resource "aws_vm" "c@k" {\n  size = 1\n}\ndata "aws_ami" "base" {\n}\nmodule "net@k" {\n}\nvariable "x" {\n}\n', [("aws_vm.c@k", "aws_vm", 1, 3), ("data.aws_ami.base", "data.aws_ami", 4, 5), ("module.net@k", "module", 6, 7)])],
    ),
    "terraform_variables": ("definitions", ["name", "kind", "line_start", "line_end"], "infra/v@k.tf", [('variable "size@k" {\n  default = 1\n}\noutput "ip" {\n}\n', [("size@k", "variable", 1, 3), ("ip", "output", 4, 5)])]),
    "makefile_targets": ("steps", ["name", "line_start", "line_end"], "build/c@k/Makefile", [("X := 1\n.PHONY: all\nall: c@k\n\tmake c@k\n\nc@k:\n\ttrue\n", [("all", 3, 5), ("c@k", 6, 8)]), ("Y ?= 2\nrun@k : x\n", [("run@k", 2, 3)])]),
    "shell_functions": ("functions", ["name", "line_start", "line_end"], "bin/c@k.sh", [("#!/bin/sh\nsetup@k() {\n  true\n}\nfunction clean {\n  if true; then { false; }; fi\n}\n", [("setup@k", 2, 4), ("clean", 5, 7)]), ("go@k ()\n{\n :\n}\n", [("go@k", 1, 4)])]),
    "shell_sources": ("refs", ["target", "kind", "line"], "bin/r@k.sh", [("source lib/c@k.sh\n. './env'\n", [("lib/c@k.sh", "file", 1), ("./env", "file", 2)])]),
    "typescript_functions": (
        "functions",
        ["name", "params", "line_start", "line_end"],
        "web/c@k.ts",
        [("import { greet } from './greet';\n\nexport function total@k(a: number, b = 1): number {\n  return a + b;\n}\n\nexport const half@k = (x: number) => x / 2;\n", [("total@k", "a,b", 3, 5), ("half@k", "x", 7, 7)])],
    ),
    "typescript_imports": ("imports", ["source", "specifiers", "line"], "web/i@k.ts", [("import { greet, bye } from './c@k';\nimport def from 'lib';\n", [("./c@k", "greet,bye", 1), ("lib", "def", 2)])]),
    "typescript_types": ("interfaces", ["name", "line_start", "line_end"], "web/t@k.ts", [("export interface Customer@k {\n  id: number;\n}\n\nexport type Id = string;\n", [("Customer@k", 1, 3)])]),
    "java_classes": (
        "classes",
        ["name", "line_start", "line_end"],
        "java/C@k.java",
        [("package shop;\n\nimport java.util.List;\n\npublic class C@k {\n  private int size;\n\n  public C@k(int size) {\n    this.size = size;\n  }\n\n  public int half(int by) {\n    return size / by;\n  }\n}\n", [("C@k", 5, 15)])],
    ),
    "java_imports": ("imports", ["source", "specifiers", "line"], "java/I@k.java", [("import java.util.List;\nimport shop.c@k.Order;\n\nclass I {}\n", [("java.util.List", "List", 1), ("shop.c@k.Order", "Order", 2)])]),
    "cpp_functions": ("functions", ["name", "params", "line_start", "line_end"], "cpp/c@k.cpp", [('#include "c@k.h"\n\nint total@k(int a, int b) {\n  return a + b;\n}\n', [("total@k", "a,b", 3, 5)])]),
    "cpp_includes": ("imports", ["source", "line"], "cpp/i@k.cpp", [('#include "c@k.h"\n#include <vector>\n', [("c@k.h", 1), ("vector", 2)])]),
}
_LISTS = ("params", "fields", "ports", "specifiers")


def _sql(columns: list[str], path: str, variants: list) -> str:
    parts = []
    for i, (_, rows) in enumerate(variants):
        for row in rows:
            cells = [f"replace('{path}', '@k', c_custkey::VARCHAR) AS file_path"]
            cells += [(f"replace('{v}', '@k', c_custkey::VARCHAR)" if isinstance(v, str) else f"{v}::INT") + f" AS {c}" for c, v in zip(columns, row)]
            parts.append(f"SELECT {', '.join(cells)} FROM customer WHERE c_custkey % {len(variants)} = {i}")
    return " UNION ALL ".join(parts)


def _planted(name: str, field: str, columns: list[str], path: str, variants: list) -> None:
    def run(s, d):
        key = F.col("c_custkey").cast("string")
        text = F.element_at(F.array(*[F.lit(t) for t, _ in variants]), (F.col("c_custkey") % len(variants) + 1).cast("int"))
        files = G.dealt(G.table(s, d, "customer").select("c_custkey"), G.DEALT_KEYS).select(F.replace(F.lit(path), F.lit("@k"), key).alias("path"), F.replace(text, F.lit("@k"), key).alias("content"))
        found = registry.analyze(files, lists=(field,)).select("file_path", F.inline(field))
        return found.select("file_path", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in _LISTS else c for c in columns])

    run.__name__ = name
    query(_sql(columns, path, variants))(run)


for _name, _spec in PLANTED.items():
    _planted(_name, *_spec)
