"""Extractors on small sources: names, lines and kinds."""

from __future__ import annotations

from codeloom.extract import braces, config_files, frameworks, python_source


def names(rows, *keys):
    return [tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]] for r in rows]


def test_markdown():
    got = config_files.markdown("# A\n\n```\n# no\n```\n## B\ntext [x](a.md) ![i](p.png) [w](http://x)\n### C\n## D\n")
    assert names(got["sections"], "name", "level", "line_start", "line_end") == [("A", 1, 1, 5), ("B", 2, 6, 7), ("C", 3, 8, 8), ("D", 2, 9, 10)]
    assert names(got["refs"], "target", "kind", "line") == [("a.md", "file", 7), ("p.png", "image", 7)]


def test_toml_env_yaml_json():
    assert names(config_files.toml("[a]\nx=1\n[a.b]\n[[c]]\n[d]\n")["sections"], "name", "level") == [("a", 1), ("a.b", 2), ("[[c]]", 1), ("d", 1)]
    assert names(config_files.env("# c\nA=1\n\n b_2=x\n9=no\nC = 3\nD=\n")["definitions"], "name", "line_start") == [("A", 2), ("b_2", 4), ("D", 7)]
    assert names(config_files.yaml_file("a: 1\nb:\n  c: 2\n'd e': 3\n")["sections"], "name", "line_start", "line_end") == [("a", 1, 1), ("b", 2, 3), ("d e", 4, 5)]
    assert names(config_files.yaml_file("- name: x\n- id: y\n- 3\n")["sections"], "name") == ["x", "y", "[2]"]
    assert names(config_files.yaml_file("a: [1\nb: 2\n")["sections"], "name") == ["a", "b"]
    text = '{ // c\n "a": "//x", /* y */\n "b": {"$ref": "other.json#/p"},\n "c": {"$ref": "#/q"},\n}'
    got = config_files.json_file(text)
    assert names(got["sections"], "name", "line_start") == [("a", 2), ("b", 3), ("c", 4)]
    assert names(got["refs"], "target", "line") == [("other.json#/p", 3)]
    assert config_files.json_file("[1]") == {"refs": []} and "sections" not in config_files.json_file("{bad")
    assert config_files.strip_jsonc('{"u": "http://x", "e": "\\"/*"} // z') == '{"u": "http://x", "e": "\\"/*"} '


def test_dockerfile_and_makefile():
    got = config_files.dockerfile("FROM python:3.12 AS builder\nRUN pip install x\nEXPOSE 80 x 443\nFROM org/alpine:3\nexpose 8080\nLABEL a=b\n")
    assert names(got["services"], "name", "image", "ports", "line_start", "line_end") == [("builder", "python:3.12", [80, 443], 1, 3), ("alpine", "org/alpine:3", [8080], 4, 7)]
    assert names(got["steps"], "name")[:2] == ["FROM python:3.12 AS builder", "RUN pip install x"] and len(got["steps"]) == 5
    got = config_files.makefile(".PHONY: all\nall: b\n\techo\n\nb:\n\techo b\nX := 1\n")
    assert names(got["steps"], "name", "line_start", "line_end") == [("all", 2, 4), ("b", 5, 6)]


def test_sql_graphql_protobuf_terraform_shell():
    got = config_files.sql('CREATE TABLE users (\n id INT,\n "name" TEXT,\n PRIMARY KEY (id)\n);\ncreate or replace view v as select 1;\nCREATE UNIQUE INDEX IF NOT EXISTS ix ON users (id);')
    assert names(got["definitions"], "name", "kind", "fields") == [("users", "table", ["id", "name"]), ("v", "view", []), ("ix", "index", [])]
    assert (got["definitions"][0]["line_start"], got["definitions"][0]["line_end"]) == (1, 5)
    got = config_files.graphql("type User {\n  id: ID\n  name: String\n}\nenum Role {\n  ADMIN\n}\ntype Query {\n  users: [User]\n  user(id: ID): User\n}\n")
    assert names(got["definitions"], "name", "kind", "fields") == [("User", "type", ["id", "name"]), ("Role", "enum", ["ADMIN"])]
    assert names(got["endpoints"], "method", "path", "line_start") == [("Query", "users", 9), ("Query", "user", 10)]
    got = config_files.protobuf("message A {\n  string x = 1;\n  repeated int32 y = 2;\n  map<string, int32> z = 3;\n}\nenum E {\n  ZERO = 0;\n}\nservice S {\n  rpc Get (A) returns (A);\n}\n")
    assert names(got["definitions"], "name", "kind", "fields") == [("A", "message", ["x", "y", "z"]), ("E", "enum", ["ZERO"])]
    assert names(got["endpoints"], "path", "line_start") == [("S.Get", 10)]
    got = config_files.terraform('resource "aws_s3" "b" {\n  x = {}\n}\ndata "d" "e" {\n}\nmodule "m" {\n}\nvariable "v" {\n}\noutput "o" {\n}\n')
    assert names(got["resources"], "name", "kind", "line_end") == [("aws_s3.b", "aws_s3", 3), ("data.d.e", "data.d", 5), ("module.m", "module", 7)]
    assert names(got["definitions"], "name", "kind") == [("v", "variable"), ("o", "output")]
    got = config_files.shell("source ./lib.sh\nrun() {\n  a\n}\nfunction stop\n{\n  b\n}\nnot()\nx\n")
    assert names(got["functions"], "name", "line_start", "line_end") == [("run", 2, 4), ("stop", 5, 8)]
    assert names(got["refs"], "target") == ["./lib.sh"]


def test_python():
    got = python_source.python('''import os, sys as system
from a.b import c as d, e
from . import f
from x import *
LIMIT: int = 3
a = b = 1
_hidden = 2

@deco(1)
async def go(x, self, *args, y: int = 1, **kw) -> "T":
    def inner(z):
        return os.path.join(z)
    return inner(x)

class Color(Enum):
    RED: int = 1

class P(Protocol, base.Model, metaclass=M):
    n: int
    m = 2
    def run(self, q):
        help.me(q)()
''')
    assert names(got["imports"], "source", "specifiers") == [("os", ["os"]), ("sys", ["system"]), ("a.b", ["e", "d"]), (".", ["f"]), ("x", ["*"])]
    assert names(got["functions"], "name", "line_start", "line_end", "params", "return_type") == [("go", 10, 13, ["x", "*args", "y", "**kw"], '"T"'), ("inner", 11, 12, ["z"], None)]
    assert names(got["variables"], "name", "type_annotation") == [("LIMIT", "int"), ("a", None)]
    assert names(got["exports"], "name", "line") == [("go", 9), ("Color", 15), ("P", 18)]
    assert names(got["classes"], "name", "properties", "extends", "implements") == [("Color", ["RED"], ["Enum"], []), ("P", ["n"], ["base.Model"], ["Protocol"])]
    assert names(got["enums"], "name", "values") == [("Color", ["RED"])] and got["interfaces"] == []
    assert names(got["calls"], "caller", "callee") == [("inner", "os.path.join"), ("go", "inner"), ("run", "help.me")]
    assert python_source.python("def broken(:") == {}


def test_typescript():
    got = braces.typescript("""import def, { a as b, c } from './m';
import * as ns from "lib";
import './side';
// function no() {}
export function add(x: number, ...rest: string[]): Promise<number> {
  const s = "function fake() {";
  return helper(x);
}
const arrow = async (q) => { ns.call(q); };
export default class Foo extends Bar implements Baz, Qux {
  private n: number = 1;
  constructor(y: string) { super(); init(y); }
  run(z?: number): void { this.go(); }
}
export interface Shape extends Base { area(): number; name: string; }
enum Color { Red = 1, Green }
export type Id = string;
export const LIMIT: number = 3;
""")
    assert names(got["imports"], "source", "specifiers") == [("./m", ["def", "b", "c"]), ("lib", ["* as ns"]), ("./side", [])]
    assert names(got["functions"], "name", "params", "return_type") == [("add", ["x", "...rest"], "Promise<number>"), ("arrow", ["q"], None)]
    (foo,) = got["classes"]
    assert (foo["name"], foo["extends"], foo["implements"], names(foo["methods"], "name"), foo["properties"]) == ("Foo", ["Bar"], ["Baz", "Qux"], ["constructor", "run"], ["n"])
    assert names(got["interfaces"], "name", "extends", "properties") == [("Shape", ["Base"], ["name"])] and names(got["interfaces"][0]["methods"], "name") == ["area"]
    assert names(got["enums"], "name", "values") == [("Color", ["Red", "Green"])]
    assert names(got["type_aliases"], "name") == ["Id"] and names(got["variables"], "name", "type_annotation") == [("LIMIT", "number")]
    assert {"add", "Foo", "Shape", "Id", "LIMIT"} <= set(names(got["exports"], "name"))
    assert ("add", "helper") in names(got["calls"], "caller", "callee") and ("arrow", "ns.call") in names(got["calls"], "caller", "callee")


def test_java():
    text = """package p;
import java.util.List;
import static a.B.*;
public class Foo extends Bar implements Baz {
    private int n = 1;
    public String name;
    public Foo(int n) { this.n = n; }
    public List<String> run(final String a, int... b) throws IOException { if (n > 0) { go(a); } return new Thing(a); }
    void hidden() {}
}
interface Shape { double area(); }
enum Color { RED, GREEN; int x() { return 1; } }
"""
    got = braces.java(text)
    assert names(got["imports"], "source", "specifiers") == [("java.util.List", ["List"]), ("a.B", ["*"])]
    (foo,) = got["classes"]
    assert names(foo["methods"], "name", "params") == [("Foo", ["n"]), ("run", ["a", "b"]), ("hidden", [])] and foo["properties"] == ["n", "name"] and foo["extends"] == []
    assert braces.java(text, supertypes=True)["classes"][0]["implements"] == ["Baz"]
    assert names(got["interfaces"], "name") == ["Shape"] and names(got["interfaces"][0]["methods"], "name") == ["area"]
    assert names(got["enums"], "name", "values") == [("Color", ["RED", "GREEN"])]
    assert {"Foo", "run", "name"} <= set(names(got["exports"], "name")) and "hidden" not in names(got["exports"], "name")
    assert ("run", "go") in names(got["calls"], "caller", "callee") and ("run", "new Thing") in names(got["calls"], "caller", "callee")


def test_cpp():
    got = braces.cpp("""#include <vector>
#include "own.h"
namespace ns {
class Shape : public Base {
  int n;
public:
  double area(int w) { return calc(w); }
  void out();
};
struct P { int x; };
enum class Color { Red, Green = 2 };
static int helper(int a) { return a; }
int main(void) { helper(1); return 0; }
}
void ns::Shape::out() { print(); }
""")
    assert names(got["imports"], "source") == ["vector", "own.h"]
    assert {"area", "helper", "main", "out"} == set(names(got["functions"], "name"))
    shape = got["classes"][0]
    assert shape["extends"] == ["Base"] and set(names(shape["methods"], "name")) == {"area", "out"} and "n" in shape["properties"]
    assert names(got["enums"], "name", "values") == [("Color", ["Red", "Green"])]
    exported = names(got["exports"], "name")
    assert "main" in exported and "helper" not in exported and "area" in exported
    assert ("main", "helper") in names(got["calls"], "caller", "callee")


def test_frameworks():
    assert frameworks.detect({"package.json": '{"dependencies": {"preact": "1"}, "devDependencies": {"React-Dom": "1"}}'}) == ["react"]
    assert frameworks.detect({"requirements.txt": "# django\nfastapi[all]>=0.1 # x\n-r other\n"}) == ["fastapi"]
    assert frameworks.detect({"pyproject.toml": '[project]\ndependencies = ["Django>=4"]\n[tool.poetry.dependencies]\npython = "3"\nflask = "1"\n'}) == ["django", "flask"]
    assert frameworks.detect({"pom.xml": "<artifactId>spring-boot</artifactId>", "go.mod": "require (\n\tgithub.com/gin-gonic/gin v1\n)", "Gemfile": "gem 'rails'"}) == ["spring", "rails", "gin"]
    assert frameworks.detect({"package.json": "{broken", "setup.cfg": "[options]\ninstall_requires =\n  flask>=1\n"}) == ["flask"]
    nodes, edges = frameworks.resolve("a.py", "@app.get('/x')\ndef read(q):\n    pass\n", "python", {"fastapi"})
    assert nodes[0]["id"] == "endpoint:a.py:GET /x" and edges[0]["target"] == "function:a.py:read"
    nodes, _ = frameworks.resolve("A.java", '@RestController class A { @PostMapping("/p") public String save(String x) {} }', "java", {"spring"})
    assert nodes[0]["name"] == "POST /p"
    nodes, edges = frameworks.resolve("u.py", "urlpatterns = [path('a/', view), re_path('b', other)]", "python", {"django"})
    assert [e["target"] for e in edges] == ["function:u.py:view", "function:u.py:other"]
    assert frameworks.resolve("c.tsx", "export function App(p) {\n}", "tsx", {"react"})[1][0]["type"] == "contains"
