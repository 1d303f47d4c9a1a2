"""The engine's fixed vocabularies, as data. Everything here is small enough to be a literal in a plan."""

from __future__ import annotations


def _inverted(lines: str) -> dict[str, str]:
    """``value: alias alias ...`` by line, as alias -> value."""
    out = {}
    for line in lines.strip().splitlines():
        value, _, names = line.partition(":")
        out |= dict.fromkeys(names.split(), value.strip())
    return out


NODE_TYPES = tuple(
    "file function class module concept config document service table endpoint pipeline schema resource domain flow step "
    "article entity topic claim source variable enum interface type_alias".split()
)
EDGE_TYPES = tuple(
    "imports exports contains inherits implements calls subscribes publishes middleware reads_from writes_to transforms validates "
    "depends_on tested_by configures related similar_to deploys serves provisions triggers migrates documents routes defines_schema "
    "contains_flow flow_step cross_domain cites contradicts builds_on exemplifies categorized_under authored_by references type_of "
    "overrides decorates instantiates returns".split()
)
COMPLEXITIES = ("simple", "moderate", "complex")
DIRECTIONS = ("forward", "backward", "bidirectional")

NODE_ALIASES = _inverted("""
class: interface struct
function: method fn func
module: package pkg mod
service: pod deployment container
document: docs readme doc
pipeline: ci job
endpoint: mutation query api route
config: configuration env setting
resource: terraform infrastructure infra
table: view db database migration
schema: typedef definition protobuf proto
domain: business_domain
flow: business_process business_flow
step: business_step task
article: wiki_page page note
entity: organization actor person
topic: theme category tag
claim: thesis decision assertion
source: paper raw reference
""")
EDGE_ALIASES = _inverted("""
calls: invoke invokes
inherits: extends
depends_on: requires uses
related: related_to relates_to
similar_to: similar
imports: import
exports: export
contains: contain
publishes: publish
subscribes: subscribe
documents: documented_by describes
provisions: creates
serves: listens exposes
deploys: deploys_to
migrates: migrates_to
routes: routes_to
triggers: fires triggers_on
defines_schema: defines
contains_flow: has_flow
flow_step: next_step
cross_domain: interacts_with
cites: cites_source references
contradicts: disagrees_with conflicts_with
builds_on: elaborates refines
exemplifies: example_of instance_of illustrates
categorized_under: tagged_with belongs_to
authored_by: created_by written_by
""")
COMPLEXITY_ALIASES = _inverted("""
simple: easy low
moderate: intermediate medium
complex: difficult hard high
""")
DIRECTION_ALIASES = _inverted("""
forward: outbound to
backward: inbound from
bidirectional: mutual both
""")
#: The batch normaliser knows more words for a complexity than the validator does.
BATCH_COMPLEXITIES = COMPLEXITY_ALIASES | _inverted("""
simple: basic trivial
moderate: average mid
complex: advanced
""")

#: Prefix of a canonical id, by node type; only functions differ from their type.
ID_PREFIXES = {t: "func" if t == "function" else t for t in NODE_TYPES[:16]}
PREFIX_TYPES = {p: t for t, p in ID_PREFIXES.items()}
#: Kind of a definition in a configuration file -> node type; any other kind is a concept.
KIND_TYPES = _inverted("""
table: index view table
schema: enum type message
resource: module resource
service: deployment service
pipeline: target stage job
endpoint: mutation query route
config: output variable
""")

#: Weight of an edge that the builder makes.
EDGE_WEIGHTS = {"contains": 1.0, "inherits": 0.9, "implements": 0.9, "overrides": 0.8, "calls": 0.8, "type_of": 0.7, "instantiates": 0.7, "imports": 0.7, "decorates": 0.6, "exports": 0.6, "returns": 0.5, "references": 0.5}
#: What a change of a node can reach.
IMPACT_TYPES = ("calls", "contains", "implements", "imports", "inherits", "references")

#: Directories that never hold sources.
CACHE_DIRS = tuple("venv .venv __pycache__ node_modules .git .uv-cache .mypy_cache .pytest_cache .ruff_cache .codeloom".split())
#: Ignore rules that always hold, in gitignore syntax.
DEFAULT_IGNORES = """
    *.7z build *.bz2 .cache/ .codeloom coverage/ dist .DS_Store *.egg-info .eggs *.eot *.generated.* *.gif .git .gitignore *.gz .hg *.ico .idea *.jpeg
    *.jpg LICENSE *.lock *.map *.min.js *.mp3 *.mp4 node_modules obj/ *.ogg out/ package-lock.json *.pdf *.png pnpm-lock.yaml *.pyc __pycache__ *.pyo *.rar
    *.svg .svn *.swo *.swp *.tar target/ Thumbs.db .tox *.ttf .turbo/ vendor/ .venv venv .vscode *.webm *.woff *.woff2 yarn.lock *.zip *~
""".split()

#: Folder names of a layer (each also in the plural); the first group that matches decides.
LAYERS = (
    ("API Layer", "api endpoint handler controller routes"),
    ("Service Layer", "business use-case usecase service"),
    ("Data Layer", "repo repository migration db database schema entity model"),
    ("UI Layer", "ui widget layout screen page view component"),
    ("Middleware Layer", "pipe filter guard interceptor middleware"),
    ("External Services", "adapter vendor sdk external integration client"),
    ("Background Tasks", "background scheduler processor consumer cron queue job worker"),
    ("Utility Layer", "shared common lib helper util"),
    ("Test Layer", "__specs__ __tests__ __spec__ __test__ spec test"),
    ("Configuration Layer", "env setting config"),
)
CORE_LAYER = "Core"

#: Concept -> what tells of it, in order of report.
CONCEPTS = tuple(
    (name.strip(), tuple(w.strip() for w in words.split("|")))
    for name, _, words in (line.partition("<-") for line in """
async/await <- async | await | promise | asynchronous
middleware pattern <- interceptor | middleware | pipe
generics <- type parameter | template | generic
decorators <- annotation | decorator | @
dependency injection <- di | container | provider | inject
observer pattern <- listener | observable | event | publish | subscribe
singleton <- shared client | instance | singleton
type guards <- discriminated union | narrowing | is | type guard
higher-order functions <- closure | higher-order | factory | callback
error handling <- Result type | exception | error boundary | try/catch
streams <- writable | readable | transform | pipe | stream
concurrency <- mutex | worker | thread | channel | goroutine
""".strip().splitlines())
)

#: Symbols that a language or its usual libraries bring, so that a reference to one is no reference into the project.
_PYTHON = """
    id re io os abc ord all xml sum len bin min map zip chr dir str abs sys oct set int csv pow max hex any exec uuid time type rich hash math eval yaml
    toml html bool enum open json help http iter repr vars dict quit exit list next copy round slice range tuple ascii click flask email super types bytes
    redis float print input numpy base64 urllib sorted divmod pickle typing string shutil random django filter pandas locals format object struct socket
    pprint pytest celery sqlite3 hashlib pathlib compile license logging fastapi asyncio delattr hasattr getattr setattr globals credits inspect complex
    pydantic reversed callable tempfile datetime argparse textwrap warnings requests unittest property enumerate starlette threading traceback functools
    itertools frozenset copyright bytearray __import__ contextlib isinstance statistics issubclass subprocess breakpoint memoryview sqlalchemy classmethod
    dataclasses collections staticmethod
"""
_TYPESCRIPT = """
    fs os URL url Map tls dns Set net JSON btoa zlib Blob atob File Date Math path util Intl http fetch Error https Array Proxy module String Symbol stream
    domain crypto RegExp Number Buffer events Object BigInt assert window console require Promise Boolean WeakMap cluster Atomics Headers process exports
    Reflect WeakSet Request FormData punycode readline Response document DataView __dirname TypeError Int8Array __filename RangeError globalThis setTimeout
    Int32Array Int16Array Uint8Array performance querystring AbortSignal setInterval TextDecoder TextEncoder ArrayBuffer SyntaxError Uint32Array
    Uint16Array setImmediate clearTimeout Float32Array Float64Array clearInterval child_process BigInt64Array clearImmediate queueMicrotask ReferenceError
    BigUint64Array structuredClone AbortController URLSearchParams SharedArrayBuffer Uint8ClampedArray
"""
_CPP = """
    map set NULL free exit list fread tuple ctime queue deque scanf cmath stack fopen abort qsort regex mutex calloc malloc thread fclose fwrite sizeof
    printf string time.h math.h random strlen cstdio chrono strcmp vector strcat memset memcpy strcpy memory cstdlib realloc memmove fprintf sprintf
    cstring stdio.h bsearch fstream sstream cassert utility stdlib.h stddef.h string.h stdint.h assert.h iostream iterator ccomplex stdbool.h algorithm
    functional unordered_map unordered_set condition_variable
"""
_JAVA = """
    Map Set UUID Void File Date Byte Long Math Enum List Error Class Float Short Thread Double String Stream System Random Number Reader Writer Arrays
    Object Runtime Boolean TreeMap HashMap Integer Process Objects TreeSet HashSet Override Readable Runnable Iterable Optional Calendar Iterator Cloneable
    Throwable Exception Character ArrayList Deprecated Appendable Comparable Collection Comparator LinkedList InputStream IOException Collections
    CharSequence OutputStream StringBuffer AutoCloseable StringBuilder BufferedReader BufferedWriter RuntimeException SuppressWarnings StackTraceElement
    FunctionalInterface FileNotFoundException
"""
BUILTINS = {
    **dict.fromkeys(("python",), frozenset(_PYTHON.split())),
    **dict.fromkeys(("typescript", "tsx", "javascript"), frozenset(_TYPESCRIPT.split())),
    **dict.fromkeys(("cpp", "c"), frozenset(_CPP.split())),
    **dict.fromkeys(("java",), frozenset(_JAVA.split())),
}

#: Suffixes that an import may leave out, by language, in order; and files that stand for their folder.
IMPORT_SUFFIXES = {
    "python": (".py", ".pyi", ".pyx"),
    "typescript": (".ts", ".tsx", ".mts", ".cts", ".d.ts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"),
    "c": (".c", ".h"),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
}
INDEX_FILES = ("__init__.py", *(f"index.{s}" for s in ("ts", "tsx", "js", "jsx", "mjs", "cjs")), "mod.rs", "mod.go")
#: Suffixes that the builder tries for an import of the same project.
LOCAL_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".pyw")

#: id | name | extensions | file names | concepts; a later line overrides an earlier one.
_LANGUAGES = """
typescript | TypeScript | .ts .tsx |  | generics; type guards; discriminated unions; utility types; decorators; enums; interfaces; type inference; mapped types; conditional types; template literal types
javascript | JavaScript | .js .jsx .mjs .cjs |  | closures; prototypes; promises; async/await; event loop; destructuring; spread operator; proxies; generators; modules (ESM/CJS)
python | Python | .py .pyi |  | decorators; list comprehensions; generators; context managers; type hints; dunder methods; metaclasses; dataclasses; async/await; descriptors; protocols
go | Go | .go |  | goroutines; channels; interfaces; struct embedding; error handling patterns; defer/panic/recover; slices; pointers; concurrency patterns
rust | Rust | .rs |  | ownership; borrowing; lifetimes; traits; pattern matching; enums with data; error handling (Result/Option); macros; async/await; unsafe blocks; generics; closures
java | Java | .java |  | generics; annotations; interfaces; abstract classes; streams API; lambdas; sealed classes; records; dependency injection; checked exceptions
ruby | Ruby | .rb .rake |  | blocks and procs; mixins; metaprogramming; duck typing; DSLs; monkey patching; symbols; method_missing; open classes
php | PHP | .php |  | namespaces; traits; type declarations; attributes; enums; fibers; closures; magic methods; dependency injection; middleware
swift | Swift | .swift |  | optionals; protocols; extensions; generics; closures; property wrappers; result builders; actors; structured concurrency; value types vs reference types
kotlin | Kotlin | .kt .kts |  | coroutines; data classes; sealed classes; extension functions; null safety; delegation; DSL builders; inline functions; companion objects; flow
lua | Lua | .lua |  | tables; metatables; coroutines; closures; prototype-based OOP; varargs; weak references; environments
c | C | .c .h |  | pointers; manual memory management; structs; unions; function pointers; preprocessor macros; header files; static vs dynamic linking
cpp | C++ | .cpp .cc .cxx .hpp .hxx |  | templates; RAII; smart pointers; move semantics; operator overloading; virtual functions; namespaces; constexpr; lambda expressions; STL containers
csharp | C# | .cs |  | LINQ; async/await; generics; properties; delegates and events; attributes; nullable reference types; pattern matching; records; dependency injection
markdown | Markdown | .md .mdx |  | headings; links; code blocks; front matter; lists; tables; images
yaml | YAML | .yaml .yml |  | mappings; sequences; anchors; aliases; multi-document; tags
json | JSON | .json .jsonc |  | objects; arrays; nesting; schema references; comments (JSONC)
toml | TOML | .toml |  | tables; inline tables; arrays of tables; key-value pairs; dotted keys
env | Environment Variables | .env | .env .env.local .env.development .env.production .env.test .env.example | key-value pairs; variable interpolation; secrets; environment-specific config
xml | XML | .xml .xsl .xsd .svg .plist |  | elements; attributes; namespaces; DTD; XPath; XSLT; schemas
dockerfile | Dockerfile |  | Dockerfile Dockerfile.dev Dockerfile.prod Dockerfile.test | multi-stage builds; layers; base images; COPY/ADD; EXPOSE; ENTRYPOINT; CMD; ARG; ENV
sql | SQL | .sql |  | tables; columns; indexes; foreign keys; views; stored procedures; triggers; migrations
graphql | GraphQL | .graphql .gql |  | types; queries; mutations; subscriptions; resolvers; directives; fragments; schema
protobuf | Protocol Buffers | .proto |  | messages; services; enums; oneof; repeated fields; maps; packages; imports
terraform | Terraform | .tf .tfvars |  | resources; data sources; variables; outputs; modules; providers; state; workspaces
github-actions | GitHub Actions |  |  | workflows; jobs; steps; actions; triggers; secrets; matrix strategy; artifacts
makefile | Makefile | .mk | Makefile GNUmakefile makefile | targets; dependencies; recipes; variables; pattern rules; phony targets; includes
shell | Shell Script | .sh .bash .zsh |  | variables; functions; conditionals; loops; pipes; redirection; subshells; exit codes
html | HTML | .html .htm |  | elements; attributes; semantic tags; forms; meta tags; scripts; stylesheets; accessibility
css | CSS | .css .scss .less |  | selectors; properties; media queries; flexbox; grid; variables; animations; specificity
openapi | OpenAPI |  | openapi.yaml openapi.json swagger.yaml swagger.json | paths; operations; schemas; parameters; responses; security schemes; tags; servers
kubernetes | Kubernetes |  |  | deployments; services; pods; configmaps; secrets; ingress; volumes; namespaces
docker-compose | Docker Compose |  | docker-compose.yml docker-compose.yaml compose.yml compose.yaml | services; networks; volumes; ports; environment; depends_on; build context; healthchecks
json-schema | JSON Schema |  |  | types; properties; required fields; $ref; $defs; allOf/anyOf/oneOf; patterns; validation
csv | CSV | .csv .tsv |  | headers; rows; delimiters; quoting; escaping
restructuredtext | reStructuredText | .rst |  | headings; directives; roles; cross-references; toctree; code blocks; admonitions
powershell | PowerShell | .ps1 .psm1 .psd1 |  | cmdlets; pipelines; modules; functions; parameters; variables; error handling
batch | Batch Script | .bat .cmd |  | commands; variables; labels; goto; call; echo; set; for loops; if conditions
jenkinsfile | Jenkinsfile |  | Jenkinsfile | pipeline; stages; steps; agents; environment; post actions; parallel execution; shared libraries
plaintext | Plain Text | .txt .text |  | paragraphs; lists; sections
"""
#: id | name | languages | dependency names | manifests | entry points | folder>layer
_FRAMEWORKS = """
django | Django | python | django djangorestframework django-rest-framework django-cors-headers django-filter | requirements.txt pyproject.toml setup.py setup.cfg Pipfile | manage.py wsgi.py asgi.py | views>api models>data serializers>api urls>api templates>ui migrations>data management>config signals>service admin>config forms>ui templatetags>utility
fastapi | FastAPI | python | fastapi uvicorn starlette | requirements.txt pyproject.toml setup.py setup.cfg Pipfile | main.py app.py | routers>api schemas>types models>data dependencies>service crud>service api>api
flask | Flask | python | flask flask-restful flask-sqlalchemy flask-marshmallow flask-wtf | requirements.txt pyproject.toml setup.py setup.cfg Pipfile | app.py run.py wsgi.py | blueprints>api views>api models>data forms>ui templates>ui extensions>config
react | React | typescript javascript | react react-dom @types/react | package.json | src/App.tsx src/App.jsx src/index.tsx src/main.tsx | components>ui hooks>service pages>ui contexts>service utils>utility lib>service
nextjs | Next.js | typescript javascript | next @next/font @next/image | package.json | src/app/layout.tsx pages/_app.tsx src/pages/_app.tsx | app>ui pages>ui api>api components>ui lib>service middleware>middleware
express | Express | javascript typescript | express express-validator express-session | package.json | src/index.js src/app.js server.js app.js src/index.ts src/app.ts | routes>api controllers>service models>data middleware>middleware services>service db>data
vue | Vue | typescript javascript | vue @vue/cli-service nuxt vite-plugin-vue | package.json | src/main.ts src/App.vue src/main.js | components>ui views>ui store>service composables>service router>config plugins>config
spring | Spring Boot | java kotlin | spring-boot spring-boot-starter spring-web spring-data org.springframework | pom.xml build.gradle build.gradle.kts | **/Application.java **/App.java | controller>api service>service repository>data model>data entity>data config>config dto>types security>middleware
rails | Ruby on Rails | ruby | rails railties actionpack activerecord actionview | Gemfile | config.ru bin/rails | controllers>api models>data views>ui helpers>utility mailers>service jobs>service channels>service middleware>middleware lib>service
gin | Gin | go | github.com/gin-gonic/gin | go.mod | main.go cmd/server/main.go | handlers>api routes>api models>data middleware>middleware services>service repository>data
"""


def _rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] if " | " in line else [line] for line in (x.replace("| |", "|  |").replace("| |", "|  |") for x in text.strip().splitlines())]


LANGUAGES = [
    {"id": r[0], "name": r[1], "extensions": r[2].split(), "files": r[3].split(), "concepts": [c.strip() for c in r[4].split(";") if c.strip()]}
    for r in _rows(_LANGUAGES)
]
FRAMEWORKS = [
    {"id": r[0], "name": r[1], "languages": r[2].split(), "keywords": r[3].split(), "manifests": r[4].split(), "entry_points": r[5].split(), "layer_hints": dict(h.split(">") for h in r[6].split())}
    for r in _rows(_FRAMEWORKS)
]
BY_EXTENSION = {e: lang["id"] for lang in LANGUAGES for e in lang["extensions"]}
BY_FILE = {f.lower(): lang["id"] for lang in LANGUAGES for f in lang["files"]}
#: What the extractors know besides, where no configured language claims a file.
EXTRACTOR_SUFFIXES = _inverted("""
typescript: .mts .cts
tsx: .tsx
python: .pyw
cpp: .c++ .hh .h++
jsonc: .jsonc
""")

#: Build and cache output to ignore, by language and by framework.
LANGUAGE_IGNORES = {
    "cpp": "*.a *.dylib *.o *.obj *.so build cmake-build-*",
    "csharp": "*.suo *.user bin obj packages",
    "go": "*.exe *.out *.test vendor",
    "java": "*.class *.jar *.war .gradle build target",
    "javascript": ".next .nuxt build coverage dist node_modules",
    "php": "*.phar vendor",
    "python": "*.egg-info *.pyc *.pyo *.whl .eggs .tox .venv __pycache__ build dist venv",
    "ruby": "*.gem .bundle log tmp vendor/bundle",
    "rust": "**/*.rs.bk target",
    "typescript": "*.tsbuildinfo .next .nuxt build coverage dist node_modules",
}
FRAMEWORK_IGNORES = {"django": "*.sqlite3 media staticfiles", "nextjs": ".next .vercel", "rails": "log public/assets public/packs tmp", "react": "build", "spring": ".mvn target"}
SUGGESTED_DIRS = tuple("__tests__ test tests fixtures testdata docs examples scripts migrations .storybook".split())
SUGGESTED_FILES = tuple(f"*{s}" for s in (".test.*", ".spec.*", ".snap"))
