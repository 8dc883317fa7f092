"""Source text to site tables.

A tolerant scanner reads each file by itself: it blanks comments, keeps strings, and finds
decorators, calls with balanced arguments, classes and constants. It knows no types; how
much that misses is told by the recall reports. Extraction runs over (file, text) in
Arrow batches; a file that can't be read gives an error row and never fails the task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

NAME = r"[A-Za-z_$][\w$]*"
_QUOTED = r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
_STRING = re.compile(_QUOTED, re.S)
_COMMENT = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_QUOTED}", re.S)
_BRACKET = re.compile(rf"{_QUOTED}|[()\[\]{{}}]", re.S)
_PARTING = re.compile(rf"{_QUOTED}|[,(\[{{]", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_OPEN = re.compile(r"\s*\(")
_DECORATOR = re.compile(rf"\s*@{NAME}(?:\.{NAME})*")
_MEMBER = re.compile(rf"\s*(?:(?:export|default|abstract|public|private|protected|static|readonly|async|override|declare)\s+)*(class\s+)?(#?{NAME})")
_CLASS = re.compile(rf"\bclass\s+({NAME})(?:\s*<[^{{]*?>)?(?:\s+extends\s+([\w$.]+)(?:\s*<[^{{]*?>)?)?[^{{;]*\{{")
_CONST = re.compile(rf"\bconst\s+({NAME})\s*(?::[^=;]+)?=\s*")
_ENUM = re.compile(rf"\benum\s+({NAME})\s*\{{")
_STATIC = re.compile(rf"\bstatic\s+(?:readonly\s+)?({NAME})\s*=\s*")
_NUMBER = re.compile(r"-?\d+(\.\d+)?")


@lru_cache(maxsize=512)
def _seeker(words: str) -> re.Pattern:
    return re.compile(words)


def seek(words: str, pattern: re.Pattern, text: str, at: int = 0) -> Iterator[re.Match]:
    """The pattern's matches, as ``finditer`` gives them, where each begins with one of the words: plain words are found much faster."""
    word = _seeker(words)
    while begins := word.search(text, at):
        if m := pattern.match(text, begins.start()):
            yield m
            at = m.end()
        else:
            at = begins.start() + 1


def strip_comments(text: str) -> str:
    """Comments become blanks; line ends, strings and templates stay where they are."""
    def blank(m: re.Match) -> str:
        return m[0] if m[0][0] != "/" else "\n".join(" " * len(line) for line in m[0].split("\n"))

    return _COMMENT.sub(blank, text) if "//" in text or "/*" in text else text


def balanced(text: str, at: int) -> int:
    """End of the bracket that opens at ``at``, one past its partner; the text's end if there is none."""
    depth: list[str] = []
    for m in _BRACKET.finditer(text, at):
        c = m[0]
        if c in _PAIRS:
            depth.append(_PAIRS[c])
        elif depth and c == depth[-1]:
            depth.pop()
            if not depth:
                return m.end()
    return len(text)


def split_args(text: str) -> list[str]:
    """Arguments parted by commas outside brackets and strings."""
    out, start, i = [], 0, 0
    while m := _PARTING.search(text, i):
        i = m.end()
        if m[0] == ",":
            out.append(text[start : m.start()].strip())
            start = i
        elif m[0] in _PAIRS:
            i = balanced(text, m.start())
    rest = text[start:].strip()
    return [*out, rest] if rest or out else []


@dataclass
class Call:
    name: str
    args: list[str]
    start: int
    end: int


@lru_cache(maxsize=512)
def _callee(name: str) -> re.Pattern:
    return re.compile(rf"(?<![\w$.])({name})\s*(?:<[^;(){{}}]*?>)?\s*\(")


def calls(text: str, name: str, words: str | None = None) -> Iterator[Call]:
    """Calls whose callee fits the pattern; type arguments are skipped. ``words``: what every such callee begins with, if that is known."""
    for m in seek(words, _callee(name), text) if words else _callee(name).finditer(text):
        open_ = m.end() - 1
        end = balanced(text, open_)
        yield Call(m[1], split_args(text[open_ + 1 : end - 1]), m.start(), end)


@lru_cache(maxsize=512)
def _decorator(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"@({'|'.join(map(re.escape, names))})\b")


def decorators(text: str, *names: str) -> Iterator[Call]:
    """Decorators of these names, ``end`` after their arguments."""
    for m in _decorator(names).finditer(text):
        rest = _OPEN.match(text, m.end())
        end = balanced(text, rest.end() - 1) if rest else m.end()
        yield Call(m[1], split_args(text[rest.end() : end - 1]) if rest else [], m.start(), end)


def following(text: str, at: int) -> re.Match | None:
    """The member or class that a decorator stands before: further decorators and modifiers are passed."""
    while m := _DECORATOR.match(text, at):
        at = m.end()
        if rest := _OPEN.match(text, at):
            at = balanced(text, rest.end() - 1)
    return _MEMBER.match(text, at)


@lru_cache(maxsize=4)
def classes(text: str) -> tuple[tuple[str, str | None, int, int], ...]:
    """(name, base, start, end) of every class. The last texts' are kept, as scanners ask for them once a site."""
    return tuple((m[1], m[2], m.start(), balanced(text, m.end() - 1)) for m in seek("class", _CLASS, text))


def class_at(found: tuple, at: int) -> str | None:
    inside = [c for c in found if c[2] <= at < c[3]]
    return inside[-1][0] if inside else None


def place(text: str, at: int) -> tuple[int, int]:
    line = text.count("\n", 0, at) + 1
    return line, at - text.rfind("\n", 0, at)


@lru_cache(maxsize=4)
def line_starts(text: str) -> tuple[int, ...]:
    """Where each line begins."""
    return (0, *(m.end() for m in re.finditer("\n", text)))


def literal(text: str) -> str | None:
    """Value of a string literal or of a template without spans."""
    t = re.sub(r"\s+as\s+const$", "", text.strip())
    if re.fullmatch(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", t):
        return re.sub(r"\\(.)", r"\1", t[1:-1])
    if len(t) > 1 and t[0] == t[-1] == "`" and "${" not in t and "`" not in t[1:-1]:
        return t[1:-1]
    return None


def object_fields(text: str) -> dict[str, str]:
    """Top-level fields of an object literal."""
    t = text.strip()
    if not (t.startswith("{") and t.endswith("}")):
        return {}
    out = {}
    for part in split_args(t[1:-1]):
        if m := re.match(rf"(?:({NAME})|['\"]([^'\"]+)['\"])\s*:\s*(.+)$", part, re.S):
            out[m[1] or m[2]] = m[3].strip()
        elif re.fullmatch(NAME, part):
            out[part] = part
    return out


def array_items(text: str) -> list[str] | None:
    t = text.strip()
    return split_args(t[1:-1]) if t.startswith("[") and t.endswith("]") else None


def constants(text: str) -> dict[str, str]:
    """Values of constants by name: ``const A = 'x'``, members of constant objects and enums, static fields."""
    out: dict[str, str] = {}
    for m in seek("const", _CONST, text):
        at = m.end()
        if q := _STRING.match(text, at):
            if (v := literal(q[0])) is not None:
                out[m[1]] = v
        elif text.startswith("{", at):
            _object(out, m[1], text[at : balanced(text, at)])
        elif n := _NUMBER.match(text, at):
            out[m[1]] = n[0]
    for m in seek("enum", _ENUM, text):
        for part in split_args(text[m.end() : balanced(text, m.end() - 1) - 1]):
            if (e := re.match(rf"({NAME})\s*=\s*(.+)$", part, re.S)) and ((v := literal(e[2])) is not None or re.fullmatch(r"\d+", e[2])):
                out[f"{m[1]}.{e[1]}"] = e[2] if v is None else v
    for name, _, start, end in classes(text) if "static" in text else ():
        for m in _STATIC.finditer(text, start, end):
            if (q := _STRING.match(text, m.end())) and (v := literal(q[0])) is not None:
                out[f"{name}.{m[1]}"] = v
    return out


def _object(out: dict[str, str], name: str, text: str) -> None:
    for key, value in object_fields(text).items():
        if value.startswith("{"):
            _object(out, f"{name}.{key}", value)
        elif (v := literal(value)) is not None:
            out[f"{name}.{key}"] = v


def resolve(text: str, known: Mapping[str, str], depth: int = 6) -> tuple[str, str | None, list[str]]:
    """(kind, value, placeholders): literal, pattern (spans become ``*``), dynamic or unresolved."""
    t = re.sub(r"\s+as\s+[\w$.<>\[\]]+$", "", text.strip())
    if depth == 0 or not t:
        return "unresolved", None, []
    if (v := literal(t)) is not None:
        return "literal", v, []
    if t.startswith("`") and t.endswith("`"):
        holes: list[str] = []

        def fill(m: re.Match) -> str:
            kind, v, _ = resolve(m[1], known, depth - 1)
            if kind == "literal":
                return v
            holes.append(m[1].strip())
            return "*"

        value = re.sub(r"\$\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", fill, t[1:-1])
        return ("pattern" if holes else "literal"), value, holes
    if t.startswith("{"):
        fields = object_fields(t)
        return resolve(fields["cmd"] if "cmd" in fields else fields.get("pattern", ""), known, depth - 1)
    if m := re.match(r"(.+?)\?(.+):(.+)$", t, re.S):
        a, b = resolve(m[2], known, depth - 1), resolve(m[3], known, depth - 1)
        return a if a == b else ("unresolved", None, [])
    path = re.sub(r"\[['\"](.+?)['\"]\]", r".\1", t)
    if path in known:
        return "literal", known[path], []
    if re.fullmatch(NAME, t):
        return "dynamic", None, [f"param:{t}"]
    return "unresolved", None, []


Site = dict
STANDARD = {"send": "nats-request", "emit": "nats-publish", "publish": "nats-publish", "request": "nats-request"}


_CLIENT_TYPE = re.compile(r":\s*(?:ClientProxy|ClientNats|NatsConnection)\b")
_CLIENT = re.compile(rf"({NAME})\s*[?!]?\s*:")


def client_names(text: str) -> set[str]:
    """Fields and parameters typed as clients: each type's name is looked up, and what stands before it is read backwards."""
    out, last = set(), 0
    for m in _CLIENT_TYPE.finditer(text):
        at = len(text[last : m.start()].rstrip()) + last
        if at > last and text[at - 1] in "?!":
            at = len(text[last : at - 1].rstrip()) + last
        start = at
        while start > last and (text[start - 1] in "$_" or text[start - 1].isalnum()):
            start -= 1
        if found := _CLIENT.search(text, start, m.start() + 1):
            out.add(found[1])
            last = m.end()
    return out


def nats(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Calls on fields and parameters typed as clients, and handler decorators; a list of subjects gives a row each."""
    clients = client_names(text)
    own = classes(text)
    if clients:
        names = "|".join(map(re.escape, sorted(clients)))
        for c in calls(text, rf"(?:this\.)?(?:{names})\.(?:send|emit|publish|request)", rf"this\.|{names}"):
            method = c.name.rsplit(".", 1)[1]
            kind, value, holes = resolve(c.args[0] if c.args else "", known)
            yield {"role": "sender", "edge_kind": STANDARD[method], "subject_kind": kind, "subject": value, "placeholders": holes, "at": c.start, "via": c.name, "enclosing_class": class_at(own, c.start)}
    for d in decorators(text, "MessagePattern", "EventPattern"):
        for item in (array_items(d.args[0]) or [d.args[0]]) if d.args else []:
            kind, value, holes = resolve(item, known)
            yield {"role": "receiver", "edge_kind": "nats-reply" if d.name == "MessagePattern" else "nats-subscribe", "subject_kind": kind, "subject": value, "placeholders": holes, "at": d.start, "via": d.name, "enclosing_class": class_at(own, d.start)}


def wrappers(text: str) -> list[tuple[str, str, int]]:
    """(class, method, position) of methods that pass a parameter on as the subject."""
    out = []
    for name, _, start, end in classes(text):
        for m in re.finditer(rf"(?:^|[;}}\n])\s*(?:public\s+|async\s+)*({NAME})\s*(?:<[^(]*>)?\(([^)]*)\)[^{{;=]*\{{", text[start:end]):
            params = [re.match(rf"\s*({NAME})?", p)[1] for p in split_args(m[2])]
            body = text[start + m.end() - 1 : balanced(text, start + m.end() - 1)]
            for c in calls(body, r"this\.[\w$]+\.(?:send|emit|publish|request)"):
                if c.args and c.args[0] in params:
                    out.append((name, m[1], params.index(c.args[0])))
    return out


def wrapper_calls(file: str, text: str, known: dict[str, str], found: list[tuple[str, str, int]]) -> Iterator[Site]:
    """Second pass: calls of the wrappers found, on fields typed with their class."""
    for cls, method, position in found:
        fields = set(re.findall(rf"({NAME})\s*[?!]?\s*:\s*{re.escape(cls)}\b", text))
        if fields:
            for c in calls(text, rf"(?:this\.)?(?:{'|'.join(map(re.escape, sorted(fields)))})\.{re.escape(method)}"):
                kind, value, holes = resolve(c.args[position] if len(c.args) > position else "", known)
                yield {"role": "sender", "edge_kind": "nats-publish", "subject_kind": kind, "subject": value, "placeholders": holes, "at": c.start, "via": f"{cls}.{method}", "enclosing_class": class_at(classes(text), c.start)}


def rmq(file: str, text: str, known: dict[str, str], names: tuple[str, ...] = ("RabbitSubscribe", "RabbitRPC", "RmqHandler")) -> Iterator[Site]:
    for d in decorators(text, *names):
        fields = object_fields(d.args[0]) if d.args else {}
        _, value, _ = resolve(fields.get("routingKey") or (d.args[0] if d.args else ""), known)
        member = following(text, d.end)
        yield {"role": "receiver", "subject": value, "via": d.name, "detail": member[2] if member else None, "at": d.start, "enclosing_class": class_at(classes(text), d.start)}


def endpoints(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """HTTP handlers with their controller's prefix; of a list of paths the first."""
    found = classes(text)
    prefixes: dict[str, tuple[str, str | None]] = {}
    for d in decorators(text, "Controller"):
        cls = following(text, d.end)
        fields = object_fields(d.args[0]) if d.args else {}
        arg = fields.get("path", "''") if fields else (d.args[0] if d.args else "''")
        kind, value, _ = resolve((array_items(arg) or [arg])[0], known)
        if cls and cls[1]:
            prefixes[cls[2]] = (value if kind == "literal" else "<dynamic>", literal(fields.get("version", "")))
    for d in decorators(text, "Get", "Post", "Put", "Patch", "Delete", "All", "Options", "Head", "Sse"):
        cls, member = class_at(found, d.start), following(text, d.end)
        if cls not in prefixes:
            continue
        arg = d.args[0] if d.args else "''"
        kind, value, _ = resolve((array_items(arg) or [arg])[0] if arg else "''", known)
        parts = "/".join(x.strip("/") for x in (prefixes[cls][0], value if kind == "literal" else "<dynamic>") if x and x.strip("/"))
        tail = text[d.start : member.end() if member else d.end]
        code, version = re.search(r"@HttpCode\(\s*(\d+)", tail), re.search(r"@Version\(\s*['\"]([^'\"]+)", tail)
        yield {"method": "GET" if d.name == "Sse" else d.name.upper(), "pattern": "/" + parts, "controller": cls, "handler": member[2] if member else None, "version": version[1] if version else prefixes[cls][1], "status": int(code[1]) if code else None, "at": d.start, "enclosing_class": cls}


_ENV = re.compile(r"\bprocess\.env(?:\.([A-Za-z_]\w*)|\[['\"]([^'\"]+)['\"]\])")


def config(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    own = classes(text)
    for c in calls(text, r"(?:this\.)?[\w$]*[cC]onfig\w*\.(?:get|getOrThrow|getOrDefault)") if "onfig" in text else ():
        kind, value, _ = resolve(c.args[0] if c.args else "", known)
        yield {"key": value if kind == "literal" else None, "source": "config-service", "at": c.start, "enclosing_class": class_at(own, c.start)}
    for m in seek("process", _ENV, text):
        yield {"key": m[1] or m[2], "source": "env", "at": m.start(), "enclosing_class": class_at(own, m.start())}


def http(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    for c in calls(text, r"(?:this\.)?(?:httpService|http|axios)(?:\.(?:get|post|put|patch|delete|head|request|axiosRef\.\w+))?|fetch"):
        method = c.name.rsplit(".", 1)[1].upper() if "." in c.name.removeprefix("this.") else "GET"
        arg = c.args[0] if c.args else ""
        arg = object_fields(arg).get("url", arg)
        yield {"method": method, "api": c.name, "at": c.start} | resolve_url(arg, known)


def resolve_url(text: str, known: dict[str, str]) -> Site:
    """literal, pattern, env-ref (a setting, with what follows it) or unresolved."""
    t = text.strip()
    env = r"(?:process\.env\.(\w+)|(?:this\.)?\w*[cC]onfig\w*\.(?:get|getOrThrow|getOrDefault)(?:<[^>]*>)?\(\s*['\"](\w+)['\"][^)]*\))"
    for op in ("??", "||"):
        if op in t and not t.startswith("`"):
            left, right = t.split(op, 1)
            a = resolve_url(left, known)
            return a if a["url_kind"] != "unresolved" else resolve_url(right, known)
    if m := re.fullmatch(env, t):
        return {"url_kind": "env-ref", "url": None, "env_var": m[1] or m[2], "path_suffix": "", "has_param": False}
    if m := re.match(rf"`\$\{{{env}\}}(.*)`$", t, re.S):
        suffix = re.sub(r"\$\{[^}]*\}", "*", m[3])
        return {"url_kind": "env-ref", "url": None, "env_var": m[1] or m[2], "path_suffix": suffix, "has_param": "*" in suffix}
    kind, value, holes = resolve(t, known)
    return {"url_kind": kind if kind in ("literal", "pattern") else "unresolved", "url": value, "env_var": None, "path_suffix": None, "has_param": bool(holes)}


def imports(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Static, dynamic and require imports; ``pattern`` holds the kind of import."""
    for m in re.finditer(r"\b(import|export)\s+(type\s+)?(?:[\w$*{}\s,]+?\s+from\s+)?(['\"])([^'\"\n]+)\3", text):
        yield {"subject": m[4], "pattern": "static", "flag": bool(m[2]), "at": m.start()}
    for c in calls(text, "import|require"):
        v = literal(c.args[0]) if len(c.args) == 1 else None
        marker = v if v is not None else "<zero-args>" if not c.args else "<multi-args>" if len(c.args) > 1 and c.name == "require" else c.args[0][:80]
        yield {"subject": marker, "pattern": ("dynamic" if c.name == "import" else "require") + ("" if v is not None else "-non-literal"), "flag": False, "at": c.start}


def modules(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Entries of @Module fields: role is the field, method the kind of reference, subject its name."""
    for d in decorators(text, "Module"):
        cls = following(text, d.end)
        yield {"role": "module", "method": "module", "enclosing_class": cls[2] if cls else None, "at": d.start}
        for field in ("imports", "providers", "exports", "controllers"):
            value = object_fields(d.args[0]).get(field) if d.args else None
            if value is None:
                continue
            items = array_items(value)
            for item in items if items is not None else [""]:
                kind, name = _reference(re.sub(r"\s+as\s+\w+$", "", item), field)
                yield {"role": field, "method": kind, "subject": name, "enclosing_class": cls[2] if cls else None, "flag": items is None, "at": d.start}


def _reference(item: str, field: str) -> tuple[str, str | None]:
    if re.fullmatch(NAME, item):
        return "class", item
    if (v := literal(item)) is not None:
        return "token-ref", v
    if m := re.match(rf"({NAME})\.[\w$.]+\s*(?:<[^(]*>)?\(", item):
        return "dynamic", m[1]
    if m := re.fullmatch(rf"({NAME})(\.{NAME})+", item):
        return "class", item if field == "providers" else m[1]
    if m := re.match(rf"forwardRef\(\s*\(\)\s*=>\s*({NAME})", item):
        return "class", m[1]
    if item.startswith("{"):
        fields = object_fields(item)
        for use in ("useClass", "useExisting", "useValue", "useFactory"):
            if use in fields and "provide" in fields:
                return f"token-{use}", literal(fields["provide"]) or fields["provide"]
    return "unresolved", None


def provider_uses(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Constructor parameters: subject is the injected class or token."""
    for name, _, start, end in classes(text):
        if m := re.search(r"\bconstructor\s*\(", text[start:end]):
            at = start + m.end() - 1
            for p in split_args(text[at + 1 : balanced(text, at) - 1]):
                token = re.search(r"@Inject\(\s*([^)]+)\)", p)
                typed = re.search(rf":\s*({NAME})", p)
                if token or typed:
                    yield {"subject": (literal(token[1]) or token[1].strip()) if token else typed[1], "enclosing_class": name, "at": at}


def filter_chain(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Guards, interceptors and pipes of classes and methods: pattern is what they are attached to."""
    for d in decorators(text, "UseGuards", "UseInterceptors", "UsePipes"):
        target, cls = following(text, d.end), class_at(classes(text), d.start)
        attached = (target[2] if target[1] else f"{cls}.{target[2]}") if target else None
        for a in d.args:
            m = re.match(rf"(?:new\s+)?(?:{NAME}\.)*({NAME})", a)
            yield {"role": {"UseGuards": "guard", "UseInterceptors": "interceptor", "UsePipes": "pipe"}[d.name], "subject": m[1] if m else None, "pattern": attached, "at": d.start}


def snake(name: str) -> str:
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).lower()


def entities(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Entity classes: subject is the class, pattern its table, or null where the name isn't fixed."""
    for d in decorators(text, "Entity"):
        cls = following(text, d.end)
        arg = d.args[0] if d.args else ""
        fields = object_fields(arg)
        name = fields.get("name", "") if fields or arg.startswith("{") else arg
        kind, value, _ = resolve(name, known) if name else ("literal", snake(cls[2]) if cls else None, [])
        schema = literal(fields.get("schema", ""))
        yield {"subject": cls[2] if cls else None, "pattern": f"{schema}.{value}" if schema and value else value if kind == "literal" else None, "at": d.start}


def repositories(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    for d in decorators(text, "InjectRepository"):
        member = following(text, d.end)
        yield {"subject": d.args[0] if d.args else None, "detail": member[2] if member else None, "enclosing_class": class_at(classes(text), d.start), "at": d.start}


def relations(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    for d in decorators(text, "ManyToOne", "OneToMany", "ManyToMany", "OneToOne"):
        m = re.match(rf"(?:\(?\w*\)?\s*=>\s*)?(?:forwardRef\(\s*\(\)\s*=>\s*)?(?:({NAME})|['\"]({NAME})['\"])", d.args[0]) if d.args else None
        member = following(text, d.end)
        between = text[d.end : member.end() if member else d.end]
        joined = re.search(r"@JoinTable\(\s*(?:\{\s*name:\s*['\"]([^'\"]+))?", between)
        yield {"role": d.name, "subject": (m[1] or m[2]) if m else None, "detail": member[2] if member else None, "enclosing_class": class_at(classes(text), d.start), "flag": "@JoinColumn" in between, "pattern": (joined[1] or "") if joined else None, "at": d.start}


def columns(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Entity columns: detail the field, pattern its type, flag whether it may be null."""
    names = ("Column", "PrimaryColumn", "PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn")
    for d in decorators(text, *names):
        member = following(text, d.end)
        fields = next((f for a in d.args if (f := object_fields(a))), {})
        typed = re.compile(r"\s*[?!]?\s*:\s*([\w$.<>\[\]| ]+)").match(text, member.end()) if member else None
        fixed = "timestamp" if d.name.endswith("DateColumn") else "int" if d.name == "PrimaryGeneratedColumn" and not d.args else None
        kind = fixed or (literal(d.args[0]) if d.args else None) or literal(fields.get("type", "")) or (typed[1].strip() if typed else None)
        yield {"detail": member[2] if member else None, "pattern": kind, "flag": fields.get("nullable") == "true", "enclosing_class": class_at(classes(text), d.start), "at": d.start}


EVENTS = ("completed", "failed", "progress", "active", "waiting", "stalled", "delayed", "drained", "paused", "error")


def queues(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Producers, consumers, registrations, listeners, repeats and dead letters: subject is the queue."""

    def queue(arg: str) -> str | None:
        fields = object_fields(arg)
        kind, value, _ = resolve(fields.get("name", "") if fields else arg, known)
        return value if kind == "literal" else None

    fields: dict[str, str | None] = {}
    for d in decorators(text, "InjectQueue"):
        member = following(text, d.end)
        name = queue(d.args[0]) if d.args else None
        if member:
            fields[member[2]] = name
        yield {"role": "produce", "subject": name, "at": d.start}
    consumed = []
    for d in decorators(text, "Processor"):
        name = queue(d.args[0]) if d.args else None
        consumed.append(name)
        at = next((re.search(r"concurrency:\s*(\d+)", a) for a in d.args if "concurrency" in a), None)
        yield {"role": "consume", "subject": name, "number": int(at[1]) if at else None, "at": d.start}
    for c in calls(text, r"BullModule\.registerQueue(?:Async)?"):
        for a in c.args:
            options = object_fields(object_fields(a).get("defaultJobOptions", ""))
            number = object_fields(a).get("concurrency", "")
            yield {"role": "register", "subject": queue(a), "number": int(number) if number.isdigit() else None, "detail": ",".join(f"{k}={options[k][:120]}" for k in ("delay", "attempts", "backoff") if k in options), "flag": "repeat" in options, "at": c.start}
    catches = [(m.start(), balanced(text, m.end() - 1)) for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*\{", text)]
    for c in calls(text, rf"(?:this\.)?{NAME}\.(?:on|add)"):
        receiver, method = c.name.removeprefix("this.").rsplit(".", 1)
        if method == "on" and c.args and literal(c.args[0]) in EVENTS:
            yield {"role": "listen", "subject": fields.get(receiver), "pattern": literal(c.args[0]), "at": c.start}
        if method == "add" and receiver in fields:
            repeat = object_fields(object_fields(c.args[2]).get("repeat", "")) if len(c.args) > 2 else {}
            if repeat:
                yield {"role": "repeat", "subject": fields[receiver], "pattern": literal(repeat.get("cron", repeat.get("pattern", ""))), "at": c.start}
            if consumed and any(a <= c.start < b for a, b in catches):
                yield {"role": "fails-into", "subject": consumed[0], "detail": fields[receiver], "at": c.start}


# Named schedules.
CRON = {
    "EVERY_SECOND": ("* * * * * *", "every second"), "EVERY_5_SECONDS": ("*/5 * * * * *", "every 5 seconds"), "EVERY_10_SECONDS": ("*/10 * * * * *", "every 10 seconds"), "EVERY_30_SECONDS": ("*/30 * * * * *", "every 30 seconds"),
    "EVERY_MINUTE": ("*/1 * * * *", "every minute"), "EVERY_5_MINUTES": ("0 */5 * * * *", "every 5 minutes"), "EVERY_10_MINUTES": ("0 */10 * * * *", "every 10 minutes"), "EVERY_30_MINUTES": ("0 */30 * * * *", "every 30 minutes"),
    "EVERY_HOUR": ("0 0-23/1 * * *", "every hour"), "EVERY_2_HOURS": ("0 0-23/2 * * *", "every 2 hours"), "EVERY_6_HOURS": ("0 0-23/6 * * *", "every 6 hours"), "EVERY_12_HOURS": ("0 0-23/12 * * *", "every 12 hours"),
    "EVERY_DAY_AT_MIDNIGHT": ("0 0 * * *", "every day at midnight"), "EVERY_DAY_AT_1AM": ("0 01 * * *", "every day at 1 am"), "EVERY_DAY_AT_NOON": ("0 12 * * *", "every day at noon"), "EVERY_WEEK": ("0 0 * * 0", "every week"),
    "EVERY_WEEKDAY": ("0 0 * * 1-5", "every weekday"), "EVERY_WEEKEND": ("0 0 * * 6,0", "every weekend"), "EVERY_1ST_DAY_OF_MONTH_AT_MIDNIGHT": ("0 0 1 * *", "the first day of a month at midnight"), "EVERY_QUARTER": ("0 0 1 */3 *", "every quarter"), "EVERY_YEAR": ("0 0 1 0 *", "every year"),
}


def schedules(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Cron, interval and timeout sites: role the category, subject the expression, or null where it isn't fixed."""
    for d in decorators(text, "Cron", "Interval", "Timeout"):
        member, cls = following(text, d.end), class_at(classes(text), d.start)
        value = label = name = None
        if d.name == "Cron" and d.args:
            value = literal(d.args[0])
            if value is None:
                value, label = CRON.get(d.args[0].rsplit(".", 1)[-1], (None, None))
            name = literal(object_fields(d.args[1]).get("name", "")) if len(d.args) > 1 else None
        elif d.args:
            if len(d.args) > 1:
                name = literal(d.args[0])
            value = d.args[-1] if re.fullmatch(r"[\d_]+", d.args[-1]) else None
        yield {"role": d.name.lower(), "subject": value, "pattern": label, "detail": name or (member[2] if member else None), "enclosing_class": cls, "flag": False, "at": d.start}
    for c in calls(text, rf"(?:this\.)?(?:{NAME}\.)?(?:addCronJob|addInterval|addTimeout)"):
        if re.search(r"schedul|registry", c.name, re.I):
            yield {"role": {"addCronJob": "cron", "addInterval": "interval", "addTimeout": "timeout"}[c.name.rsplit(".", 1)[-1]], "subject": literal(c.args[0]) if c.args else None, "detail": literal(c.args[0]) if c.args else None, "flag": True, "enclosing_class": class_at(classes(text), c.start), "at": c.start}


def front(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Components, hooks, and what components render; a name's first definition in a file counts."""
    seen: set[tuple[str, str]] = set()
    bodies: list[tuple[str, str, int, int]] = []
    for m in re.finditer(rf"\bfunction\s+({NAME})\s*(?:<[^(]*>)?\(|\b(?:const|let)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:(?:React\.)?(memo|forwardRef)\b|(?:async\s*)?(?:\(|{NAME}\s*=>))", text):
        name = m[1] or m[2]
        brace = text.find("{", balanced(text, m.end() - 1) if text[m.end() - 1] == "(" else m.end())
        end = balanced(text, brace) if brace >= 0 else len(text)
        stop = text.find("\n\n", m.end())
        end = max(end, stop if stop > 0 and brace < 0 else 0)
        bodies.append((name, m[3] or "", m.start(), end))
    for name, base, start, end in classes(text):
        if base and base.rsplit(".", 1)[-1] in ("Component", "PureComponent"):
            bodies.append((name, "class", start, end))
    for name, how, start, end in sorted(bodies, key=lambda b: b[2]):
        body = text[start:end]
        jsx = re.search(r"<(?:[A-Za-z][\w.]*[\s/>]|>)", body[1:]) is not None
        if name[0].isupper() and (how or (jsx and file.endswith(("x", ".js")))):
            kind = "component"
        elif re.match(r"use[A-Z]", name) and re.search(r"\buse[A-Z]\w*\s*\(", body[body.find("(") + 1 :]):
            kind = "hook"
        else:
            continue
        if (kind, name) in seen:
            continue
        seen.add((kind, name))
        yield {"role": kind, "subject": name, "at": start}
        if kind == "component":
            for tag in dict.fromkeys(re.findall(r"<([A-Z][\w]*)[\s/>]", body)):
                yield {"role": "renders", "subject": tag, "detail": name, "at": start}


def router_routes(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    if re.search(r"import\s*\{[^}]*\bRoute\b[^}]*\}\s*from\s*['\"]react-router-dom['\"]", text):
        for m in re.finditer(r"<Route\b[^>]*?\bpath=(?:\{([^}]+)\}|(['\"][^'\"]*['\"]))", text):
            kind, value, _ = resolve(m[1] or m[2], known)
            if kind == "literal":
                yield {"subject": value if value.startswith("/") else f"/{value}", "at": m.start()}


def strings(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Keys of localised texts: detail the candidates in order, namespaces first."""
    if not re.search(r"next-intl|react-i18next|i18next", text):
        return
    bound = re.findall(rf"(?:const\s+(?:\{{\s*({NAME})[^}}]*\}}|({NAME}))\s*=\s*)(?:await\s+)?(?:useTranslations?|getTranslations)\(\s*(?:['\"]([^'\"]+)['\"])?", text)
    spaces = [ns for *_, ns in bound if ns]
    for t in dict.fromkeys([a or b for a, b, _ in bound] or ["t"]):
        for c in calls(text, re.escape(t)):
            if c.args and (v := literal(c.args[0])) is not None:
                yield {"subject": v, "placeholders": [f"{ns}.{v}" for ns in spaces] + [v], "at": c.start}


_OWN = re.compile(rf"((?:\s|@{NAME}(?:\([^)]*\))?)*)((?:(?:public|private|protected|static|readonly|async|override|abstract|declare)\s+)*)(\*?#?{NAME})\s*([?!]?)\s*(?:<[^(;{{]*>)?\s*([(:=;])")
_RESULT = re.compile(r"\s*(?::(?:[^{};]|\{[^{}]*\}(?=\s*[{\[|&]))*)?")
_TOP = re.compile(rf"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+({NAME})|(?:const)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=\n]+)?=>|(interface|type)\s+({NAME}))")
_FIELD_PART = re.compile(r"[;\n(\[{]")


def symbols(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Classes, members, functions, arrow constants, interfaces and types: role the kind, subject the full name, detail the signature."""
    for name, base, start, end in classes(text):
        before = text[max(0, start - 400) : start]
        kind = "dto" if name.endswith(("Dto", "DTO")) else "db-entity" if name.endswith("Entity") or re.search(r"@Entity\b[^;}]*$", before) else "class"
        yield {"role": kind, "subject": name, "detail": base, "at": start, "number": text.count("\n", 0, end) + 1}
        body_at = text.find("{", start) + 1
        i = body_at
        while i < end - 1:
            if d := _DECORATOR.match(text, i):  # its arguments may hold parentheses of their own
                i = balanced(text, d.end()) if text[d.end() : d.end() + 1] == "(" else d.end()
                continue
            m = _OWN.match(text, i)
            if not m:
                i = balanced(text, i) if text[i] in "([{" else q.end() if (q := _STRING.match(text, i)) else i + 1
                continue
            if m[5] == "(":
                close = balanced(text, m.end() - 1)
                brace = _RESULT.match(text, close).end()
                stop = balanced(text, brace) if brace < end and text[brace] == "{" else brace + 1
                yield {"role": "method", "subject": f"{name}.{m[3]}", "detail": re.sub(r"\s+", " ", text[m.start(3) : close]), "pattern": name, "flag": "async" in m[2], "at": m.start(3), "number": text.count("\n", 0, stop) + 1}
                i = stop
            else:
                stop = m.end()
                while stop < end - 1:
                    part = _FIELD_PART.search(text, stop, end - 1)
                    stop = part.start() if part else end - 1
                    if not part or part[0] in ";\n":
                        break
                    stop = balanced(text, stop)
                yield {"role": "field", "subject": f"{name}.{m[3]}", "detail": re.sub(r"\s+", " ", text[m.start(3) : stop]), "pattern": name, "at": m.start(3), "number": text.count("\n", 0, stop) + 1}
                i = stop + 1
    for m in _TOP.finditer(text):
        kind = m[3] or "function"
        yield {"role": kind, "subject": m[1] or m[2] or m[4], "detail": re.sub(r"\s+", " ", m[0]), "at": m.start(), "number": place(text, m.end())[0]}


# A name is taken whole, and from where it begins: what follows it can't be a part of it.
_WHOLE = r"[A-Za-z_$][\w$]*+"
_GUARD = re.compile(r"\bif\s*\(((?:[^()]|\([^()]*\))*)\)\s*\{")
_CALLED = re.compile(rf"(?:(?<![A-Za-z_$])(?:new\s+)?|new\s+)((?:this|super|{_WHOLE})(?:\??\.{_WHOLE})*)\s*(?:<[^;(){{}}]*?>)?\(")


def code_calls(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Calls inside members with their place in order and the conditions around them: subject the callee, detail the caller."""
    own = [s for s in symbols(file, text, known) if s["role"] in ("method", "function")]
    lines = line_starts(text)
    for s in own:
        stop = lines[s["number"]] if s["number"] < len(lines) else len(text)
        body = text[s["at"] : stop]
        guards = [(m.start(), balanced(body, m.end() - 1), m[1].strip()) for m in seek("if", _GUARD, body)]
        head = balanced(body, body.find("(")) if "(" in body else 0
        order = 0
        for m in _CALLED.finditer(body[head:]):
            at = head + m.start()
            callee = m[1].replace("?.", ".")
            if callee in ("if", "for", "while", "switch", "catch", "return", "function", "super"):
                continue
            order += 1
            inside = [g for a, b, g in guards if a <= at < b]
            open_ = head + m.end() - 1
            yield {"role": "super-call" if callee.startswith("super.") else "call", "subject": callee, "detail": s["subject"], "number": order, "placeholders": inside, "pattern": body[open_ : balanced(body, open_)][:200], "at": s["at"] + at}


_BRANCH = re.compile(r"\b(if)\s*\(|\b(else)\b(?!\s*if)|\b(case\s+[^:\n]+|default)\s*:|\b(throw|return)\b|\b(catch)\b")
_AFTER = re.compile(r"\s*(?:\{\s*)?([^;}\n]*)")


def code_branches(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Branches and exits: role if, else, case, throw, return or catch; subject the condition, detail the function, pattern what follows."""
    own = [(s["subject"], s["at"], s["number"]) for s in symbols(file, text, known) if s["role"] in ("method", "function")]
    lines = line_starts(text)
    after = lambda at, end: max(bisect_right(lines, at), end)
    spans = [(name, at, lines[n] if (n := after(at, end)) < len(lines) else len(text) + 1) for name, at, end in own]
    for m in seek("if|else|case|default|throw|return|catch", _BRANCH, text):
        inside = [n for n, a, b in spans if a <= m.start() < b]
        if not inside:
            continue
        role = m[1] or m[2] or ("case" if m[3] else None) or m[4] or m[5]
        end = balanced(text, m.end() - 1) if m[1] else m.end()
        condition = text[m.end() : end - 1].strip() if m[1] else (m[3] or "")
        then = _AFTER.match(text, end)
        yield {"role": role, "subject": condition, "detail": inside[-1], "pattern": (f"{role} {then[1]}" if role in ("throw", "return") else then[1]).strip()[:200], "at": m.start()}


def scoped(file: str, text: str, known: dict[str, str]) -> Iterator[Site]:
    """Scoped markers: a domain without sites so far."""
    return iter(())


DOMAINS: dict[str, Callable] = {
    "nats": nats, "rmq": rmq, "endpoint": endpoints, "config": config, "http": http, "imports": imports, "di-modules": modules, "di-uses": provider_uses, "di-chain": filter_chain,
    "entities": entities, "repositories": repositories, "relations": relations, "columns": columns, "queues": queues, "schedules": schedules, "front": front, "routes": router_routes,
    "strings": strings, "symbols": symbols, "calls": code_calls, "branches": code_branches, "scoped": scoped,
}
_TEXT = ("role", "edge_kind", "subject_kind", "subject", "via", "enclosing_class", "method", "pattern", "controller", "handler", "version", "key", "source", "api", "url_kind", "url", "env_var", "path_suffix", "detail")
COLUMNS = [*_TEXT, "placeholders", "status", "number", "has_param", "flag"]
SITES = "domain string, file string, line int, column int, ord long, " + ", ".join(f"{c} string" for c in _TEXT) + ", placeholders array<string>, status int, number int, has_param boolean, flag boolean, error string"


def found_sites(file: str, text: str, domains: list[str], known: Mapping[str, str]) -> Iterator[tuple[str, int | None, int | None, int | None, Site, str | None]]:
    """(domain, line, column, ord, site, error) of one file in order of place; an error becomes a row of its own."""
    clean = strip_comments(text)
    lines = line_starts(clean)
    own: ChainMap | None = None
    for domain in domains:
        try:
            if own is None:
                own = ChainMap(constants(clean), known)
            found = sorted(DOMAINS[domain](file, clean, own), key=lambda s: s["at"])
        except Exception as e:  # a file that the scanner can't take is reported, and the others go on
            yield domain, None, None, None, {}, f"{type(e).__name__}: {e}"
            continue
        for n, s in enumerate(found):
            line = bisect_right(lines, s["at"])
            yield domain, line, s["at"] - lines[line - 1] + 1, n, s, None


def scan(file: str, text: str, domains: list[str], known: Mapping[str, str]) -> Iterator[dict]:
    """Sites of one file as rows."""
    for domain, line, column, n, s, error in found_sites(file, text, domains, known):
        if error is not None:
            yield {"domain": domain, "file": file, "error": error}
        else:
            yield {"domain": domain, "file": file, "line": line, "column": column, "ord": n} | {c: s.get(c) for c in COLUMNS}


def constant_index(files: DataFrame) -> DataFrame:
    """(name, value) of constants over all files; of a name the value in the first file counts."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, k, v) for f, t in zip(batch["file"], batch["text"], strict=True) for k, v in constants(strip_comments(t or "")).items()], columns=["file", "name", "value"])

    rows = files.select("file", "text").mapInPandas(run, "file string, name string, value string")
    return rows.groupBy("name").agg(F.min_by("value", "file").alias("value"))


#: Constants that are sent to every task; more of them are joined with the names that a file uses.
MOST_CONSTANTS = 200_000


def known_names(files: DataFrame, shared: DataFrame) -> DataFrame:
    """(file, text, known): the shared constants whose names stand in the text, as a map."""
    from pyspark.sql import functions as F

    dotted = F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"), F.lit(0))
    used = files.select("file", F.explode(F.array_distinct(F.flatten(F.transform(dotted, lambda d: F.concat(F.array(d), F.split(d, r"\.")))))).alias("name")).distinct()
    own = used.join(shared, "name").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))
    return files.select("file", "text").join(own, "file", "left")


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Sites that a task holds before it hands them on.
SITES_A_BATCH = 20_000


def extract(files: DataFrame, domains: list[str], shared: DataFrame | None = None) -> DataFrame:
    """Sites of (file, text) in the domains given; ``shared`` constants are known in every file."""
    known: dict[str, str] = {}
    files = files.select("file", "text")
    if shared is not None:
        rows = shared.limit(MOST_CONSTANTS + 1).collect()
        if len(rows) <= MOST_CONSTANTS:
            known = {r["name"]: r["value"] for r in rows}
        else:
            files = known_names(files, shared)
    types = [(c, _ARROW[t]) for c, t in (x.split(" ") for x in SITES.split(", "))]
    of_site = [(i, c) for i, (c, _) in enumerate(types) if c in COLUMNS]
    place_at = [[c for c, _ in types].index(c) for c in ("domain", "file", "line", "column", "ord", "error")]

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(v), t) if v.count(None) == len(v) else pa.array(v, t) for v, (_, t) in zip(columns, types, strict=True)], names=[c for c, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in types]
        site_columns = [(out[i].append, c) for i, c in of_site]
        domain_, file_, line_, column_, ord_, error_ = [out[i].append for i in place_at]
        for batch in batches:
            held = {c: batch.column(c) for c in batch.schema.names}
            for n in range(batch.num_rows):
                file, text = held["file"][n].as_py(), held["text"][n].as_py() or ""
                own = known if "known" not in held else dict(held["known"][n].as_py() or ())
                for domain, line, column, ord_of, site, error in found_sites(file, text, domains, own):
                    domain_(domain), file_(file), line_(line), column_(column), ord_(ord_of), error_(error)
                    get = site.get
                    for add, c in site_columns:
                        add(get(c))
                if len(out[0]) >= SITES_A_BATCH:
                    yield made(out)
                    for values in out:
                        values.clear()
        if out[0]:
            yield made(out)

    return files.mapInArrow(run, SITES)
