"""Queries written in HCL: a hand-written parser of the part of the language that queries use.

Attributes (name = value), blocks with labels, comments, strings with escapes and heredocs, numbers, booleans, null,
lists, objects, and the function timestamp(x), which is x.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from chronoweave.plans.spec import Op, QuerySpec, ReplaySpec, SpecError, TimeRange, instant_ns

TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<comment>\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<line>\n)
      |<<(?P<indent>-?)(?P<tag>\w+)\n(?P<here>.*?)\n[ \t]*(?P=tag)(?=\n|$)
      |(?P<string>"(?:\\.|[^"\\\n])*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w.-]*)|(?P<mark>[={}\[\](),:])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
#: File names that a directory of queries may have.
SUFFIXES = (".hcl", ".tf")


class HclError(SpecError):
    pass


def tokens(text: str) -> Iterator[tuple[str, Any, int]]:
    at, line = 0, 1
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise HclError(f"line {line}: unexpected {text[at]!r}")
        kind = m.lastgroup if m["here"] is None else "string"
        if m["here"] is not None:
            rows = m["here"].split("\n")
            cut = min((len(r) - len(r.lstrip()) for r in rows if r.strip()), default=0) if m["indent"] else 0
            yield "string", "\n".join(r[cut:] for r in rows) + "\n", line
        elif kind == "string":
            yield kind, re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else ESCAPES.get(e[1], e[0]), m[0][1:-1]), line
        elif kind == "number":
            yield kind, float(m[0]), line
        elif kind in ("name", "mark", "line"):
            yield kind, m[0], line
        line += m[0].count("\n")
        at = m.end()
    yield "end", "", line


class Body:
    """Attributes and blocks of one level."""

    def __init__(self):
        self.attributes: dict[str, Any] = {}
        self.blocks: list[tuple[str, list[str], Body]] = []

    def named(self, kind: str) -> list[Body]:
        return [b for k, _, b in self.blocks if k == kind]

    def only(self, attributes: tuple[str, ...], blocks: tuple[str, ...] = ()) -> Body:
        for name in self.attributes:
            if name not in attributes:
                raise HclError(f"unsupported argument {name!r}")
        for kind, *_ in self.blocks:
            if kind not in blocks:
                raise HclError(f"unsupported block {kind!r}")
        return self

    def text(self, name: str, required: bool = False) -> str:
        if name not in self.attributes:
            if required:
                raise HclError(f"missing argument {name!r}")
            return ""
        value = self.attributes[name]
        if not isinstance(value, str):
            raise HclError(f"{name!r} must be a string")
        return value


class Parser:
    def __init__(self, text: str):
        self.tokens = list(tokens(text))
        self.at = 0

    def peek(self) -> tuple[str, Any, int]:
        return self.tokens[self.at]

    def take(self, kind: str | None = None, value: Any = None) -> Any:
        k, v, line = self.tokens[self.at]
        if kind and k != kind or value is not None and v != value:
            raise HclError(f"line {line}: expected {value or kind}, found {v or k!r}")
        self.at += 1
        return v

    def lines(self) -> None:
        while self.peek()[0] == "line":
            self.at += 1

    def body(self, closed: bool = False) -> Body:
        out = Body()
        while True:
            self.lines()
            kind, value, line = self.peek()
            if kind == "end" and not closed or closed and value == "}":
                return out
            name = self.take("name")
            if self.peek()[1] == "=" and self.peek()[0] == "mark":
                self.take()
                if name in out.attributes:
                    raise HclError(f"line {line}: argument {name!r} was set before")
                out.attributes[name] = self.value()
                if self.peek()[0] not in ("line", "end") and self.peek()[1] != "}":
                    raise HclError(f"line {self.peek()[2]}: a new line must follow {name!r}")
            else:
                labels = []
                while self.peek()[0] in ("string", "name"):
                    labels.append(self.take())
                self.take("mark", "{")
                out.blocks.append((name, labels, self.body(closed=True)))
                self.take("mark", "}")

    def value(self) -> Any:
        kind, v, line = self.peek()
        self.at += 1
        if kind in ("string", "number"):
            return v
        if kind == "name" and v in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v]
        if kind == "name" and v == "timestamp" and self.peek()[1] == "(":
            self.take()
            inner = self.value()
            self.take("mark", ")")
            if not isinstance(inner, str):
                raise HclError(f"line {line}: timestamp needs a string")
            return inner
        if kind == "mark" and v == "[":
            return self.items("]", self.value)
        if kind == "mark" and v == "{":
            return dict(self.items("}", self.pair))
        raise HclError(f"line {line}: not a value: {v or kind!r}")

    def pair(self) -> tuple[str, Any]:
        kind, key, line = self.peek()
        if kind not in ("name", "string"):
            raise HclError(f"line {line}: not a key: {key!r}")
        self.at += 1
        if self.peek()[1] not in ("=", ":"):
            raise HclError(f"line {line}: a value must follow {key!r}")
        self.at += 1
        return key, self.value()

    def items(self, close: str, one) -> list:
        out = []
        while True:
            self.lines()
            if self.peek()[1] == close and self.peek()[0] == "mark":
                self.at += 1
                return out
            out.append(one())
            spaced = self.peek()[0] == "line" and close == "}"
            self.lines()
            if self.peek()[1] == "," and self.peek()[0] == "mark":
                self.at += 1
            elif not spaced and self.peek()[1] != close:
                raise HclError(f"line {self.peek()[2]}: expected ',' or {close!r}")


def parse(text: str) -> Body:
    return Parser(text).body()


OPERATION = ("id", "type", "source", "equals", "window", "params", "condition_all", "condition_any")


def operation(b: Body) -> Op:
    b.only(OPERATION, ("of",))
    lists = {}
    for name in ("condition_all", "condition_any"):
        lists[name] = b.attributes.get(name) or []
        if not isinstance(lists[name], list) or not all(isinstance(x, str) for x in lists[name]):
            raise HclError(f"{name!r} must be a list of strings")
    params = b.attributes.get("params") or {}
    if not isinstance(params, dict):
        raise HclError("'params' must be an object")
    nested = [n.only(("id", "type", "source")) for n in b.named("of")]
    of = Op(id=nested[0].text("id", True), op=nested[0].text("type", True), source=nested[0].text("source")) if nested else None
    return Op(b.text("id", True), b.text("type", True), b.text("source"), b.text("equals"), b.text("window"), of, tuple(lists["condition_all"]), tuple(lists["condition_any"]), params)


def query(b: Body) -> QuerySpec:
    b.only(("timeline_id", "filters"), ("time_range", "operation"))
    filters = b.attributes.get("filters") or {}
    if not isinstance(filters, dict):
        raise HclError("'filters' must be an object")
    spans = [t.only(("start", "end")) for t in b.named("time_range")]
    if len(spans) > 1:
        raise HclError("more than one time_range")
    span = TimeRange(spans[0].text("start", True), spans[0].text("end", True)) if spans else None
    if span:
        instant_ns(span.start), instant_ns(span.end)
    return QuerySpec(b.text("timeline_id", True), tuple(map(operation, b.named("operation"))), filters, span)


def parse_query(text: str) -> QuerySpec:
    return query(parse(text))


def parse_replay(text: str) -> ReplaySpec:
    b = parse(text).only(("timeline_id", "chunk_size"), ("query",))
    inner = b.named("query")
    if len(inner) != 1:
        raise HclError("a replay needs one query block")
    size = b.attributes.get("chunk_size") or 0
    if not isinstance(size, (int, float)) or isinstance(size, bool):
        raise HclError("'chunk_size' must be a number")
    return ReplaySpec(b.text("timeline_id", True), query(inner[0]), int(size))


def files(path: str | Path) -> list[Path]:
    """The query files at path: itself, or all below a directory, in the order of their names."""
    p = Path(path)
    if p.is_file():
        return [p]
    return sorted((f for f in p.rglob("*") if f.suffix in SUFFIXES and f.is_file()), key=lambda f: f.parts)


def merged(path: str | Path) -> str:
    """The texts of all files at path, one after the other: what is split over files reads as one query."""
    found = files(path)
    if not found:
        raise HclError(f"no HCL files at {path}")
    return "\n".join(f.read_text() for f in found)


def content_kind(text: str, header: str = "") -> str:
    """`hcl` or `json`: by the content type of a request, else by its first character, else by whether it parses as HCL."""
    named = header.split(";")[0].strip().lower()
    if named == "application/vnd.hcl":
        return "hcl"
    if named == "application/json":
        return "json"
    if text.lstrip()[:1] in ("{", "["):
        return "json"
    try:
        parse(text)
    except HclError:
        return "json"
    return "hcl" if text.strip() else "json"
