"""A compiler for a small, sandboxed template language.

``{{ expression }}`` prints, ``{% for %}``, ``{% if %}``, ``{% set %}`` control, and
``{% generation %} ... {% endgeneration %}`` marks what a model is to learn. Source is
parsed into a syntax tree, constant parts are folded, and the tree becomes Python closures.
Running a template yields pieces of output one after the other; a loop draws from its
iterator one element ahead of what it prints, so a conversation of any length is never held.

Expressions reach keys of dictionaries, literals, operators and the filters given to the
compiler, and nothing else: no attributes of Python objects, no calls.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

START, END = object(), object()  # what stands around marked output


class TemplateError(ValueError):
    """Source that can't be parsed, or a name that isn't there."""


# ---------------------------------------------------------------- syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: Any
    key: Any


@dataclass
class Unary:
    op: str
    of: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Defined:
    name: str
    wanted: bool


@dataclass
class Print:
    of: Any


@dataclass
class Set:
    name: str
    of: Any


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class If:
    branches: list  # (condition, body)
    otherwise: list = field(default_factory=list)


@dataclass
class Mark:
    body: list


# ---------------------------------------------------------------- parsing

_PART = re.compile(r"\{\{-?(?P<print>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|<=|>=|[-+*%~<>|.()\[\],=]))"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = [("or",), ("and",), None, ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%")]


class _Expression:
    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        found = self.peek()
        if found[0] is None or value is not None and (found[1] != value or found[0] == "string") or kind is not None and found[0] != kind:
            raise TemplateError(f"expected {value or kind or 'more'}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def has(self, *values: str) -> bool:
        kind, value = self.peek()
        return kind in ("op", "name") and value in values

    def whole(self):
        out = self.level(0)
        if self.peek()[0] is not None:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.unary()
        if _LEVELS[k] is None:
            if self.has("not"):
                self.take()
                return Unary("not", self.level(k))
            return self.level(k + 1)
        left = self.level(k + 1)
        while self.has(*_LEVELS[k]):
            op = self.take()
            left = Binary(op, left, self.level(k + 1))
        return left

    def unary(self):
        if self.has("-"):
            self.take()
            return Unary("-", self.unary())
        out = self.primary()
        while self.has(".", "[", "|", "is"):
            op = self.take()
            if op == ".":
                out = Key(out, Const(self.take(kind="name")))
            elif op == "[":
                out = Key(out, self.level(0))
                self.take("]")
            elif op == "|":
                out = Filter(self.take(kind="name"), out)
            else:
                wanted = not self.has("not")
                if not wanted:
                    self.take()
                self.take("defined")
                if not isinstance(out, Name):
                    raise TemplateError("only a name can be tested for being defined")
                out = Defined(out.name, wanted)
        return out

    def primary(self):
        kind, value = self.peek()
        if kind == "number":
            self.take()
            return Const(int(value))
        if kind == "string":
            self.take()
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "name":
            self.take()
            constant = {"true": True, "false": False, "none": None}
            return Const(constant[value.lower()]) if value.lower() in constant else Name(value)
        self.take("(")
        out = self.level(0)
        self.take(")")
        return out


class _Parser:
    def __init__(self, source: str):
        self.parts, at = [], 0
        for m in _PART.finditer(source):
            before = source[at : m.start()]
            self.parts.append(("text", before.rstrip() if m[0][2:3] == "-" else before))
            if m["print"] is not None:
                self.parts.append(("print", m["print"]))
            elif m["tag"] is not None:
                self.parts.append(("tag", m["tag"].strip()))
            at = m.end()
            if m[0][-3:-2] == "-":
                at += len(source[at:]) - len(source[at:].lstrip())
        self.parts.append(("text", source[at:]))
        self.at = 0

    def body(self, *until: str) -> tuple[list, str]:
        """Nodes up to a tag that begins with one of ``until``, and that tag."""
        out = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out += [Print(Const(value))] if value else []
            elif kind == "print":
                out.append(Print(_Expression(value).whole()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in until:
                    return out, value
                out.append(self.tag(word, value[len(word) :]))
        if until:
            raise TemplateError(f"missing {' or '.join(until)}")
        return out, ""

    def tag(self, word: str, rest: str):
        if word == "for":
            e = _Expression(rest)
            name = e.take(kind="name")
            e.take("in")
            over = e.whole()
            return For(name, over, self.body("endfor")[0])
        if word == "if":
            branches, condition = [], _Expression(rest).whole()
            while True:
                inner, end = self.body("elif", "else", "endif")
                branches.append((condition, inner))
                if end.startswith("elif"):
                    condition = _Expression(end[4:]).whole()
                elif end == "else":
                    return If(branches, self.body("endif")[0])
                else:
                    return If(branches)
        if word == "set":
            e = _Expression(rest)
            name = e.take(kind="name")
            e.take("=")
            return Set(name, e.whole())
        if word == "generation":
            return Mark(self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")


def parse(source: str) -> list:
    return _Parser(source).body()[0]


# ---------------------------------------------------------------- folding

_BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "in": lambda a, b: a in b, "+": operator.add, "-": operator.sub, "*": operator.mul, "~": lambda a, b: text_of(a) + text_of(b),
    "%": lambda a, b: a % b if not isinstance(a, str) else _no_format(),
}


def _no_format():
    raise TemplateError("% is for numbers")


def text_of(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """The same tree with constant expressions computed and adjacent texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in (fold(x, filters) for x in node):
            if isinstance(x, If) and x.branches and isinstance(x.branches[0][0], Const) and x.branches[0][0].value:
                out += x.branches[0][1]
            elif isinstance(x, If) and not x.branches:
                out += x.otherwise
            elif isinstance(x, Print) and isinstance(x.of, Const) and out and isinstance(out[-1], Print) and isinstance(out[-1].of, Const):
                out[-1] = Print(Const(text_of(out[-1].of.value) + text_of(x.of.value)))
            else:
                out.append(x)
        return out
    if isinstance(node, Print):
        return Print(fold(node.of, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Mark):
        return Mark(fold(node.body, filters))
    if isinstance(node, If):
        branches = [(fold(c, filters), fold(b, filters)) for c, b in node.branches]
        branches = [(c, b) for c, b in branches if not (isinstance(c, Const) and not c.value)]
        return If(branches, fold(node.otherwise, filters))
    if isinstance(node, Key):
        return Key(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Unary):
        of = fold(node.of, filters)
        return Const(not of.value if node.op == "not" else -of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if isinstance(left, Const):
            if node.op == "and":
                return right if left.value else left
            if node.op == "or":
                return left if left.value else right
            if isinstance(right, Const):
                return Const(_BINARY[node.op](left.value, right.value))
        # (a + "x") + "y" is a + "xy"; only for text, where + can't fail on either
        if node.op in "+~" and isinstance(right, Const) and isinstance(right.value, str) and isinstance(left, Binary) and left.op == node.op:
            if isinstance(left.right, Const) and isinstance(left.right.value, str):
                return Binary(node.op, left.left, Const(left.right.value + right.value))
        return Binary(node.op, left, right)
    return node


# ---------------------------------------------------------------- closures


def _lookup(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key]
    raise TemplateError(f"{key!r} can't be taken from it")


def expression(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            if name not in env:
                raise TemplateError(f"{name} is not defined")
            return env[name]

        return look
    if isinstance(node, Defined):
        return lambda env: (node.name in env) == node.wanted
    if isinstance(node, Key):
        of, key = expression(node.of, filters), expression(node.key, filters)
        return lambda env: _lookup(of(env), key(env))
    if isinstance(node, Filter):
        of, run = expression(node.of, filters), filters[node.name]
        return lambda env: run(of(env))
    if isinstance(node, Unary):
        of = expression(node.of, filters)
        return (lambda env: not of(env)) if node.op == "not" else (lambda env: -of(env))
    left, right = expression(node.left, filters), expression(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    run = _BINARY[node.op]
    return lambda env: run(left(env), right(env))


def statements(body: list, filters: dict[str, Callable]) -> Callable[[dict], Iterator]:
    made = [_statement(node, filters) for node in body]

    def run(env):
        for one in made:
            yield from one(env)

    return run


def _statement(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Iterator]:
    if isinstance(node, Print):
        of = expression(node.of, filters)

        def show(env):
            yield text_of(of(env))

        return show
    if isinstance(node, Set):
        of = expression(node.of, filters)

        def put(env):
            env[node.name] = of(env)
            yield from ()

        return put
    if isinstance(node, Mark):
        inner = statements(node.body, filters)

        def mark(env):
            yield START
            yield from inner(env)
            yield END

        return mark
    if isinstance(node, If):
        branches = [(expression(c, filters), statements(b, filters)) for c, b in node.branches]
        otherwise = statements(node.otherwise, filters)

        def choose(env):
            for condition, then in branches:
                if condition(env):
                    return then(env)
            return otherwise(env)

        return choose
    over, inner = expression(node.over, filters), statements(node.body, filters)

    def loop(env):
        own, last = dict(env), object()
        items = iter(over(env))
        now, index = next(items, last), 0
        while now is not last:
            after = next(items, last)
            own[node.name] = now
            own["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": after is last}
            yield from inner(own)
            now, index = after, index + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator]:
    """A function of named values that yields output, ``START`` and ``END``."""
    known = {"trim": lambda x: text_of(x).strip(), "upper": lambda x: text_of(x).upper(), "lower": lambda x: text_of(x).lower(), "length": len}
    known |= filters or {}
    run = statements(fold(parse(source), known), known)
    return lambda **values: run(dict(values))
