"""Chat formatting by a template compiler.

The language, a sandboxed subset of the usual chat templates: text; ``{{ expression }}``;
``{% set name = expression %}``; ``{% if %} {% elif %} {% else %} {% endif %}``;
``{% for name in expression %} ... {% endfor %}`` with ``loop.first``, ``loop.last``, ``loop.index``
and ``loop.index0``; ``{% generation %} ... {% endgeneration %}``, which marks the text under the
loss; ``{# comment #}``; ``-`` inside a tag trims the white space beside it. Expressions: strings,
integers, true, false, none, names, ``a.b``, ``a['b']``, ``+ ~ == != < <= > >= in and or not``,
parentheses, ``a if c else b`` and the filters below. There are no calls, no attributes of Python
objects (dots and brackets look up mapping keys only) and no other names than those passed in.

A template is parsed to a tree, constants are folded (operators and filters on literals, decided
branches, adjoining text), and the tree becomes nested Python closures. They yield fragments
(text, under_loss) from an iterator of messages with one message of look-ahead, so a conversation
of any number of turns streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Control strings of the default format; the back-slash escapes them and itself.
CONTROL = ("\\", "###", "</turn>")
_ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(" + "|".join(map(re.escape, CONTROL)) + "|n)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    """As ``escape``, and a line feed becomes a back-slash and an n."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)), "escape_line": lambda x: escape_line(_text(x)), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(), "capitalize": lambda x: _text(x).capitalize(), "title": lambda x: _text(x).title(), "length": len,
}

DEFAULT_TEMPLATE = (
    "{%- for message in messages -%}### {{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def _text(x) -> str:
    return "" if x is None else str(x)


# ---- tree

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Pick:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parser

_OPENING = re.compile(r"\{[{%#]")
# quoted text is read whole before a tag's own ending is looked for; a comment quotes nothing
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_REST = {kind: re.compile(rf"(-?)((?:{_QUOTED}|[^'\"])*?)(-?){end}", re.S) for kind, end in (("{", r"\}\}"), ("%", r"%\}"))} | {"#": re.compile(r"(-?)(.*?)(-?)#\}", re.S)}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one tag's text."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 2 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        value = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def choice(self):
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            self.need("else")
            return Pick(test, value, self.choice())
        return value

    _LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))

    def level(self, k: int):
        if k == len(self._LEVELS):
            return self.filtered()
        if k == 2:
            return Apply("not", (self.level(2),)) if self.take("not") else self.level(3)
        value = self.level(k + 1)
        while op := self.take(*self._LEVELS[k]):
            value = Apply(op, (value, self.level(k + 1)))
        return value

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
        else:
            if self.at >= len(self.tokens):
                raise TemplateError("an expression ends too soon")
            kind, token = self.tokens[self.at]
            self.at += 1
            if kind == 1:
                value = Const(int(token))
            elif kind == 2:
                value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
            elif kind == 3:
                value = {"true": Const(True), "false": Const(False), "none": Const(None)}.get(token.lower()) or Name(token)
            else:
                raise TemplateError(f"unexpected {token!r}")
        while op := self.take(".", "["):
            if op == ".":
                value = Item(value, Const(self.name()))
            else:
                value = Item(value, self.choice())
                self.need("]")
        return value


def parse(source: str) -> tuple:
    """The tree of a template: a tuple of statements."""
    pieces, at, trim = [], 0, False
    while opening := _OPENING.search(source, at):
        kind = opening[0][1]
        tag = _REST[kind].match(source, opening.end())
        if not tag:
            raise TemplateError(f"a tag does not close: {source[opening.start() : opening.start() + 20]!r}")
        plain = source[at : opening.start()]
        plain = plain.lstrip() if trim else plain
        pieces.append(("text", plain.rstrip() if tag[1] else plain))
        if kind != "#":
            pieces.append((kind, tag[2]))
        at, trim = tag.end(), bool(tag[3])
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    body, rest, end = _block(pieces, 0, ())
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _block(pieces: list, at: int, ends: tuple) -> tuple[tuple, int, str]:
    out = []
    while at < len(pieces):
        kind, source = pieces[at]
        at += 1
        if kind == "text":
            if source:
                out.append(Emit(Const(source)))
            continue
        if kind == "{":
            out.append(Emit(_Expression(source).whole()))
            continue
        word, _, rest = source.strip().partition(" ")
        if word in ends:
            return tuple(out), at, source.strip()
        if word == "set":
            e = _Expression(rest.replace("=", " == ", 1))
            name = e.name()
            e.need("==")
            out.append(Assign(name, e.whole()))
        elif word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            body, at, _ = _block(pieces, at, ("endfor",))
            out.append(Loop(name, over, body))
        elif word == "generation":
            body, at, _ = _block(pieces, at, ("endgeneration",))
            out.append(Generation(body))
        elif word == "if":
            branch, at = _branch(pieces, at, rest)
            out.append(branch)
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return tuple(out), at, ""


def _branch(pieces: list, at: int, test: str) -> tuple[Branch, int]:
    then, at, end = _block(pieces, at, ("elif", "else", "endif"))
    other: tuple = ()
    if end.startswith("elif"):
        nested, at = _branch(pieces, at, end[4:])
        other = (nested,)
    elif end == "else":
        other, at, _ = _block(pieces, at, ("endif",))
    return Branch(_Expression(test).whole(), then, other), at


# ---- folding

_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
} | {"|" + k: f for k, f in FILTERS.items()}


def fold_expression(e):
    if isinstance(e, Item):
        return Item(fold_expression(e.of), fold_expression(e.key))
    if isinstance(e, Pick):
        test, then, other = map(fold_expression, (e.test, e.then, e.other))
        return (then if test.value else other) if isinstance(test, Const) else Pick(test, then, other)
    if isinstance(e, Apply):
        args = tuple(map(fold_expression, e.args))
        return Const(_OPS[e.op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Apply(e.op, args)
    return e


def fold(body: tuple) -> tuple:
    out: list = []
    for s in body:
        if isinstance(s, Emit):
            s = Emit(fold_expression(s.value))
            if isinstance(s.value, Const):
                text = _text(s.value.value)
                if not text:
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                s = Emit(Const(text))
            out.append(s)
        elif isinstance(s, Branch):
            test = fold_expression(s.test)
            then, other = fold(s.then), fold(s.other)
            if isinstance(test, Const):
                out = list(fold((*out, *(then if test.value else other))))
            else:
                out.append(Branch(test, then, other))
        elif isinstance(s, Assign):
            out.append(Assign(s.name, fold_expression(s.value)))
        elif isinstance(s, Loop):
            out.append(Loop(s.name, fold_expression(s.over), fold(s.body)))
        else:
            out.append(Generation(fold(s.body)))
    return tuple(out)


# ---- closures

Scope = dict
Fragments = Iterator[tuple[str, bool]]


def _value(e) -> Callable[[Scope], object]:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):
        return lambda scope, n=e.name: scope.get(n)
    if isinstance(e, Item):
        of, key = _value(e.of), _value(e.key)

        def item(scope):
            box = of(scope)
            return box.get(key(scope)) if isinstance(box, dict) else None

        return item
    if isinstance(e, Pick):
        test, then, other = _value(e.test), _value(e.then), _value(e.other)
        return lambda scope: then(scope) if test(scope) else other(scope)
    args, op = tuple(map(_value, e.args)), _OPS[e.op]
    if e.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if len(args) == 1:
        return lambda scope: op(args[0](scope))
    return lambda scope: op(args[0](scope), args[1](scope))


def _closure(body: tuple) -> Callable[[Scope, bool], Fragments]:
    steps = tuple(map(_step, body))

    def run(scope: Scope, marked: bool) -> Fragments:
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(s) -> Callable[[Scope, bool], Fragments]:
    if isinstance(s, Emit):
        value = _value(s.value)

        def emit(scope, marked):
            yield _text(value(scope)), marked

        return emit
    if isinstance(s, Assign):
        value, name = _value(s.value), s.name

        def assign(scope, marked):
            scope[name] = value(scope)
            return iter(())

        return assign
    if isinstance(s, Branch):
        test, then, other = _value(s.test), _closure(s.then), _closure(s.other)
        return lambda scope, marked: then(scope, marked) if test(scope) else other(scope, marked)
    if isinstance(s, Generation):
        body = _closure(s.body)
        return lambda scope, marked: body(scope, True)
    over, body, name = _value(s.over), _closure(s.body), s.name

    def loop(scope, marked):
        items = iter(over(scope) or ())
        end = object()
        item, k = next(items, end), 0
        while item is not end:
            after = next(items, end)
            inner = scope | {name: item, "loop": {"first": k == 0, "last": after is end, "index0": k, "index": k + 1}}
            yield from body(inner, marked)
            item, k = after, k + 1

    return loop


def compile_template(source: str) -> Callable[[Scope], Fragments]:
    """A function from names to the fragments (text, under_loss) of the rendered template."""
    run = _closure(fold(parse(source)))
    return lambda names: run(dict(names), False)
