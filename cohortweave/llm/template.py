"""A small sandboxed template language compiled to Python closures.

Statements: {{ expression }}, {% for x in xs %}..{% endfor %}, {% if e %}..{% elif e %}..{% else %}..{% endif %},
{% generation %}..{% endgeneration %}. Expressions have strings, numbers, True, False, None, names, one-level
attributes (looked up in mappings only), +, ==, !=, in, not in, and, or, not, (..) and filters: x | name. Nothing else
parses: no calls, no subscripts, no names or attributes starting with an underscore.

compile_template() parses the text into a syntax tree, folds constants and returns a function that
yields (text, generated) pieces; loops take iterators, so a conversation need not fit in memory.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

MARK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
Piece = tuple[str, bool]
Filters = Mapping[str, Callable[[object], object]]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": lambda a: not a,
}
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.In: "in", ast.NotIn: "not in"}


def parse_expression(text: str, filters: Filters) -> object:
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"cannot parse {text!r}") from e

    def walk(n: ast.expr) -> object:
        if isinstance(n, ast.Constant) and isinstance(n.value, (str, int, float, bool, type(None))):
            return Const(n.value)
        if isinstance(n, ast.Name) and not n.id.startswith("_"):
            return Name(n.id)
        if isinstance(n, ast.Attribute) and not n.attr.startswith("_"):
            return Field(walk(n.value), n.attr)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            return Op("+", (walk(n.left), walk(n.right)))
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr) and isinstance(n.right, ast.Name) and n.right.id in filters:
            return Filter(walk(n.left), n.right.id)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARE:
            return Op(COMPARE[type(n.ops[0])], (walk(n.left), walk(n.comparators[0])))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return Op("not", (walk(n.operand),))
        if isinstance(n, ast.BoolOp):
            return Op("and" if isinstance(n.op, ast.And) else "or", tuple(walk(v) for v in n.values))
        raise TemplateError(f"{type(n).__name__} is not allowed in {text!r}")

    return walk(tree)


def parse(source: str, filters: Filters) -> tuple:
    """The template's syntax tree: a tuple of Out, For, If and Generation nodes."""
    parts = [p for p in MARK.split(source) if p]
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        body: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                body.append(Out(parse_expression(part[2:-2], filters)))
            elif part.startswith("{%") and part.endswith("%}"):
                said = part[2:-2].strip()
                word, _, rest = said.partition(" ")
                if word in ends:
                    return tuple(body), said
                body.append(statement(word, rest))
            else:
                body.append(Out(Const(part)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    def branch(test: str) -> If:
        then, end = block(("elif", "else", "endif"))
        if end == "else":
            other, _ = block(("endif",))
        else:
            other = (branch(end[4:]),) if end.startswith("elif") else ()
        return If(parse_expression(test, filters), then, other)

    def statement(word: str, rest: str) -> object:
        if word == "for":
            m = re.fullmatch(r"([a-zA-Z]\w*) in (.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot parse for {rest!r}")
            return For(m[1], parse_expression(m[2], filters), block(("endfor",))[0])
        if word == "if":
            return branch(rest)
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


def fold_expression(e: object, filters: Filters) -> object:
    if isinstance(e, Field):
        return Field(fold_expression(e.of, filters), e.name)
    if isinstance(e, Filter):
        of = fold_expression(e.of, filters)
        return Const(filters[e.name](of.value)) if isinstance(of, Const) else Filter(of, e.name)
    if isinstance(e, Op):
        args = [fold_expression(a, filters) for a in e.args]
        if e.kind in ("and", "or"):
            while len(args) > 1 and isinstance(args[0], Const):
                if bool(args[0].value) == (e.kind == "or"):
                    return args[0]
                args.pop(0)
            return args[0] if len(args) == 1 else Op(e.kind, tuple(args))
        if all(isinstance(a, Const) for a in args):
            return Const(OPS[e.kind](*(a.value for a in args)))
        return Op(e.kind, tuple(args))
    return e


def fold(body: tuple, filters: Filters) -> tuple:
    """Evaluate constant expressions, drop branches that cannot be taken, join neighbouring text."""
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Out) and isinstance(node.value, Const):
            text = shown(node.value.value)
            if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Out(Const(text)))
        else:
            out.append(node)

    for n in body:
        if isinstance(n, Out):
            add(Out(fold_expression(n.value, filters)))
        elif isinstance(n, For):
            out.append(For(n.name, fold_expression(n.over, filters), fold(n.body, filters)))
        elif isinstance(n, Generation):
            out.append(Generation(fold(n.body, filters)))
        else:
            test, then, other = fold_expression(n.test, filters), fold(n.then, filters), fold(n.other, filters)
            if isinstance(test, Const):
                for kept in then if test.value else other:
                    add(kept)
            else:
                out.append(If(test, then, other))
    return tuple(out)


def shown(value: object) -> str:
    return "" if value is None else str(value)


def expression_closure(e: object, filters: Filters) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name

        def look(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"{name} is not defined")
            return env[name]
        return look
    if isinstance(e, Field):
        of, key = expression_closure(e.of, filters), e.name

        def field(env: dict) -> object:
            value = of(env)
            if not isinstance(value, Mapping):
                raise TemplateError(f"{key} asked of a {type(value).__name__}")
            return value.get(key)
        return field
    if isinstance(e, Filter):
        of, apply = expression_closure(e.of, filters), filters[e.name]
        return lambda env: apply(of(env))
    args = [expression_closure(a, filters) for a in e.args]
    if e.kind in ("and", "or"):
        stop = e.kind == "or"

        def chain(env: dict) -> object:
            for a in args:
                value = a(env)
                if bool(value) == stop:
                    break
            return value
        return chain
    op = OPS[e.kind]
    if len(args) == 1:
        only = args[0]
        return lambda env: op(only(env))
    left, right = args
    return lambda env: op(left(env), right(env))


def block_closure(body: tuple, filters: Filters, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [node_closure(n, filters, generated) for n in body]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)
    return run


def node_closure(node: object, filters: Filters, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Out) and isinstance(node.value, Const):
        piece = (node.value.value, generated)

        def text(env: dict) -> Iterator[Piece]:
            yield piece
        return text
    if isinstance(node, Out):
        value = expression_closure(node.value, filters)

        def out(env: dict) -> Iterator[Piece]:
            yield shown(value(env)), generated
        return out
    if isinstance(node, Generation):
        return block_closure(node.body, filters, True)
    if isinstance(node, For):
        over, body, name = expression_closure(node.over, filters), block_closure(node.body, filters, generated), node.name

        def loop(env: dict) -> Iterator[Piece]:
            for item in over(env):
                yield from body(env | {name: item})
        return loop
    test = expression_closure(node.test, filters)
    then, other = block_closure(node.then, filters, generated), block_closure(node.other, filters, generated)

    def choose(env: dict) -> Iterator[Piece]:
        yield from then(env) if test(env) else other(env)
    return choose


def compile_template(source: str, filters: Filters) -> Callable[[dict], Iterator[Piece]]:
    return block_closure(fold(parse(source, filters), filters), filters, False)
