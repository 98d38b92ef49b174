"""A small language of signals and masks, compiled to columns.

    expr    : all ("|" all)*
    all     : compare ("&" compare)*
    compare : term (("==" | "<" | ">") term)*
    term    : NAME | NUMBER | C(expr) | D(expr) | (expr)

D is the difference to the sample before (0 at the first), C the running sum.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from undula.functions import events

SCALAR, SIGNAL, MASK = "scalar", "signal", "mask"
_TOKEN = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|[&|<>()]))")


@dataclass(frozen=True)
class Node:
    kind: str  # name, number, diff, cumsum, eq, lt, gt, and, or
    args: tuple = ()


class ParseError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def parse(text: str) -> Node:
    tokens = _tokens(text)
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) else None

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or expected not in (None, tokens[at][1]):
            raise ParseError(f"expected {expected or 'a term'}, found {peek()!r}")
        at += 1
        return tokens[at - 1]

    levels = [{"|": "or"}, {"&": "and"}, {"==": "eq", "<": "lt", ">": "gt"}]

    def level(k: int) -> Node:
        if k == len(levels):
            return primary()
        left = level(k + 1)
        while peek() in levels[k]:
            op = take()[1]
            left = Node(levels[k][op], (left, level(k + 1)))
        return left

    def primary() -> Node:
        kind, value = take()
        if kind == "number":
            return Node("number", (float(value),))
        if kind == "name":
            if value in ("C", "D") and peek() == "(":
                take("(")
                inner = level(0)
                take(")")
                return Node("cumsum" if value == "C" else "diff", (inner,))
            return Node("name", (value,))
        if value == "(":
            inner = level(0)
            take(")")
            return inner
        raise ParseError(f"unexpected {value!r}")

    node = level(0)
    if at < len(tokens):
        raise ParseError(f"unexpected {peek()!r}")
    return node


def infer(node: Node) -> str:
    """scalar, signal or mask. Comparing two scalars gives a scalar; TypeError where an operand doesn't fit."""
    if node.kind == "number":
        return SCALAR
    if node.kind == "name":
        return SIGNAL
    kinds = [infer(a) for a in node.args]
    if node.kind in ("diff", "cumsum"):
        return SIGNAL
    if node.kind in ("and", "or"):
        if SIGNAL in kinds:
            raise TypeError(f"{node.kind} needs masks")
        return MASK
    if node.kind in ("eq", "lt", "gt"):
        return SCALAR if kinds == [SCALAR, SCALAR] else MASK
    raise TypeError(f"unknown node {node.kind!r}")


@dataclass(frozen=True)
class Expression:
    node: Node
    type: str
    build: Callable[[WindowSpec], Column]


def _column(node: Node, w: WindowSpec) -> Column:
    a = [x if isinstance(x, (str, float)) else _column(x, w) for x in node.args]
    number = lambda x, n: x.cast("double") if infer(n) == MASK else x
    match node.kind:
        case "number":
            return F.lit(a[0])
        case "name":
            return F.col(a[0])
        case "diff":
            x = number(a[0], node.args[0])
            return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))
        case "cumsum":
            return F.sum(number(a[0], node.args[0])).over(events.upto(w))
        case "eq" | "lt" | "gt":
            x, y = (number(v, n) for v, n in zip(a, node.args, strict=True))
            return F.coalesce(x == y if node.kind == "eq" else x < y if node.kind == "lt" else x > y, F.lit(False))
        case "and":
            return a[0] & a[1]
        case _:
            return a[0] | a[1]


def compile(text: str) -> Expression:
    node = parse(text)
    return Expression(node, infer(node), lambda w: _column(node, w))
