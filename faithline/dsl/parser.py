"""Programs as trees. A program is an expression and ``=True`` or ``=False``; an expression is a call
``name{arg; ...}`` or anything else, which is a literal. Noise that models write is repaired by operator."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from .registry import ARITY, canonical


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


Node = Literal | Call


@dataclass(frozen=True)
class Program:
    expr: Node
    expected: bool


_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*(?=\{)")
#: Operators whose surplus arguments are one value with commas in it: how many arguments stand before that value.
_TAIL = {"eq": 1, "not_eq": 1, "greater": 1, "less": 1, "add": 1, "diff": 1, "all_eq": 2, "all_greater": 2}
_UNARY = {"count", "only", "top", "bottom", "half", "any", "none", "zero", "not"}


def _quotes(s: str) -> str:
    return s.replace("&#34;", '"').replace("&quot;", '"')


def _marks(s: str, start: int = 0) -> Iterator[tuple[int, str, int]]:
    """(position, character, depth before it) of what stands outside double quotes."""
    depth, quoted = 0, False
    for i in range(start, len(s)):
        c = s[i]
        if c == '"':
            quoted = not quoted
        elif not quoted:
            yield i, c, depth
            depth += (c == "{") - (c == "}")


def _cut(s: str, at: list[int]) -> list[str]:
    edges = [-1, *at, len(s)]
    return [s[a + 1 : b].strip() for a, b in zip(edges, edges[1:], strict=False)]


def _arguments(inside: str) -> list[str]:
    """Arguments between braces, by ';' if there is one at the top level and else by ','; empty ones count."""
    top = [(i, c) for i, c, depth in _marks(inside) if depth == 0]
    mark = ";" if any(c == ";" for _, c in top) else ","
    return _cut(inside, [i for i, c in top if c == mark])


def _repaired(name: str, args: list[str]) -> list[str]:
    if name not in ARITY:
        return args
    most = ARITY[name][1]
    if name.startswith("filter_") and len(args) == 2:
        commas = [i for i, c, _ in _marks(args[1]) if c == ","]
        if commas:
            field, value = args[1][: commas[-1]].strip(), args[1][commas[-1] + 1 :].strip()
            if field:
                args = [args[0], field, value]
    if name in ("and", "or"):
        return [a for a in args if a]
    if name in _UNARY:
        return args[:1]
    keep = _TAIL.get(name, most - 1 if most else None)
    if most is not None and len(args) > most:
        args = [*args[:keep], ", ".join(args[keep:])]
    return args


def parse_expr(text: str) -> Node:
    t = _quotes(text.strip())
    found = _NAME.match(t)
    if not found:
        return Literal(t)
    start = found.end()
    close = next((i for i, c, depth in _marks(t, start) if c == "}" and depth == 1), None)
    if close != len(t) - 1:
        return Literal(t)
    name = canonical(found[0])
    return Call(name, tuple(parse_expr(a) for a in _repaired(name, _arguments(t[start + 1 : close]))))


class ProgramError(ValueError):
    """A text that is no program: it lacks the ``=True`` or ``=False`` at its end."""


@lru_cache(maxsize=10_000)
def parse_program(text: str) -> Program:
    t = _quotes(text.strip())
    equals = [i for i, c, depth in _marks(t) if c == "=" and depth == 0]
    tail = t[equals[-1] + 1 :].strip().lower() if equals else ""
    if tail not in ("true", "false"):
        raise ProgramError(f"no =True or =False at the end: {text[-40:]!r}")
    return Program(parse_expr(t[: equals[-1]]), tail == "true")


def walk(node: Node) -> Iterator[Node]:
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)
