"""Expression trees: reading and writing text and JSON, structure measures, and the checks an expression passes before it runs."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from .registry import LEAVES, OPERATORS, STYLES

MAX_SIZE = 15
_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*|[(),])")


@dataclass(frozen=True)
class Node:
    """A leaf (no arguments) or an operator applied to nodes."""

    op: str
    args: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.args))})" if self.args else self.op

    def walk(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.walk()

    @property
    def size(self) -> int:
        return sum(1 for _ in self.walk())

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    @property
    def leaves(self) -> list[str]:
        return [n.op for n in self.walk() if not n.args]


class ExpressionError(ValueError):
    pass


def parse(text: str, most: int = MAX_SIZE, leaves: dict[str, str] | None = None) -> Node:
    """Strict: known leaves and operators, right number of arguments, at most ``most`` nodes, nothing behind the end."""
    known = LEAVES if leaves is None else leaves
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at}")
        tokens.append(m[1])
        at = m.end()
    node, rest = _read(tokens, 0, known)
    if rest != len(tokens):
        raise ExpressionError(f"unexpected {tokens[rest]!r} behind the end")
    if node.size > most:
        raise ExpressionError(f"{node.size} nodes, {most} are allowed")
    return node


def _read(tokens: list[str], at: int, leaves: dict[str, str]) -> tuple[Node, int]:
    if at >= len(tokens) or tokens[at] in "(),":
        raise ExpressionError("a name is missing")
    name, at = tokens[at], at + 1
    if at >= len(tokens) or tokens[at] != "(":
        if name not in leaves:
            raise ExpressionError(f"unknown field {name}")
        return Node(name), at
    if name not in OPERATORS:
        raise ExpressionError(f"unknown operator {name}")
    args = []
    while True:
        arg, at = _read(tokens, at + 1, leaves)
        args.append(arg)
        if at >= len(tokens) or tokens[at] not in ",)":
            raise ExpressionError("a bracket is missing")
        if tokens[at] == ")":
            break
    if len(args) != OPERATORS[name].arity:
        raise ExpressionError(f"{name} takes {OPERATORS[name].arity} arguments, {len(args)} given")
    return Node(name, tuple(args)), at + 1


def to_json(node: Node) -> str:
    def plain(n: Node) -> dict:
        return {"op": n.op} | ({"args": [plain(a) for a in n.args]} if n.args else {})

    return json.dumps(plain(node))


def from_json(text: str) -> Node:
    def made(d: dict) -> Node:
        return Node(d["op"], tuple(made(a) for a in d.get("args", [])))

    return made(json.loads(text))


def bare(op: str) -> str:
    """An operator without its window."""
    return re.sub(r"\d+$", "", op)


def skeleton(node: Node) -> str:
    """The shape of an expression: operators without windows, every leaf a dot."""
    return f"{bare(node.op)}({','.join(skeleton(a) for a in node.args)})" if node.args else "."


def skeletons(node: Node) -> Counter:
    """How often each sub-shape with an operator occurs."""
    return Counter(skeleton(n) for n in node.walk() if n.args)


def root_family(node: Node) -> str:
    return bare(node.op) if node.args else "leaf"


def sole_leaf(node: Node) -> str | None:
    """The leaf of an expression that uses only one."""
    found = set(node.leaves)
    return found.pop() if len(found) == 1 else None


def _levels(node: Node, depth: int) -> list[list[Node]]:
    """The nodes at depth 0 .. ``depth``."""
    levels = [[node]]
    for _ in range(depth):
        levels.append([a for n in levels[-1] for a in n.args])
    return levels


def is_style_combination(node: Node) -> bool:
    """At least half of the different leaves are styles, or a style is in the numerator of a division at a depth of at most 2."""
    leaves = set(node.leaves)
    if 2 * len(leaves & set(STYLES)) >= len(leaves):
        return True
    divisions = [n for level in _levels(node, 2) for n in level if n.op == "div"]
    return any(set(n.args[0].leaves) & set(STYLES) for n in divisions)


#: Operators whose result has a dimension of its own: standardised (Z), logarithms (L), ratios (R), products and quotients (C).
_OWN = {"cs_rank": "Z", "cs_demean": "Z", "cs_scale": "Z", "log": "L", "corr": "R", "mul": "C", "div": "C"}
#: Operators whose sides must be of one dimension, and the dimensions that go with any.
_ALIKE, _FREE = ("add", "sub", "min", "max"), frozenset("ZC")


def dimension(node: Node) -> str:
    """P, V, A, M (raw units), R and L (ratios, logarithms), Z (standardised), C (compound), or X where the sides of a sum don't go together."""
    op = bare(node.op)
    if not node.args:
        return LEAVES.get(node.op, "X")
    if op in _OWN:
        return _OWN[op]
    found = {dimension(a) for a in (node.args if op in _ALIKE else node.args[:1])}
    if op in _ALIKE and found & _FREE:
        return "C"
    return found.pop() if len(found) == 1 else "X"


def review(node: Node) -> str | None:
    """Why an expression makes no sense, or None: sums or comparisons of different dimensions, x - x, x / x."""
    for n in node.walk():
        op = bare(n.op)
        if op in ("sub", "div") and len(n.args) == 2 and n.args[0] == n.args[1]:
            return f"{op} of equal sides"
        if op in _ALIKE and n.args:
            found = {dimension(a) for a in n.args}
            if len(found) > 1 and not found & _FREE:
                return f"{op} of " + " and ".join(sorted(found))
    return None
