"""Predicate trees. Nodes are added when a method is called, so call order is kept by construction.

A group is a list of (connector, node). AND binds tighter than OR, the first
connector counts for nothing and an empty group vanishes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from relquery.functions.names import InvalidArgument

OPERATORS = ("=", ">", "<", ">=", "<=", "!=", "<>")
_KEY = re.compile(r"^(.*?)\s*(<=>|>=|<=|<>|!=|=|<|>|\bIS\s+NOT\b|\bIS\b|\bNOT\s+LIKE\b|\bLIKE\b)\s*$", re.I | re.S)
_RAW = re.compile(r"[=<>!]|\bIS\b|\bIN\b|\bLIKE\b|\bBETWEEN\b|\bEXISTS\b|\bNOT\b|\(", re.I)
_DOTTED = re.compile(r"'(?:[^']|'')*'|(?<![\w.`])`?([A-Za-z_]\w*)`?\.`?([A-Za-z_]\w*)`?(?!\s*[.(])")


@dataclass
class Compare:
    key: str
    op: str
    value: Any


@dataclass
class Raw:
    text: str


@dataclass
class In:
    key: str
    values: list
    negated: bool = False


@dataclass
class Between:
    key: str
    low: Any
    high: Any
    negated: bool = False


@dataclass
class Like:
    key: str
    term: str
    side: str = "both"
    negated: bool = False


@dataclass
class Exists:
    """Rows of ``sub`` exist; keys are empty if ``sub`` names its outer columns itself."""

    sub: Any
    foreign: list[str]
    local: list[str]
    negated: bool = False


@dataclass
class Has:
    """The number of ``sub``'s rows compared with ``count``."""

    sub: Any
    foreign: list[str]
    local: list[str]
    op: str
    count: int


@dataclass
class OnAggregate:
    """A registered aggregate, null as 0, compared with a value."""

    aggregate: Any
    op: str
    value: Any


@dataclass
class Group:
    items: list[tuple[str, Any]] = field(default_factory=list)
    negated: bool = False

    def add(self, connector: str, node: Any) -> None:
        self.items.append((connector, node))

    def pruned(self) -> Group:
        """Without empty groups."""
        out = Group(negated=self.negated)
        for connector, node in self.items:
            node = node.pruned() if isinstance(node, Group) else node
            if not isinstance(node, Group) or node.items:
                out.add(connector, node)
        return out

    def alternatives(self) -> list[list[Any]]:
        """Lists of nodes that must all hold; one of the lists must."""
        out: list[list[Any]] = []
        for k, (connector, node) in enumerate(self.items):
            if k == 0 or connector == "OR":
                out.append([])
            out[-1].append(node)
        return out

    def walk(self) -> Iterator[Any]:
        for _, node in self.items:
            if isinstance(node, Group):
                yield from node.walk()
            else:
                yield node


def condition(key: Any, value: Any, given: bool) -> Any:
    """A node from ``key`` (perhaps with an operator) and, if ``given``, ``value``."""
    if not isinstance(key, str) or not key.strip():
        raise InvalidArgument(f"invalid condition: {key!r}")
    if not given:
        if not _RAW.search(key):
            return Compare(key.strip(), "IS NULL", None)
        return Raw(key)
    m = _KEY.match(key.strip())
    name, op = (m[1].strip(), " ".join(m[2].upper().split())) if m else (key.strip(), "=")
    if value is None:
        return Compare(name, "IS NOT NULL" if op in ("!=", "<>", "IS NOT") else "IS NULL", None)
    return Compare(name, {"IS": "=", "IS NOT": "!="}.get(op, op), value)


def dotted(text: str) -> set[tuple[str, str]]:
    """The (qualifier, column) pairs that a text names outside of strings."""
    return {(m[1], m[2]) for m in _DOTTED.finditer(text) if m[1]}


def replace_dotted(text: str, names: dict[tuple[str, str], str]) -> str:
    return _DOTTED.sub(lambda m: f"`{names[m[1], m[2]]}`" if m[1] and (m[1], m[2]) in names else m[0], text)
