"""Terms, rule bodies and rules. All are immutable; DataFrames appear only in plans.

A relation is a set of rows with columns c0, c1, ... and no nulls. Stored RDF
terms are strings in N-Triples form; relations over tables keep their types.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

EQ, NEQ, TOP = "urn:dlp:internal:eq", "urn:dlp:internal:neq", "urn:dlp:internal:top"
QUERY = "urn:dlp:query:"
At = tuple[str, int, int]


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    """A constant: its Spark value and, for RDF terms, the canonical text."""

    value: Any
    text: str = ""

    def __str__(self) -> str:
        return self.text or repr(self.value)


@dataclass(frozen=True)
class Witness:
    """An existential witness: a function symbol over variables."""

    symbol: str
    args: tuple["Term", ...]

    def __str__(self) -> str:
        return f"{self.symbol}({', '.join(map(str, self.args))})"


Term = Var | Const | Witness


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple[Term, ...]
    at: At | None = field(default=None, compare=False)

    def __str__(self) -> str:
        return f"{self.predicate}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Filter:
    operation: str
    args: tuple[Term, ...]
    at: At | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Bind:
    operation: str
    args: tuple[Term, ...]
    output: Term
    at: At | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Scan:
    operation: str
    args: tuple[Term, ...]
    outputs: tuple[Term, ...]
    at: At | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Minimum:
    value: Var
    groups: tuple[Var, ...]
    source: Atom
    output: Var
    at: At | None = field(default=None, compare=False)


Node = Atom | Filter | Bind | Scan | Minimum


@dataclass(frozen=True)
class Rule:
    """``head`` None makes an integrity constraint."""

    head: Atom | None
    body: tuple[Node, ...]
    label: str = ""
    given: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.head or 'false'} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Program:
    rules: tuple[Rule, ...]
    namespaces: tuple[tuple[str, str], ...] = ()
    version: int = 1


def variables(*terms: Term) -> set[str]:
    found: set[str] = set()
    for t in terms:
        if isinstance(t, Var):
            found.add(t.name)
        elif isinstance(t, Witness):
            found |= variables(*t.args)
    return found


def predicates(node: Node) -> list[str]:
    """The stored or derived relations a body node reads."""
    if isinstance(node, Atom):
        return [] if node.predicate == EQ else [node.predicate]
    return [node.source.predicate] if isinstance(node, Minimum) else []
