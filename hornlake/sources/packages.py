"""Portable packages: compiled rules, facts and a query program in one checked JSON document."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from ..errors import EngineError
from ..functions import builtin
from ..model import Atom, Bind, Const, Filter, Minimum, Rule, Scan, Var, Witness
from ..ontology.compiler import Ontology, compile_graph
from ..plans.parser import parse
from ..sources.rdf import Triple

FORMAT, VERSION, MOST = "hornlake-package", 1, 256 * 2**20


class PackageError(EngineError):
    """A package that is damaged, too large or needs what isn't there."""


@dataclass
class Package:
    ontology: Ontology
    query: str | None
    requires: list[str]
    context: dict


def _term(t) -> list:
    match t:
        case Var(name=n):
            return ["var", n]
        case Const(text=x):
            return ["const", x]
        case Witness(symbol=f, args=args):
            return ["witness", f, *map(_term, args)]
    raise PackageError(f"can't pack {t!r}")


def _untermed(x):
    match x:
        case ["var", n]:
            return Var(n)
        case ["const", text]:
            return Const(text, text)
        case ["witness", f, *args]:
            return Witness(f, tuple(map(_untermed, args)))
    raise PackageError("malformed term")


def _atom(a: Atom) -> list:
    return [a.predicate, *map(_term, a.args)]


def _unatomed(x) -> Atom:
    return Atom(x[0], tuple(map(_untermed, x[1:])))


def compile_package(triples: list[Triple], profile: str = "L2", query: str | None = None, context: dict | None = None) -> Package:
    requires: set[str] = set()
    if query is not None:
        registry = builtin()
        for rule in parse(query).rules:
            for node in rule.body:
                if isinstance(node, Filter | Bind | Scan):
                    registry.check(node)
                    requires.add(node.operation)
                assert isinstance(node, Filter | Bind | Scan | Atom | Minimum)
    return Package(compile_graph(triples, profile), query, sorted(requires), dict(context or {}))


def dumps(package: Package, most: int = MOST) -> bytes:
    o = package.ontology
    body = {
        "format": FORMAT, "version": VERSION, "profile": o.profile, "facts": sorted(map(list, o.facts), key=str), "named": sorted(o.named),
        "rules": [[None if r.head is None else _atom(r.head), [_atom(a) for a in r.body], r.label] for r in o.rules],
        "query": package.query, "requires": package.requires, "context": package.context,
    }
    text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    if len(text) > most:
        raise PackageError("the package is too large")
    return hashlib.sha256(text).hexdigest().encode() + b"\n" + text


def loads(data: bytes, most: int = MOST) -> Package:
    digest, _, text = data.partition(b"\n")
    if len(text) > most or hashlib.sha256(text).hexdigest().encode() != digest:
        raise PackageError("the package is damaged or too large")
    body = json.loads(text)
    if (body.get("format"), body.get("version")) != (FORMAT, VERSION):
        raise PackageError("unknown format")
    registry = builtin()
    missing = [x for x in body["requires"] if registry.find(x) is None]
    if missing:
        raise PackageError(f"missing operations: {', '.join(missing)}")
    rules = [Rule(None if h is None else _unatomed(h), tuple(map(_unatomed, b)), label) for h, b, label in body["rules"]]
    ontology = Ontology(rules, {tuple(f) for f in body["facts"]}, body["profile"], set(body["named"]))
    return Package(ontology, body["query"], body["requires"], body["context"])
