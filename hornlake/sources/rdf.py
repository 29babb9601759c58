"""RDF text: N-Triples, a Turtle subset, and writing N-Triples or Turtle.

A term is its canonical N-Triples text. Driver-side parsing is for ontologies;
instance data in N-Triples is read as a table by ``read_ntriples``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ParseError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = f"<{RDF}type>"
Triple = tuple[str, str, str]

_TERM = r'<[^<>"{}|^`\\\s]*>|_:[A-Za-z0-9][A-Za-z0-9_.-]*|"(?:[^"\\\n\r]|\\.)*"(?:\^\^<[^<>\s]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
_TOKENS = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix|@base|(?i:PREFIX|BASE)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[A-Za-z0-9](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w-]*:(?:[\w%-](?:[\w.:%-]*[\w:%-])?)?|:(?:[\w%-](?:[\w.:%-]*[\w:%-])?)?)
    |(?P<word>a(?=[\s<])|true|false)
    |(?P<punct>\^\^|[\[\]();,.])""",
    re.X | re.S,
)


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    text = json.dumps(lexical, ensure_ascii=False)
    if lang:
        return f"{text}@{lang.lower()}"
    return f"{text}^^<{datatype}>" if datatype and datatype != f"{XSD}string" else text


def unquote(text: str) -> str:
    body = text[3:-3] if text.startswith('"""') else text[1:-1]
    short = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

    def plain(m):
        x = m.group(1)
        return short[x] if x in short else chr(int(x[1:], 16))

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tnrbf\"'\\])", plain, body)


class Turtle:
    """A recursive-descent reader of the Turtle subset: prefixes, lists, blank nodes, literals."""

    def __init__(self, text: str, source: str = "<turtle>", blank: str = "b"):
        self.source, self.blank, self.count = source, blank, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.triples: list[Triple] = []
        self.tokens, self.k = [], 0
        at, line, start = 0, 1, 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            place = (source, line, at - start + 1)
            if not m:
                raise ParseError(f"unexpected {text[at]!r}", place)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group(), place))
            for n in re.finditer("\n", m.group()):
                line, start = line + 1, at + n.end()
            at = m.end()
        self.tokens.append(("end", "", (source, line, at - start + 1)))

    def next(self, *values: str) -> str:
        kind, value, at = self.tokens[self.k]
        if values and value not in values:
            raise ParseError(f"expected {' or '.join(values)}, found {value or 'the end'!r}", at)
        self.k += 1
        return value

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.blank}{self.count}"

    def term(self) -> str:
        kind, value, at = self.tokens[self.k]
        self.k += 1
        match kind:
            case "iri":
                return f"<{self.base}{value[1:]}" if self.base and ":" not in value else value
            case "name":
                prefix, _, local = value.partition(":")
                if prefix not in self.prefixes:
                    raise ParseError(f"undeclared prefix {prefix!r}", at)
                return f"<{self.prefixes[prefix]}{local}>"
            case "blank":
                return value
            case "word":
                return TYPE if value == "a" else literal(value, f"{XSD}boolean")
            case "number":
                return literal(value, XSD + ("double" if re.search("[eE]", value) else "decimal" if "." in value else "integer"))
            case "string" | "long":
                text = unquote(value)
                if self.tokens[self.k][0] == "lang":
                    return literal(text, lang=self.next()[1:])
                if self.tokens[self.k][1] == "^^":
                    self.next()
                    return literal(text, self.term()[1:-1])
                return literal(text)
        if value == "[":
            node = self.fresh()
            if self.tokens[self.k][1] != "]":
                self.properties(node)
            self.next("]")
            return node
        if value == "(":
            items = []
            while self.tokens[self.k][1] != ")":
                items.append(self.term())
            self.next(")")
            return self.listed(items)
        raise ParseError(f"expected a term, found {value or 'the end'!r}", at)

    def listed(self, items: list[str]) -> str:
        node = f"<{RDF}nil>"
        for item in reversed(items):
            cell = self.fresh()
            self.triples += [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", node)]
            node = cell
        return node

    def properties(self, subject: str) -> None:
        while True:
            verb = self.term()
            while True:
                self.triples.append((subject, verb, self.term()))
                if self.tokens[self.k][1] != ",":
                    break
                self.next()
            while self.tokens[self.k][1] == ";":
                self.next()
            if self.tokens[self.k][1] in (".", "]", ""):
                return

    def parse(self) -> list[Triple]:
        while self.tokens[self.k][0] != "end":
            kind, value, at = self.tokens[self.k]
            if kind == "directive":
                self.next()
                if "prefix" in value.lower():
                    name = self.next()
                    self.prefixes[name[:-1]] = self.term()[1:-1]
                else:
                    self.base = self.term()[1:-1]
                if value.startswith("@"):
                    self.next(".")
                continue
            subject = self.term()
            if not (value == "[" and self.tokens[self.k][1] == "."):
                self.properties(subject)
            self.next(".")
        return self.triples


def parse_turtle(text: str, source: str = "<turtle>", blank: str = "b") -> list[Triple]:
    """Also reads N-Triples, which are Turtle."""
    return Turtle(text, source, blank).parse()


def parse_rdfxml(text: str, source: str = "<rdf>") -> list[Triple]:
    """RDF/XML: node and property elements, rdf:about/ID/resource/nodeID/datatype, Collection and Resource."""
    from xml.etree.ElementTree import XMLPullParser

    if "<!ENTITY" in text:
        raise ParseError("entity declarations are refused", (source, 1, 1))
    parser = XMLPullParser(["start", "end"])
    parser.feed(text)
    parser.close()
    root = next(e for _, e in parser.read_events())
    ns, xml = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    base = root.get(f"{xml}base", "")
    out: list[Triple] = []
    helper = Turtle("", source, "x")

    def iri(value: str) -> str:
        return f"<{value if re.match('[A-Za-z][A-Za-z0-9+.-]*:', value) else base + value}>"

    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '', 1)}>"

    def node(e, lang: str | None) -> str:
        lang = e.get(f"{xml}lang", lang)
        if (about := e.get(f"{ns}about")) is not None:
            subject = iri(about)
        elif (own := e.get(f"{ns}ID")) is not None:
            subject = iri("#" + own)
        elif (label := e.get(f"{ns}nodeID")) is not None:
            subject = f"_:{label}"
        else:
            subject = helper.fresh()
        if e.tag != f"{ns}Description":
            out.append((subject, TYPE, name(e.tag)))
        for k, v in e.attrib.items():
            if not k.startswith((ns, xml)):
                out.append((subject, name(k), literal(v, lang=lang)))
        for p in e:
            verb, kind, language = name(p.tag), p.get(f"{ns}parseType"), p.get(f"{xml}lang", lang)
            if (target := p.get(f"{ns}resource")) is not None:
                out.append((subject, verb, iri(target)))
            elif (label := p.get(f"{ns}nodeID")) is not None:
                out.append((subject, verb, f"_:{label}"))
            elif kind == "Collection":
                helper.triples = []
                out.append((subject, verb, helper.listed([node(x, language) for x in p])))
                out.extend(helper.triples)
            elif len(p):
                out.extend((subject, verb, node(x, language)) for x in p)
            else:
                datatype = p.get(f"{ns}datatype")
                out.append((subject, verb, literal(p.text or "", datatype, None if datatype else language)))
        return subject

    for e in root if root.tag == f"{ns}RDF" else [root]:
        node(e, root.get(f"{xml}lang"))
    return out


def read_graph(path: str, format: str | None = None) -> list[Triple]:
    """Triples of a local file, by suffix; imports are never fetched."""
    kind = format or path.rsplit(".", 1)[-1].lower()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if kind == "dlp":
        from ..ontology.syntax import parse_ontology

        return parse_ontology(text, path)
    if kind in ("rdf", "owl", "xml"):
        return parse_rdfxml(text, path)
    if kind in ("nt", "ttl", "n3", "turtle"):
        return parse_turtle(text, path)
    raise ParseError(f"unknown format {kind!r}", (path, 1, 1))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples files, as a distributed table; a line outside the format raises when it is read."""
    lines = spark.read.text(path).filter(r"value not rlike '^\\s*(#.*)?$'")
    pattern = rf"^\s*({_TERM})\s+(<[^<>\s]*>)\s+({_TERM})\s*\.\s*(?:#.*)?$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    bad = F.raise_error(F.concat(F.lit("@@DOMAIN_ERROR: no triple: "), F.col("value"), F.lit("@@"))).isNull()
    good = lines.filter(F.when(F.col("value").rlike(pattern), F.lit(True)).otherwise(bad))
    return good.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")).distinct()


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def to_ntriples(triples: Iterable[Triple]) -> str:
    return "".join(f"{s} {p} {o} .\n" for s, p, o in sorted(set(triples)))


def to_turtle(triples: Iterable[Triple]) -> str:
    """Grouped by subject; without prefixes, so that it stays canonical."""
    by: dict[str, list[Triple]] = {}
    for t in sorted(set(triples)):
        by.setdefault(t[0], []).append(t)
    return "".join(f"{s} " + " ;\n    ".join(f"{p} {o}" for _, p, o in ts) + " .\n" for s, ts in by.items())
