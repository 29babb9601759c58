"""Command line: validate, rules, materialize and ask; JSON on standard output.

Exit codes: 0 complete and consistent, 1 invalid, 2 inconsistent, 3 incomplete.
"""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError, IncompleteError, InconsistentError
from .ontology.compiler import compile_graph
from .sources.rdf import read_graph, to_ntriples, to_turtle

VERBS = {
    "instances": 1, "types": 1, "property-values": 2, "property-pairs": 1, "entails": 3, "subsumes": 2, "equivalent-classes": 2, "property-subsumes": 2,
    "equivalent-properties": 2, "inverse-properties": 2, "is-symmetric": 1, "is-transitive": 1, "has-domain": 2, "has-range": 2, "is-satisfiable": 1,
}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hornlake")
    parser.add_argument("verb", choices=["validate", "rules", "materialize", "stats", *VERBS])
    parser.add_argument("file")
    parser.add_argument("names", nargs="*")
    parser.add_argument("--format")
    parser.add_argument("--profile", default="L3")
    parser.add_argument("--output", "-o")
    parser.add_argument("--witnesses", action="store_true")
    a = parser.parse_args(argv)
    try:
        triples = read_graph(a.file, a.format)
        if a.verb == "rules":
            print(compile_graph(triples, a.profile).text())
            return 0
        from .reasoner import Reasoner

        r = Reasoner(session(), triples, a.profile)
        if a.verb == "materialize":
            rows = [tuple(x) for x in r.to_triples(a.witnesses).collect()]  # an ontology's closure, bounded by its fact limit
            text = to_ntriples(rows) if (a.output or "").endswith(".nt") else to_turtle(rows)
            if a.output:
                with open(a.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, end="")
        elif a.verb in VERBS:
            if len(a.names) != VERBS[a.verb]:
                raise EngineError(f"{a.verb} takes {VERBS[a.verb]} names")
            out = getattr(r, a.verb.replace("-", "_"))(*a.names)
            print(json.dumps(sorted(out) if isinstance(out, set) else out, ensure_ascii=False))
        else:
            print(json.dumps(r.stats, ensure_ascii=False, default=str))
        return 2 if r.consistency == "inconsistent" else 0 if r.complete else 3
    except InconsistentError as e:
        print(e, file=sys.stderr)
        return 2
    except IncompleteError as e:
        print(e, file=sys.stderr)
        return 3
    except (EngineError, OSError, UnicodeDecodeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
