import datetime as dt
import random
from decimal import Decimal

import pytest

from hornlake.errors import DomainError, EngineError, ParseError, RetryError, ValidationError
from hornlake.functions import builtin
from hornlake.model import Atom, Minimum, Var
from hornlake.plans.fixpoint import fixpoint
from hornlake.plans.parser import parse
from hornlake.plans.planner import plan
from hornlake.plans.runtime import QueryRuntime, run

HEAD = "version 1\nprefix num: <urn:dlp:numeric:>\nprefix time: <urn:dlp:temporal:>\nprefix geo: <urn:dlp:spatial:>\nprefix policy: <urn:dlp:calendar-policy:>\nprefix internal: <urn:dlp:internal:>\n"
Q = "urn:dlp:query:"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def answer(spark, text, params=None, **relations):
    return {tuple(r) for r in run(spark, HEAD + text, {Q + k: v for k, v in relations.items()}, "answer", params).collect()}


def test_parser_places_and_forms():
    p = parse(HEAD + 'query a(?x, "l"@EN) given (?s) :- b(?x), MIN ?v GROUP_BY (?x) FROM c(?x, ?v) AS ?m. # end')
    assert p.rules[0].given == ("s",) and isinstance(p.rules[0].body[1], Minimum)
    assert p.rules[0].head.args[1].text == '"l"@en'
    with pytest.raises(ParseError) as e:
        parse("version 1\na(?x) :- b(?x)\nc")
    assert (e.value.line, e.value.column) == (3, 1)
    for bad in ("version 2", "version 1 prefix xsd: <x:> a() :- b().", "version 1 a(?x) :- y:b(?x).", 'version 1 a("2026-02-30"^^xsd:date) :- b().', "version 1 a(?x) :- ."):
        with pytest.raises(ParseError):
            parse(bad)


def test_planner_orders_and_rejects():
    ops = builtin()
    p = plan(parse(HEAD + "a(?y) :- filter num:lessThan(?y, 3), bind num:add(?x, 1) as ?y, b(?x)."), ops)
    assert [type(n).__name__ for n in p.strata[0][0].body] == ["Atom", "Bind", "Filter"]
    p = plan(parse(HEAD + "t(?x, ?z) :- e(?x, ?z). t(?x, ?z) :- t(?x, ?y), e(?y, ?z). m(?x, ?v) :- MIN ?z GROUP_BY ?x FROM t(?x, ?z) AS ?v."), ops)
    assert len(p.strata) == 2 and p.recursive == {Q + "t"}
    for bad in (
        "a(?x, ?y) :- b(?x).",  # unbound head
        "a(?x) :- b(?x), b(?x, ?x).",  # two arities
        "a(?x) :- b(?y), filter num:lessThan(?x, 1).",  # unbound input
        "a(?x) :- b(?x), filter num:add(?x, 1).",  # no test
        "a(?x) :- b(?x), filter num:odd(?x).",  # unknown
        "a(?y) :- a(?x), bind num:add(?x, 1) as ?y.",  # value-generating cycle
        "a(?x) given (?s) :- b(?x). c(?x) :- a(?x).",  # parameters not declared
        "a(?m) :- MIN ?w GROUP_BY () FROM b(?v) AS ?m.",  # value outside the source
    ):
        with pytest.raises(ValidationError):
            plan(parse(HEAD + bad), ops)


def test_joins_constants_repeats_and_sets(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 3), (1, 2)], "a long, b long")
    assert answer(spark, "answer(?x, ?z) :- e(?x, ?y), e(?y, ?z).", e=e) == {(1, 3), (2, 3), (3, 3)}
    assert answer(spark, "answer(?x) :- e(?x, ?x).", e=e) == {(3,)}
    assert answer(spark, "answer(?x) :- e(?x, 3).", e=e) == {(2,), (3,)}
    assert answer(spark, "answer(?x, ?y) :- e(?x, 2), e(?y, 3).", e=e) == {(1, 2), (1, 3)}
    assert answer(spark, "answer(?x) :- e(?x, ?y), e(1, 2).", e=e) == {(1,), (2,), (3,)}
    assert answer(spark, "answer(?x) :- e(?x, ?y), e(1, 9).", e=e) == set()
    assert answer(spark, "answer() :- e(?x, ?y).", e=e) == {(True,)}


def test_errors_abort_only_for_rows_that_arrive(spark):
    n = frame(spark, [(1, 0), (2, 4)], "k long, d long")
    keys = frame(spark, [(2,)], "k long")
    with pytest.raises(DomainError) as e:
        QueryRuntime(spark, HEAD + "answer(?k, ?q) :- n(?k, ?d), bind num:divide(8, ?d) as ?q.").evaluate({Q + "n": n})
    assert e.value.code == "DOMAIN_ERROR"
    got = answer(spark, "answer(?k, ?q) :- n(?k, ?d), keys(?k), bind num:divide(8, ?d) as ?q.", n=n, keys=keys)
    assert got == {(2, Decimal(2))}
    with pytest.raises(DomainError):
        QueryRuntime(spark, HEAD + "answer(?k) :- n(?k, ?d).").evaluate({Q + "n": frame(spark, [(None, 1)], "k long, d long")})


def code(spark, body, schema="x long", rows=((1,),)):
    with pytest.raises(DomainError) as e:
        QueryRuntime(spark, HEAD + f"answer(?v) :- r(?x), {body}.").evaluate({Q + "r": frame(spark, list(rows), schema)})
    return e.value.code


def test_numeric_operations(spark):
    r = frame(spark, [(3,)], "x long")
    value = lambda body: next(iter(answer(spark, f"answer(?v) :- r(?x), {body}.", r=r)))[0]
    assert value("bind num:add(?x, 4) as ?v") == 7
    assert value("bind num:subtract(?x, 0.5) as ?v") == Decimal("2.5")
    assert value("bind num:multiply(?x, 0.25) as ?v") == Decimal("0.75")
    assert value("bind num:divide(?x, 8) as ?v") == Decimal("0.375")
    assert value("bind num:toFloat(?x) as ?v") == 3.0
    assert value('bind num:quantity(?x, "kmh") as ?q, bind num:quantityAdd(?q, ?q) as ?v').value == 6
    assert code(spark, "bind num:divide(?x, 3) as ?v") == "INEXACT"
    assert code(spark, "bind num:divide(?x, 0) as ?v") == "DOMAIN_ERROR"
    assert code(spark, "bind num:add(?x, 9223372036854775807) as ?v") == "OVERFLOW"
    assert code(spark, "bind num:multiply(?x, 0.000000000000000001) as ?y, bind num:multiply(?y, 0.1) as ?v") == "INEXACT"
    assert code(spark, 'bind num:quantity(?x, "mile") as ?v') == "DOMAIN_ERROR"
    assert code(spark, 'bind num:quantity(?x, "metre") as ?a, bind num:quantity(?x, "second") as ?b, bind num:quantityAdd(?a, ?b) as ?v') == "TYPE_ERROR"
    assert code(spark, 'bind num:add(?x, "text") as ?v') == "TYPE_ERROR"
    # agreement compares values, joins compare terms
    assert answer(spark, "answer(?x) :- r(?x), bind num:add(?x, 0.0) as ?x.", r=r) == {(3,)}


def test_temporal_operations(spark):
    d = frame(spark, [(dt.date(2000, 2, 29),)], "x date")
    value = lambda body, r=d: next(iter(answer(spark, f"answer(?v) :- r(?x), {body}.", r=r)))[0]
    years = lambda at: value(f'bind time:completedYears(?x, "{at}"^^xsd:date, policy:march1) as ?v')
    assert (years("2021-02-28"), years("2021-03-01")) == (20, 21)
    assert value('bind time:add(?x, "P1D"^^xsd:dayTimeDuration) as ?v') == dt.date(2000, 3, 1)
    t = frame(spark, [(dt.datetime(2024, 1, 1, 0, 0, 1, 250000),)], "x timestamp")
    assert value('bind time:elapsedSeconds("2024-01-01T00:00:00Z"^^xsd:dateTime, ?x) as ?v', t) == Decimal("1.25")
    assert value('bind time:elapsedSeconds(?x, "2024-01-01T00:00:00Z"^^xsd:dateTime) as ?v', t) == Decimal("-1.25")
    rows = [(dt.date(2000, 2, 29),)]
    assert code(spark, 'bind time:completedYears(?x, "1999-01-01"^^xsd:date, policy:march1) as ?v', "x date", rows) == "DOMAIN_ERROR"
    assert code(spark, "bind time:interval(?x, ?x) as ?v", "x date", rows) == "DOMAIN_ERROR"
    assert code(spark, 'bind time:add(?x, "PT1H"^^xsd:dayTimeDuration) as ?v', "x date", rows) == "DOMAIN_ERROR"
    half_open = 'bind time:interval(?x, "2000-03-02"^^xsd:date) as ?i, filter time:contains(?i, "{}"^^xsd:date), bind time:add(?x, "P0D"^^xsd:dayTimeDuration) as ?v'
    assert answer(spark, f"answer(?v) :- r(?x), {half_open.format('2000-03-01')}.", r=d) and not answer(spark, f"answer(?v) :- r(?x), {half_open.format('2000-03-02')}.", r=d)


def test_minimum(spark):
    e = frame(spark, [("a", 3), ("a", 1), ("b", 2)], "g string, v long")
    assert answer(spark, "answer(?g, ?m) :- MIN ?v GROUP_BY ?g FROM e(?g, ?v) AS ?m.", e=e) == {("a", 1), ("b", 2)}
    assert answer(spark, "answer(?m) :- MIN ?v GROUP_BY () FROM e(?g, ?v) AS ?m.", e=e) == {(1,)}
    assert answer(spark, "answer(?m) :- MIN ?v GROUP_BY () FROM e(?g, ?v) AS ?m.", e=e.limit(0)) == set()
    with pytest.raises(DomainError) as err:
        QueryRuntime(spark, HEAD + "answer(?m) :- MIN ?g GROUP_BY () FROM e(?g, ?v) AS ?m.").evaluate({Q + "e": e})
    assert err.value.code == "TYPE_ERROR"


def test_difference_is_provable_only_for_literals(spark):
    r = frame(spark, [("<x:a>",), ("<x:b>",), ('"1"',), ('"2"',)], "t string")
    got = answer(spark, "answer(?a, ?b) :- r(?a), r(?b), internal:neq(?a, ?b).", r=r)
    assert got == {('"1"', '"2"'), ('"2"', '"1"')}
    known = frame(spark, [("<x:a>", "<x:b>")], "a string, b string")
    rel = {Q + "r": r, "urn:dlp:internal:neq": known}
    found = QueryRuntime(spark, HEAD + "answer(?a, ?b) :- r(?a), r(?b), internal:neq(?a, ?b).").evaluate(rel)
    assert ("<x:b>", "<x:a>") in found.rows(Q + "answer")


def reach(edges):
    found = set(edges)
    while new := {(a, d) for a, b in found for c, d in found if b == c} - found:
        found |= new
    return found


@pytest.mark.parametrize("seed", range(3))
def test_recursion_against_sets(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(10)}
    e = frame(spark, sorted(edges), "a long, b long")
    linear = "answer(?x, ?y) :- e(?x, ?y). answer(?x, ?z) :- e(?x, ?y), answer(?y, ?z)."
    doubling = "answer(?x, ?y) :- e(?x, ?y). answer(?x, ?z) :- answer(?x, ?y), answer(?y, ?z)."
    assert answer(spark, linear, e=e) == answer(spark, doubling, e=e) == reach(edges)


def test_mutual_recursion_naive_and_bounds(spark):
    e = frame(spark, [(k, k + 1) for k in range(6)], "a long, b long")
    text = "odd(?x, ?y) :- e(?x, ?y). even(?x, ?z) :- odd(?x, ?y), e(?y, ?z). odd(?x, ?z) :- even(?x, ?y), e(?y, ?z). answer(?x, ?y) :- even(?x, ?y)."
    assert answer(spark, text, e=e) == {(a, b) for a in range(7) for b in range(a + 2, 7, 2)}
    rules = list(parse(HEAD + "t(?x, ?y) :- e(?x, ?y). t(?x, ?z) :- t(?x, ?y), e(?y, ?z).").rules)
    renamed = {Q + "e": e.toDF("c0", "c1")}
    a, _ = fixpoint(spark, rules, renamed, builtin())
    b, _ = fixpoint(spark, rules, renamed, builtin(), naive=True)
    assert {tuple(r) for r in a[Q + "t"].collect()} == {tuple(r) for r in b[Q + "t"].collect()}
    _, status = fixpoint(spark, rules, renamed, builtin(), rounds=2)
    assert not status.complete


def test_publication_deltas_and_failures(spark):
    runtime = QueryRuntime(spark, HEAD + "answer(?x) :- r(?x), filter num:lessThan(?x, 10).")
    make = lambda *xs: {Q + "r": frame(spark, [(x,) for x in xs], "x long")}
    first = runtime.evaluate(make(1, 2, 12))
    assert first.rows(Q + "answer") == {(1,), (2,)} and {r[0] for r in first.additions[Q + "answer"].collect()} == {1, 2}
    second = runtime.evaluate(make(2, 3))
    assert [r[0] for r in second.additions[Q + "answer"].collect()] == [3] and [r[0] for r in second.retractions[Q + "answer"].collect()] == [1]
    states = iter("ab")
    with pytest.raises(RetryError):
        runtime.evaluate(make(5), revisions=lambda: next(states))
    assert runtime.last is second
    with pytest.raises(ValidationError):
        runtime.evaluate({})
    with pytest.raises(ValidationError):
        QueryRuntime(spark, HEAD + "answer(?x) given (?s) :- r(?x).").evaluate(make(1))


def test_parameters_and_scan(spark):
    r = frame(spark, [(1,), (7,)], "x long")
    assert answer(spark, "answer(?x) given (?low) :- r(?x), filter num:greaterThan(?x, ?low).", {"low": 3}, r=r) == {(7,)}
    registry = builtin().with_scan("urn:x:near", 1, 1, lambda s: s.createDataFrame([(1, 10), (7, 70)], "a long, b long"))
    out = run(spark, HEAD + "answer(?x, ?y) :- r(?x), scan <urn:x:near>(?x) as ?y.", {Q + "r": r}, "answer", registry=registry)
    assert {tuple(x) for x in out.collect()} == {(1, 10), (7, 70)}
    assert isinstance(parse(HEAD + "a() :- b().").rules[0].head, Atom) and str(Var("x")) == "?x" and issubclass(ParseError, EngineError)


@pytest.mark.parametrize("op, holds", [("greaterThan", lambda a, b: a > b), ("lessThanOrEqual", lambda a, b: a <= b)])
def test_compared_pairs_are_not_made_distinct_afterwards(spark, op, holds):
    left = [(1, 2, 5), (1, 2, 9), (1, 2, 9), (2, 2, 1), (3, 1, 4)]
    right = [(7, Decimal("5.50")), (7, Decimal("0.25")), (8, Decimal("9.00")), (8, Decimal("9.00"))]
    text = f"version 1\nprefix num: <urn:dlp:numeric:>\nanswer(?c, ?s, 4) :- p(?c, 2, ?a), q(?s, ?b), filter num:{op}(?a, ?b)."
    found = run(spark, text, {"urn:dlp:query:p": spark.createDataFrame(left, "a long, n long, b int"), "urn:dlp:query:q": spark.createDataFrame(right, "s long, b decimal(9,2)")}, "answer")
    assert sorted(tuple(r) for r in found.collect()) == sorted({(c, s, 4) for c, n, a in left for s, b in right if n == 2 and holds(a, b)})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # each side is grouped below the join, nothing above it


def test_products_and_quotients_are_computed_once_a_pair(spark):
    from hornlake.functions import numeric

    calls = []
    once = numeric._once(lambda x, y: calls.append((x, y)) or numeric._quotient_of(x, y)).func
    import pyarrow as pa

    batch = [pa.array([Decimal(v) for v in vs], pa.decimal128(37, 18)) for vs in (["100", "1", "100"] * 50, ["10", "3", "10"] * 50)]
    found = once(*batch).to_pylist()
    assert len(calls) == 2 and len(found) == 150
    assert found[0] == {"value": Decimal(10), "error": None} and found[2] == found[0] and found[1]["error"].startswith("INEXACT")
