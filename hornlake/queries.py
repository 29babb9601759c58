"""The engine's own queries over the supplied tables, each with its SQL twin.

All but a few are rule programs; a query names the input relations it needs
(column expressions over a table) and the predicate it answers. Answers are
sets, so every twin is a SELECT DISTINCT or a set operation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.runtime import run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Input relations by name: table, columns, and a condition or none.
RELATIONS = {
    "customer": ("customer", ["c_custkey", "c_nationkey"], None),
    "building": ("customer", ["c_custkey"], "c_mktsegment = 'BUILDING'"),
    "segment": ("customer", ["c_custkey", "c_mktsegment"], None),
    "balance": ("customer", ["c_custkey", "c_nationkey", "cast(c_acctbal as decimal(15,2)) bal"], None),
    "orders": ("orders", ["o_orderkey", "o_custkey"], None),
    "early": ("orders", ["o_orderkey", "o_custkey"], "o_orderdate < timestamp_ntz'1995-03-15'"),
    "in1995": ("orders", ["o_orderkey", "o_custkey"], "o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'"),
    "dated": ("orders", ["o_orderkey", "o_custkey", "cast(o_orderdate as date) d"], None),
    "status": ("orders", ["o_orderkey", "o_orderstatus"], None),
    "priority": ("orders", ["o_orderkey", "o_orderpriority"], None),
    "late": ("lineitem", ["l_orderkey", "l_linenumber"], "l_shipdate > timestamp_ntz'1995-03-15'"),
    "lines": ("lineitem", ["l_orderkey", "l_suppkey"], None),
    "items": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], None),
    "shipped": ("lineitem", ["l_orderkey", "l_linenumber", "cast(l_shipdate as date) d"], None),
    "place": ("nation", ["n_nationkey", "concat('POINT(', n_nationkey * 3, ' ', n_regionkey * 4, ')') wkt"], None),
    "partsupp": ("lineitem", ["l_partkey", "l_suppkey"], None),
    "quantity": ("lineitem", ["l_orderkey", "l_linenumber", "cast(l_quantity as decimal(15,2)) q"], None),
    "supplier": ("supplier", ["s_suppkey", "s_nationkey"], None),
    "supplierBalance": ("supplier", ["s_suppkey", "s_nationkey", "cast(s_acctbal as decimal(15,2)) bal"], None),
    "nation": ("nation", ["n_nationkey", "n_regionkey"], None),
    "nationName": ("nation", ["n_nationkey", "n_name"], None),
    "region": ("region", ["r_regionkey", "r_name"], None),
    "widget": ("part", ["p_partkey"], "p_name like '%widget%'"),
    "size": ("part", ["p_partkey", "p_size"], None),
    "kind": ("part", ["p_type", "p_brand"], None),
    "brand": ("part", ["p_partkey", "p_brand"], None),
    "partType": ("part", ["p_partkey", "p_type"], None),
    "event": ("events", ["event_id", "user_id", "ts"], None),
    "eventType": ("events", ["event_id", "event_type"], None),
    "label": ("labels", ["doc_id", "quality"], None),
    "source": ("documents", ["doc_id", "source"], None),
}

PREFIXES = """version 1
prefix num: <urn:dlp:numeric:>
prefix time: <urn:dlp:temporal:>
prefix geo: <urn:dlp:spatial:>
prefix policy: <urn:dlp:calendar-policy:>
prefix internal: <urn:dlp:internal:>
"""


def relations_of(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    """The named relations, read with their columns and conditions only."""
    found = {}
    for name in names.split():
        table, columns, condition = RELATIONS[name]
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if condition:
            df = df.filter(condition)
        found[f"urn:dlp:query:{name}"] = df.selectExpr(*columns)
    return found


def rules(name: str, needs: str, text: str, sql: str, columns: list[str] | None = None, params: dict | None = None) -> None:
    """Registers a rule program whose answer is ``answer``; ``columns``: expressions over it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(spark, PREFIXES + text, relations_of(spark, sf_dir, needs), "answer", params)
        return out.selectExpr(*columns) if columns else out

    QUERIES[name] = query
    SQL[name] = sql


def frame(name: str, sql: str | None = None):
    """Registers a query built on operators rather than rules."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# joins, selection, projection

rules(
    "join_q3_component", "building early late",
    "answer(?o, ?l) :- building(?c), early(?o, ?c), late(?o, ?l).",
    """select distinct o_orderkey o, l_linenumber l from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    where c_mktsegment = 'BUILDING' and o_orderdate < '1995-03-15' and l_shipdate > '1995-03-15'""",
)
rules(
    "join_q5_component", "customer in1995 lines supplier nation region",
    'answer(?c, ?o, ?s, ?n) :- region(?r, "ASIA"), nation(?n, ?r), customer(?c, ?n), in1995(?o, ?c), lines(?o, ?s), supplier(?s, ?n).',
    """select distinct c_custkey c, o_orderkey o, s_suppkey s, n_nationkey n from customer join orders on c_custkey = o_custkey
    join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey
    join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
    where r_name = 'ASIA' and o_orderdate >= '1995-01-01' and o_orderdate < '1996-01-01'""",
)
rules(
    "join_q9_component", "widget items partsupp supplier orders nation",
    "answer(?o, ?l, ?p, ?s, ?n) :- widget(?p), items(?o, ?l, ?p, ?s), partsupp(?p, ?s), supplier(?s, ?n), orders(?o, ?c), nation(?n, ?r).",
    """select distinct l.l_orderkey o, l.l_linenumber l, p_partkey p, s_suppkey s, s_nationkey n from part join lineitem l on l.l_partkey = p_partkey
    join supplier on s_suppkey = l.l_suppkey join orders on o_orderkey = l.l_orderkey where p_name like '%widget%'""",
)
rules("cross_join", "region nationName", 'answer(?r, ?n) :- region(?k, ?r), nationName(?n, ?name).', "select distinct r_name r, n_nationkey n from region cross join nation")
rules(
    "theta_join", "balance supplierBalance",
    "answer(?c, ?s) :- balance(?c, 3, ?a), supplierBalance(?s, 3, ?b), filter num:greaterThan(?a, ?b).",
    "select distinct c_custkey c, s_suppkey s from customer join supplier on c_nationkey = 3 and s_nationkey = 3 and cast(c_acctbal as decimal(15,2)) > cast(s_acctbal as decimal(15,2))",
)
rules(
    "self_join_same_key", "orders",
    "answer(?a, ?b) :- orders(?a, ?c), orders(?b, ?c), filter num:lessThan(?a, ?b).",
    "select distinct a.o_orderkey a, b.o_orderkey b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey",
)
rules("repeated_variable", "orders", "answer(?x) :- orders(?x, ?x).", "select distinct o_orderkey x from orders where o_orderkey = o_custkey")
rules("membership_semi", "customer orders", "answer(?c) :- customer(?c, ?n), orders(?o, ?c).", "select distinct c_custkey c from customer where exists (select 1 from orders where o_custkey = c_custkey)")
rules("constant_selection", "status", 'answer(?o) :- status(?o, "F").', "select distinct o_orderkey o from orders where o_orderstatus = 'F'")
rules("head_projection", "items", 'answer(?s, 1, ?s) :- items(?o, ?l, ?p, ?s).', 'select distinct l_suppkey s, 1::bigint "one", l_suppkey s2 from lineitem', ["s", "c1 one", "s_2 s2"])
rules("conjunctive_bgp", "customer orders nationName", "answer(?o, ?n) :- orders(?o, ?c), customer(?c, ?k), nationName(?k, ?n).", "select distinct o_orderkey o, n_name n from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey")
rules("ground_probe", "region nationName", 'answer(?n) :- region(2, "ASIA"), nationName(?n, ?x).', "select distinct n_nationkey n from nation where exists (select 1 from region where r_regionkey = 2 and r_name = 'ASIA')")

# set operations

rules("union_heads", "customer supplier", "answer(?n) :- customer(?c, ?n). answer(?n) :- supplier(?s, ?n).", "select c_nationkey n from customer union select s_nationkey from supplier")
rules("intersect_unary", "customer supplier", "a(?n) :- customer(?c, ?n). b(?n) :- supplier(?s, ?n). answer(?n) :- a(?n), b(?n).", "select c_nationkey n from customer intersect select s_nationkey from supplier")
rules("enumeration", "segment", 'wanted("BUILDING") :- segment(?c, "BUILDING"). wanted("MACHINERY") :- segment(?c, "MACHINERY"). answer(?c) :- segment(?c, ?s), wanted(?s).', "select distinct c_custkey c from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
rules("active_domain", "nation region", "answer(?x) :- nation(?x, ?r). answer(?x) :- nation(?n, ?x). answer(?x) :- region(?x, ?name).", "select n_nationkey x from nation union select n_regionkey from nation union select r_regionkey from region")
rules("distinct_pairs", "lines", "answer(?o, ?s) :- lines(?o, ?s).", "select distinct l_orderkey o, l_suppkey s from lineitem")

# scalar operations

for _name, _op in (("equal", "="), ("lessThan", "<"), ("lessThanOrEqual", "<="), ("greaterThan", ">"), ("greaterThanOrEqual", ">=")):
    rules(f"filter_numeric_{_name}", "size", f"answer(?p) :- size(?p, ?z), filter num:{_name}(?z, 25).", f"select distinct p_partkey p from part where p_size {_op} 25")
rules("arith_add", "size", "answer(?p, ?v) :- size(?p, ?z), bind num:add(?z, 7) as ?v.", "select distinct p_partkey p, p_size::bigint + 7 v from part")
rules("arith_subtract", "balance", "answer(?c, ?v) :- balance(?c, ?n, ?b), bind num:subtract(?b, 100.25) as ?v.", "select distinct c_custkey c, cast(cast(c_acctbal as decimal(15,2)) - 100.25 as double) v from customer", ["c", "cast(v as double) v"])
rules("arith_multiply", "size quantity", "answer(?o, ?l, ?v) :- quantity(?o, ?l, ?q), bind num:multiply(?q, 1.5) as ?v.", "select distinct l_orderkey o, l_linenumber l, cast(cast(l_quantity as decimal(15,2)) * 1.5 as double) v from lineitem", ["o", "l", "cast(v as double) v"])
rules("arith_multiply_integers", "size", "answer(?p, ?v) :- size(?p, ?z), bind num:multiply(?z, ?z) as ?v.", "select distinct p_partkey p, p_size::bigint * p_size v from part")
rules("arith_divide_exact", "size", "answer(?p, ?v) :- size(?p, ?z), bind num:divide(?z, 8) as ?v.", "select distinct p_partkey p, cast(p_size as double) / 8 v from part", ["p", "cast(v as double) v"])
rules("to_float", "size", "answer(?p, ?v) :- size(?p, ?z), bind num:toFloat(?z) as ?f, filter num:floatLessThanOrEqual(?f, 1e1), bind num:toFloat(?z) as ?v.", "select distinct p_partkey p, p_size::double v from part where p_size <= 10")
rules(
    "quantity_ops", "quantity",
    """answer(?o, ?l, ?v, ?r) :- quantity(?o, ?l, ?q), bind num:quantity(?q, "metre") as ?m, bind num:quantity(10, "metre") as ?t,
        bind num:quantityAdd(?m, ?t) as ?v, filter num:quantityLessThanOrEqual(?t, ?m), bind num:quantityDivide(?v, ?t) as ?r.""",
    """select distinct l_orderkey o, l_linenumber l, cast(l_quantity as double) + 10 v, cast((cast(l_quantity as decimal(15,2)) + 10) / 10 as double) r
    from lineitem where l_quantity >= 10""",
    ["o", "l", "cast(v.value as double) v", "cast(r as double) r"],
)
rules("bind_agreement", "size", "answer(?p, ?z) :- size(?p, ?z), bind num:add(?z, 0.0) as ?z.", "select distinct p_partkey p, p_size z from part")
rules("eq_bind", "region", "answer(?a, ?b) :- region(?a, ?n), internal:eq(?a, ?b).", "select distinct r_regionkey a, r_regionkey b from region")
rules("neq_literals", "region", "answer(?a, ?b) :- region(?x, ?a), region(?y, ?b), internal:neq(?a, ?b).", "select distinct x.r_name a, y.r_name b from region x, region y where x.r_name <> y.r_name")
for _name, _op in (("before", "<"), ("after", ">"), ("equal", "=")):
    rules(
        f"temporal_{_name}", "dated shipped",
        f"answer(?o, ?l) :- dated(?o, ?c, ?a), shipped(?o, ?l, ?b), filter time:{_name}(?a, ?b).",
        f"select distinct o_orderkey o, l_linenumber l from orders join lineitem on l_orderkey = o_orderkey where o_orderdate::date {_op} l_shipdate::date",
    )
rules(
    "completed_years", "dated",
    'answer(?o, ?y) :- dated(?o, ?c, ?d), bind time:completedYears(?d, "2021-02-28"^^xsd:date, policy:march1) as ?y.',
    """select distinct o_orderkey o, (2021 - year(o_orderdate) - (case when month(o_orderdate) * 100 + day(o_orderdate) > 228 then 1 else 0 end))::bigint y from orders""",
)
rules(
    "interval_contains", "dated shipped",
    """answer(?o, ?l) :- dated(?o, ?c, ?a), shipped(?o, ?l, ?b), filter time:before(?a, ?b), bind time:interval(?a, ?b) as ?i,
        filter time:contains(?i, "1997-06-15"^^xsd:date).""",
    """select distinct o_orderkey o, l_linenumber l from orders join lineitem on l_orderkey = o_orderkey
    where o_orderdate::date < l_shipdate::date and o_orderdate::date <= '1997-06-15' and l_shipdate::date > '1997-06-15'""",
)
for _name, _on in (("intersects", "a.s < b.e and b.s < a.e"), ("meets", "a.e = b.s")):
    rules(
        f"interval_{_name}", "dated",
        f"""span(?o, ?c, ?i) :- dated(?o, ?c, ?d), bind time:add(?d, "P30D"^^xsd:dayTimeDuration) as ?e, bind time:interval(?d, ?e) as ?i.
        answer(?a, ?b) :- span(?a, ?c, ?x), span(?b, ?c, ?y), filter num:lessThan(?a, ?b), filter time:{_name}(?x, ?y).""",
        f"""with x as (select distinct o_orderkey o, o_custkey c, o_orderdate::date s, (o_orderdate::date + 30)::date e from orders)
        select distinct a.o a, b.o b from x a join x b on a.c = b.c and a.o < b.o and {_on}""",
    )
rules("date_add_days", "dated", 'answer(?o, ?v) :- dated(?o, ?c, ?d), bind time:add(?d, "P45D"^^xsd:dayTimeDuration) as ?v.', "select distinct o_orderkey o, strftime(o_orderdate::date + 45, '%Y-%m-%d') v from orders", ["o", "cast(v as string) v"])
rules(
    "elapsed_seconds", "event",
    'answer(?e, ?v) :- event(?e, ?u, ?t), bind time:elapsedSeconds("2024-01-01T00:00:00Z"^^xsd:dateTime, ?t) as ?v.',
    "select distinct event_id e, cast(epoch_us(ts) - epoch_us(timestamp '2024-01-01') as double) / 1000000 v from events",
    ["e", "cast(v as double) v"],
)

# minima

rules("min_group", "dated", "answer(?c, ?m) :- MIN ?d GROUP_BY ?c FROM dated(?o, ?c, ?d) AS ?m.", "select o_custkey c, strftime(min(o_orderdate)::date, '%Y-%m-%d') m from orders group by o_custkey", ["c", "cast(m as string) m"])
rules("min_global", "size", "answer(?m) :- MIN ?z GROUP_BY () FROM size(?p, ?z) AS ?m.", "select min(p_size) m from part")
rules("min_global_empty", "size", "none(?z) :- size(?p, ?z), filter num:lessThan(?z, 0). answer(?m) :- MIN ?z GROUP_BY () FROM none(?z) AS ?m.", "select p_size m from part where p_size < 0")
rules(
    "argmin_ties", "dated",
    "first(?c, ?m) :- MIN ?d GROUP_BY ?c FROM dated(?o, ?c, ?d) AS ?m. answer(?c, ?o) :- first(?c, ?m), dated(?o, ?c, ?m).",
    "select distinct c, o from (select o_custkey c, o_orderkey o, rank() over (partition by o_custkey order by o_orderdate::date) r from orders) where r = 1",
)
rules("given_param", "balance", "answer(?c) given (?limit) :- balance(?c, ?n, ?b), filter num:greaterThanOrEqual(?b, ?limit).", "select distinct c_custkey c from customer where cast(c_acctbal as decimal(15,2)) >= 5000", params={"limit": 5000})

# recursion

rules(
    "closure_nation_graph", "nation",
    """edge(?a, ?b) :- nation(?a, ?r), bind num:add(?a, 5) as ?b, filter num:lessThan(?b, 25).
    answer(?a, ?b) :- edge(?a, ?b). answer(?a, ?c) :- answer(?a, ?b), answer(?b, ?c).""",
    """with recursive e as (select n_nationkey::bigint a, n_nationkey::bigint + 5 b from nation where n_nationkey + 5 < 25),
    t as (select a, b from e union select t.a, e.b from t join e on t.b = e.a) select a, b from t""",
    ["cast(a as bigint) a", "b"],
)
_LINKS = "link(?a, ?b) :- customer(?c, ?a), orders(?o, ?c), lines(?o, ?s), supplier(?s, ?b)."
_LINK_SQL = "link as (select distinct c_nationkey a, s_nationkey b from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)"
rules(
    "reach_cyclic", "customer orders lines supplier",
    f"{_LINKS} answer(?a, ?b) :- link(?a, ?b). answer(?a, ?c) :- link(?a, ?b), answer(?b, ?c).",
    f"with recursive {_LINK_SQL}, t as (select a, b from link union select link.a, t.b from link join t on link.b = t.a) select a, b from t",
    ["a", "b"],
)
rules(
    "same_generation", "nation region",
    """parent(?n, ?r) :- nation(?n, ?r). parent(?x, ?y) :- nation(?n, ?x), bind num:add(100, 0) as ?y.
    answer(?x, ?y) :- parent(?x, ?p), parent(?y, ?p). answer(?x, ?y) :- parent(?x, ?p), answer(?p, ?q), parent(?y, ?q).""",
    """with recursive p as (select distinct n_nationkey::bigint c, n_regionkey::bigint d from nation union select distinct n_regionkey::bigint, 100::bigint from nation),
    t as (select a.c x, b.c y from p a join p b on a.d = b.d union select a.c, b.c from t join p a on a.d = t.x join p b on b.d = t.y) select x, y from t""",
    ["cast(x as bigint) x", "cast(y as bigint) y"],
)

# ontology shapes as rules

rules("sub_property", "orders lines", "related(?a, ?b) :- orders(?a, ?b). related(?a, ?b) :- lines(?a, ?b). answer(?a, ?b) :- related(?a, ?b).", "select o_orderkey a, o_custkey b from orders union select l_orderkey, l_suppkey from lineitem")
rules("inverse_property", "orders", "answer(?c, ?o) :- orders(?o, ?c).", "select distinct o_custkey c, o_orderkey o from orders")
rules("symmetric_property", "nation", "answer(?a, ?b) :- nation(?a, ?b). answer(?b, ?a) :- nation(?a, ?b).", "select n_nationkey a, n_regionkey b from nation union select n_regionkey, n_nationkey from nation")
rules("domain_range", "orders", "order(?o) :- orders(?o, ?c). customerOf(?c) :- orders(?o, ?c). answer(?c) :- customerOf(?c).", "select distinct o_custkey c from orders")
rules("exists_lhs", "building orders", "answer(?o) :- orders(?o, ?c), building(?c).", "select distinct o_orderkey o from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
rules("forall_rhs", "building orders", "answer(?o) :- building(?c), orders(?o, ?c).", "select distinct o_orderkey o from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
rules("has_value", "priority", 'answer(?o) :- priority(?o, "1-URGENT").', "select distinct o_orderkey o from orders where o_orderpriority = '1-URGENT'")
rules("disjoint_violations", "priority status", 'a(?o) :- priority(?o, "1-URGENT"). b(?o) :- status(?o, "O"). answer(?o) :- a(?o), b(?o).', "select distinct o_orderkey o from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")


# operators over frames


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate as date) s", "date_add(cast(o_orderdate as date), 30) e")


_DAY = 86_400_000_000


@frame(
    "stabbing_join",
    """with p as (select distinct l_shipdate::date as d from lineitem)
    select distinct o_orderkey, strftime(d, '%Y-%m-%d') as probe from orders join p on o_orderdate::date <= d and d < (o_orderdate::date + 30)::date""",
)
def stabbing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import disjoint, stabbing_join as join

    probes = _read(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate as date) at").distinct()
    orders = disjoint(_orders(spark, sf_dir).select("o_orderkey", "s", "e"), ["o_orderkey"], "s", "e")
    found = join(orders, F.broadcast(probes), "s", "e", "at", 30 * _DAY)  # as many probes as the calendar has days at most, 3,652,059
    return found.selectExpr("o_orderkey", "cast(at as string) probe")


@frame(
    "overlap_join",
    """select a.o_orderkey x, b.o_orderkey y from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
    and a.o_orderdate::date < b.o_orderdate::date + 30 and b.o_orderdate::date < a.o_orderdate::date + 30""",
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import overlap_join as join

    a, b = (_orders(spark, sf_dir).toDF(f"{k}", "o_custkey", f"{k}s", f"{k}e") for k in "xy")
    return join(a, b, ["o_custkey"], ("xs", "xe"), ("ys", "ye"), 30 * _DAY).filter("x < y").select("x", "y")


rules(
    "bitemporal_lookup", "dated shipped",
    """valid(?o, ?i) :- dated(?o, ?c, ?a), bind time:add(?a, "P365D"^^xsd:dayTimeDuration) as ?e, bind time:interval(?a, ?e) as ?i.
    recorded(?o, ?i) :- shipped(?o, 1, ?a), bind time:add(?a, "P90D"^^xsd:dayTimeDuration) as ?e, bind time:interval(?a, ?e) as ?i.
    answer(?o) :- valid(?o, ?v), recorded(?o, ?r), filter time:contains(?v, "1997-06-15"^^xsd:date), filter time:contains(?r, "1998-01-01"^^xsd:date).""",
    """select distinct o_orderkey o from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1
    where o_orderdate::date <= '1997-06-15' and o_orderdate::date + 365 > '1997-06-15' and l_shipdate::date <= '1998-01-01' and l_shipdate::date + 90 > '1998-01-01'""",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id", "user_id key", "unix_micros(cast(ts as timestamp)) event_time", "event_type", "value")


_END = 1_705_622_400_000_000  # 2024-01-19 00:00 UTC
_WEEK = 7 * _DAY
_EVENTS_SQL = "e as (select event_id, user_id k, epoch_us(ts) t, event_type from events)"


@frame("window_rows", f"with {_EVENTS_SQL} select event_id from e where t >= {_END - _WEEK} and t < {_END}")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import window_rows as rows

    return rows(_events(spark, sf_dir), _END, _WEEK).select("event_id")


@frame("window_history", f"with {_EVENTS_SQL} select event_id from e where t >= {_END - _WEEK} and t < {_END} union all select event_id from (select *, row_number() over (partition by k order by t desc, event_id desc) n from e where t < {_END - _WEEK}) where n = 1")
def window_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import history

    return history(_events(spark, sf_dir), _END, _WEEK).select("event_id")


@frame("window_predecessor", f"with {_EVENTS_SQL} select * from (select event_id, lag(event_id) over (partition by k order by t, event_id) previous from e) where previous is not null")
def window_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import predecessor

    return predecessor(_events(spark, sf_dir), "key", "event_time", "event_id").select("event_id", "previous").filter("previous is not null")


@frame("window_entries", f"with {_EVENTS_SQL}, l as (select *, lag(event_type = 'purchase') over (partition by k order by t, event_id) w from e where t < {_END}) select event_id from l where event_type = 'purchase' and not w and t >= {_END - _WEEK}")
def window_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import entries

    return entries(_events(spark, sf_dir), _END, _WEEK, F.col("event_type") == "purchase").select("event_id")


@frame("window_late", f"with {_EVENTS_SQL} select event_id from e where t < {_END - _DAY}")
def window_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import late

    return late(_events(spark, sf_dir), _END, _DAY).select("event_id")


@frame("window_expired", f"with {_EVENTS_SQL}, r as (select *, row_number() over (partition by k order by t desc, event_id desc) n from e where t < {_END - _WEEK}) select event_id from r where n > 1 and t < {_END - _WEEK}")
def window_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import expired

    return expired(_events(spark, sf_dir), _END, _WEEK, _END, _DAY).select("event_id")


@frame("window_changes", f"with {_EVENTS_SQL} select 'add' op, event_id from e where t >= {_END} and t < {_END + _DAY} union all select 'remove', event_id from e where t >= {_END - _WEEK} and t < {_END - _WEEK + _DAY}")
def window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import changes, window_rows as rows

    events = _events(spark, sf_dir).select("event_id", "event_time")
    return changes(rows(events, _END, _WEEK), rows(events, _END + _DAY, _WEEK)).select("op", "event_id")


@frame("latest_revision", "select k, event_id from (select user_id k, event_id, row_number() over (partition by user_id order by event_id desc) n from events) where n = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.windows import latest

    return latest(_read(spark, sf_dir, "events").selectExpr("user_id k", "event_id", "event_id revision"), "k", "revision").select("k", "event_id")


@frame("tumbling_min", "select epoch_us(date_trunc('hour', ts)) as hour_start, min(event_id) as first_id from events group by 1")
def tumbling_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.col("event_time") / 3_600_000_000) * 3_600_000_000
    return _events(spark, sf_dir).groupBy(hour.cast("long").alias("hour_start")).agg(F.min("event_id").alias("first_id"))


def _changed(which: str) -> Query:
    """Additions or retractions of an answer when its input changes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.runtime import QueryRuntime

        runtime = QueryRuntime(spark, PREFIXES + "answer(?c) :- orders(?o, ?c).")
        orders = _read(spark, sf_dir, "orders")
        for condition in ("o_orderdate < timestamp_ntz'1996-01-01'", "o_orderdate >= timestamp_ntz'1995-06-01' and o_orderdate < timestamp_ntz'1996-06-01'"):
            result = runtime.evaluate({"urn:dlp:query:orders": orders.filter(condition).select("o_orderkey", "o_custkey")})
        return getattr(result, which)["urn:dlp:query:answer"].toDF("c")

    return query


_OLD, _NEW = "select o_custkey c from orders where o_orderdate < '1996-01-01'", "select o_custkey c from orders where o_orderdate >= '1995-06-01' and o_orderdate < '1996-06-01'"
frame("delta_additions", f"{_NEW} except {_OLD}")(_changed("additions"))
frame("delta_retractions", f"{_OLD} except {_NEW}")(_changed("retractions"))


def _points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Invented places from keys, near the antimeridian among others."""
    i = F.col(key)
    return _read(spark, sf_dir, table).select(i, (F.pmod(i * 7919, F.lit(3600)) / 10 - 180).alias("lon"), (F.pmod(i * 104729, F.lit(1600)) / 10 - 80).alias("lat"))


_PLACE = """select {0} id, ((({0} * 7919) % 3600) / 10.0 - 180)::double lon, ((({0} * 104729) % 1600) / 10.0 - 80)::double lat from {1}"""
_E2 = "(1 / 298.257223563 * (2 - 1 / 298.257223563))"
_SPOT = f"""select id, r * cos(radians(lat)) * cos(radians(lon)) x, r * cos(radians(lat)) * sin(radians(lon)) y, r * (1 - {_E2}) * sin(radians(lat)) z
from (select *, 6378137 / sqrt(1 - {_E2} * sin(radians(lat)) ** 2) r from {{}})"""


@frame(
    "ecef_candidates",
    f"""with p as ({_PLACE.format("c_custkey", "customer")}), q as ({_PLACE.format("s_suppkey", "supplier")}), a as ({_SPOT.format("p")}), b as ({_SPOT.format("q")})
    select a.id c_custkey, b.id s_suppkey from a join b on abs(a.x - b.x) <= 200000.0002 and abs(a.y - b.y) <= 200000.0002 and abs(a.z - b.z) <= 200000.0002""",
)
def ecef_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import candidates

    a, b = _points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey").toDF("s_suppkey", "lon2", "lat2")
    return candidates(a, b, 200_000.0, ("lon", "lat"), ("lon2", "lat2")).select("c_custkey", "s_suppkey")


@frame("dwithin_join")
def dwithin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import radius_join

    a, b = _points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey").toDF("s_suppkey", "lon2", "lat2")
    return radius_join(a, b, 200_000.0, ("lon", "lat"), ("lon2", "lat2")).select("c_custkey", "s_suppkey", F.round("metres", 3).alias("metres"))


rules("wgs84_point", "size", "answer(?p, ?d) :- size(?p, ?z), bind geo:wgs84Point(?z, 0) as ?a, bind geo:wgs84Point(?z, 0) as ?b, bind geo:wgs84Distance(?a, ?b) as ?d, filter geo:dwithin(?a, ?b, 0).", "select distinct p_partkey p, 0::double d from part")

_ROADS = "road as (select distinct n_nationkey a, (n_nationkey * 3 + 1) % 25 b, 10 + n_regionkey m from nation union select distinct n_nationkey, (n_nationkey + 2) % 25, 30 from nation)"


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return n.selectExpr("n_nationkey src", "(n_nationkey * 3 + 1) % 25 dst", "double(10 + n_regionkey) metres").union(n.selectExpr("n_nationkey", "(n_nationkey + 2) % 25", "30D"))


@frame("shortest_distance", f"with recursive {_ROADS}, t as (select n_nationkey s, n_nationkey n, 0 d from nation union select s, b, d + m from t join road on n = a where d < 400) select s source, n node, min(d)::double metres from t group by s, n")
def shortest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.graphs import shortest_distances

    return shortest_distances(_roads(spark, sf_dir), _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))


@frame("route_status", f"with recursive {_ROADS}, t as (select n_nationkey s, n_nationkey n, 0 d from nation union select s, b, d + m from t join road on n = a where d < 400), q as (select a.n_nationkey s, b.n_nationkey + 20 d from nation a, nation b) select q.s src, q.d dst, case when q.d >= 25 then 'out_of_region' when min(t.d) is null then 'no_route' else 'ok' end status, coalesce(case when q.d < 25 then min(t.d)::double end, -1) metres from q left join t on t.s = q.s and t.n = q.d group by q.s, q.d")
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.graphs import route_status as status

    n = _read(spark, sf_dir, "nation").select("n_nationkey")
    queries = n.selectExpr("n_nationkey src", "explode(sequence(20, 44)) dst")
    return status(_roads(spark, sf_dir), n.selectExpr("n_nationkey id"), queries).fillna(-1.0, ["metres"])


@frame("affected_closure", "with recursive d as (select distinct o_custkey * 10 id, o_orderkey * 10 + 1 needs from orders union select distinct l_orderkey * 10 + 1, l_suppkey * 10 + 2 from lineitem), t as (select s_suppkey * 10 + 2 id from supplier where s_acctbal < 3000 union select d.id from t join d on d.needs = t.id) select id from t")
def affected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.graphs import affected

    needs = _read(spark, sf_dir, "orders").selectExpr("o_custkey * 10 id", "o_orderkey * 10 + 1 needs").union(_read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + 1", "l_suppkey * 10 + 2"))
    return affected(needs.distinct(), _read(spark, sf_dir, "supplier").filter("s_acctbal < 3000").selectExpr("s_suppkey * 10 + 2 id"))


def _ontology(spark: SparkSession, facts: DataFrame, text: str):
    """The closure of rules of an ontology text over a table of facts (p, s, o), complete or not at all."""
    from .errors import IncompleteError
    from .ontology.compiler import compile_graph
    from .ontology.syntax import parse_ontology
    from .plans.closure import Reckoner, facts_frame

    compiled = compile_graph(parse_ontology(f"Namespace(ex = <urn:x:>) Ontology({text})"))
    if compiled.facts:  # what the text itself states
        facts = facts.unionByName(facts_frame(spark, compiled.facts))
    found = Reckoner(spark, compiled, facts=None).closure(facts)
    if not found.complete:
        raise IncompleteError(found.reason)
    return found


@frame("class_taxonomy", "select distinct p_partkey part, unnest(['Item', 'Part', case when p_size > 25 then 'Large' else 'Small' end]) class from part")
def class_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _read(spark, sf_dir, "part").selectExpr("case when p_size > 25 then 'urn:x:Large' else 'urn:x:Small' end p", "concat('<urn:part:', p_partkey, '>') s", "cast(null as string) o")
    found = _ontology(spark, facts, "SubClassOf(ex:Large ex:Part) SubClassOf(ex:Small ex:Part) SubClassOf(ex:Part ex:Item)").facts
    return found.selectExpr("cast(regexp_extract(s, '(\\\\d+)', 1) as bigint) part", "substring(p, 7) class").distinct()


@frame(
    "functional_equality",
    """with recursive p as (select distinct doc_id, sha256(text) k from documents), m as (select k, min(doc_id) r from p group by k)
    select p.doc_id, m.r representative from p join m using (k)""",
)
def functional_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one text are one: an inverse functional key merges them; the smallest id stands for them."""
    name = "concat('<urn:doc:', lpad(doc_id, 12, '0'), '>')"
    facts = _read(spark, sf_dir, "documents").selectExpr("'urn:x:key' p", f"{name} s", "concat('<urn:key:', sha2(text, 256), '>') o")
    found = _ontology(spark, facts, "ObjectProperty(ex:key InverseFunctional)")
    number = lambda c: F.regexp_extract(c, r"<urn:doc:(\d+)>", 1).cast("long")
    merged = found.aliases.select(number("node").alias("doc_id"), number("rep").alias("representative"))
    alone = found.facts.filter("p = 'urn:x:key'").select(number("s").alias("doc_id"), number("s").alias("representative"))
    return merged.union(alone).distinct()


_ABOUT = "with a as (select doc_id, source from documents), c as (select source, min(quality) lo, max(quality) hi from a left join labels using (doc_id) group by source)"


@frame("date_selection", f"{_ABOUT} select source, case when lo is null then 'missing' when lo <> hi then 'conflicting' else 'accepted' end state from c")
def date_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose labelled documents agree in quality."""
    from .views import select_one

    about = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("id"))
    rows = about.join(_read(spark, sf_dir, "labels"), "doc_id")
    accepted, diagnostics = select_one(rows, about, F.col("quality"), F.lit(True), ("missing", "invalid", "conflicting"))
    return accepted.select(F.col("id").alias("source"), F.lit("accepted").alias("state")).union(diagnostics.select("id", "code"))


@frame("osm_change_apply", "select o_orderkey id, case when o_orderkey % 10 = 1 then 2 else 1 end::bigint version from orders where o_orderkey % 10 <> 3 union all select o_orderkey + 10000000, 1 from orders where o_orderkey % 10 = 5")
def osm_change_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned elements after creates, modifications and deletions."""
    from .sources.osm import apply_changes

    ids = _read(spark, sf_dir, "orders").select("o_orderkey").distinct()
    make = lambda df, v, *first: df.selectExpr(*first, "'node' type", "o_orderkey id", f"bigint({v}) version", "1D lat", "2D lon", "cast(array() as array<bigint>) nodes", "cast(array() as array<struct<type: string, ref: bigint, role: string>>) members", "map('k', 'v') tags", "'' timestamp", "'' changeset")
    state = make(ids, 1)
    changes = make(ids.filter("o_orderkey % 10 = 1"), 2, "'modify' action").union(make(ids.filter("o_orderkey % 10 = 3"), 2, "'delete' action")).union(make(ids.filter("o_orderkey % 10 = 5").selectExpr("o_orderkey + 10000000 o_orderkey"), 1, "'create' action"))
    new, _ = apply_changes(state, changes)
    return new.select("id", "version")


# ontologies over tables


def _numbered(c: str, column: str):
    return F.regexp_extract(column, rf"<urn:{c}:(\d+)>", 1).cast("long")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and their classes as facts (p, s, o)."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    customer = "concat('<urn:c:', c_custkey, '>')"
    order, none = "concat('<urn:o:', o_orderkey, '>')", "cast(null as string) o"
    frames = [
        customers.selectExpr("'urn:x:Customer' p", f"{customer} s", none),
        orders.selectExpr("'urn:x:hasOrder' p", "concat('<urn:c:', o_custkey, '>') s", f"{order} o"),
        orders.filter("o_orderpriority = '1-URGENT'").selectExpr("'urn:x:Urgent' p", f"{order} s", none),
        orders.filter("o_orderstatus = 'F'").selectExpr("'urn:x:Filled' p", f"{order} s", none),
        orders.selectExpr("'urn:x:status' p", f"{order} s", "to_json(named_struct('v', o_orderstatus)) o").selectExpr("p", "s", "regexp_extract(o, ':(.*).$', 1) o"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


_URGENT = "select distinct o_custkey from orders where o_orderpriority = '1-URGENT'"


@frame("ontology_exists_definition", f"select o_custkey customer from ({_URGENT}) where o_custkey in (select c_custkey from customer)")
def ontology_exists_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete definition: those with some urgent order are pressed."""
    text = "Class(ex:Pressed complete intersectionOf(ex:Customer restriction(ex:hasOrder someValuesFrom(ex:Urgent))))"
    found = _ontology(spark, _customers(spark, sf_dir), text).facts
    return found.filter("p = 'urn:x:Pressed'").select(_numbered("c", "s").alias("customer")).distinct()


@frame("ontology_forall", f"select distinct o_orderkey as order_id from orders where o_custkey in ({_URGENT})")
def ontology_forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the pressed are watched."""
    text = "SubClassOf(restriction(ex:hasOrder someValuesFrom(ex:Urgent)) ex:Pressed) SubClassOf(ex:Pressed restriction(ex:hasOrder allValuesFrom(ex:Watched)))"
    found = _ontology(spark, _customers(spark, sf_dir), text).facts
    return found.filter("p = 'urn:x:Watched'").select(_numbered("o", "s").alias("order_id")).distinct()


@frame("ontology_union_value", "select distinct o_orderkey as order_id from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'O'")
def ontology_union_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ontology(spark, _customers(spark, sf_dir), 'SubClassOf(unionOf(ex:Urgent restriction(ex:status value("O"))) ex:Open)').facts
    return found.filter("p = 'urn:x:Open'").select(_numbered("o", "s").alias("order_id")).distinct()


@frame("ontology_roles", "select o_orderkey as order_id, o_custkey customer from orders where o_orderkey is not null group by 1, 2")
def ontology_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverse of a superproperty."""
    found = _ontology(spark, _customers(spark, sf_dir), "ObjectProperty(ex:hasOrder super(ex:owns)) ObjectProperty(ex:owns inverseOf(ex:ownedBy))").facts
    return found.filter("p = 'urn:x:ownedBy'").select(_numbered("o", "s").alias("order_id"), _numbered("c", "o").alias("customer")).distinct()


@frame("ontology_domain_range", "select 'Buyer' class, o_custkey id from orders group by 2 union all select 'Bought', o_orderkey from orders group by 2")
def ontology_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ontology(spark, _customers(spark, sf_dir), "ObjectProperty(ex:hasOrder domain(ex:Buyer) range(ex:Bought))").facts
    kept = found.filter("p in ('urn:x:Buyer', 'urn:x:Bought')")
    return kept.select(F.substring("p", 7, 9).alias("class"), F.regexp_extract("s", r"(\d+)", 1).cast("long").alias("id")).distinct()


@frame("ontology_violations", "select distinct o_orderkey as order_id from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def ontology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instance of a violated disjointness."""
    from .ontology.compiler import compile_graph
    from .ontology.syntax import parse_ontology
    from .plans.closure import Reckoner

    compiled = compile_graph(parse_ontology("Namespace(ex = <urn:x:>) Ontology(DisjointClasses(ex:Urgent ex:Filled))"))
    rows = Reckoner(spark, compiled).violation_rows(_customers(spark, sf_dir))
    return rows.select(_numbered("o", "bindings.x0").alias("order_id")).distinct()


@frame("ontology_witnesses", "select distinct c_custkey customer from customer")
def ontology_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer has some account, unnamed."""
    found = _ontology(spark, _customers(spark, sf_dir), "SubClassOf(ex:Customer restriction(ex:hasAccount someValuesFrom(ex:Account)))").facts
    return found.filter("p = 'urn:x:hasAccount' and o like 'sk:%'").select(_numbered("c", "s").alias("customer")).distinct()


@frame("type_view", "select 'Customer' class, c_custkey id from customer group by 2 union all select 'Party', c_custkey from customer group by 2")
def type_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rdf:type of every class member, derived classes included."""
    facts = _read(spark, sf_dir, "customer").selectExpr("'urn:x:Customer' p", "concat('<urn:c:', c_custkey, '>') s", "cast(null as string) o")
    found = _ontology(spark, facts, "SubClassOf(ex:Customer ex:Party)").facts
    return found.filter("o is null and p like 'urn:x:%'").select(F.substring("p", 7, 20).alias("class"), _numbered("c", "s").alias("id")).distinct()


def _maintained(add: str, remove: str) -> Query:
    """The closure of a nation graph after facts came and went, maintained rather than rebuilt."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .ontology.syntax import parse_ontology
        from .reasoner import Reasoner

        keys = [r["n_nationkey"] for r in _read(spark, sf_dir, "nation").select("n_nationkey").distinct().collect()]  # the nation table: a few rows
        name = lambda k: f"<urn:n:{k}>"
        edges = lambda step, mod, of: [(name(k), "<urn:x:to>", name(k + step)) for k in sorted(keys) if k % mod == of and k + step < 25]
        base = [*parse_ontology("Namespace(ex = <urn:x:>) Ontology(ObjectProperty(ex:to Transitive))"), *edges(4, 1, 0)]
        reasoner = Reasoner(spark, base, "L0")
        come, gone = edges(5, 5, 0) if add else [], edges(4, 3, 1) if remove else []
        reasoner.update(come, gone)
        pairs = reasoner.property_relation("urn:x:to")
        return pairs.select(_numbered("n", "x").alias("a"), _numbered("n", "y").alias("b"))

    return query


_GRAPH = "with recursive e as ({edges}), t as (select a, b from e union select t.a, e.b from t join e on t.b = e.a) select a, b from t"
_FOUR = "select n_nationkey::bigint a, n_nationkey::bigint + 4 b from nation where n_nationkey + 4 < 25"
_FIVE = "select n_nationkey::bigint a, n_nationkey::bigint + 5 b from nation where n_nationkey + 5 < 25 and n_nationkey % 5 = 0"
frame("maintain_insert", _GRAPH.format(edges=f"{_FOUR} union {_FIVE}"))(_maintained("add", ""))
frame("maintain_delete", _GRAPH.format(edges=f"{_FOUR} and n_nationkey % 3 <> 1"))(_maintained("", "remove"))
frame("maintain_mixed", _GRAPH.format(edges=f"{_FOUR} and n_nationkey % 3 <> 1 union {_FIVE}"))(_maintained("add", "remove"))

rules(
    "mutual_recursion", "nation",
    """step(?a, ?b) :- nation(?a, ?r), bind num:add(?a, 1) as ?b, filter num:lessThan(?b, 25).
    odd(?a, ?b) :- step(?a, ?b). odd(?a, ?c) :- answer(?a, ?b), step(?b, ?c). answer(?a, ?c) :- odd(?a, ?b), step(?b, ?c).""",
    "select a.n_nationkey::bigint a, b.n_nationkey::bigint c from nation a, nation b where b.n_nationkey > a.n_nationkey and (b.n_nationkey - a.n_nationkey) % 2 = 0",
    ["cast(a as bigint) a", "cast(c as bigint) c"],
)
rules(
    "minimum_over_recursion", "nation",
    """step(?a, ?b) :- nation(?a, ?r), bind num:add(?a, 7) as ?b, filter num:lessThan(?b, 25).
    reach(?a, ?b) :- step(?a, ?b). reach(?a, ?c) :- reach(?a, ?b), reach(?b, ?c). answer(?b, ?m) :- MIN ?a GROUP_BY ?b FROM reach(?a, ?b) AS ?m.""",
    "select n_nationkey::bigint b, (n_nationkey % 7)::bigint m from nation where n_nationkey >= 7",
    ["cast(b as bigint) b", "cast(m as bigint) m"],
)
rules("duration_add", "event", 'answer(?e) :- event(?e, ?u, ?t), bind time:add("PT1H"^^xsd:dayTimeDuration, "PT30M"^^xsd:dayTimeDuration) as ?d, bind time:add(?t, ?d) as ?v, filter time:before(?v, "2024-01-05T12:00:00Z"^^xsd:dateTime).', "select distinct event_id e from events where ts + interval 90 minute < timestamp '2024-01-05 12:00:00'")
rules("quantity_compare", "quantity", 'answer(?o, ?l) :- quantity(?o, ?l, ?q), bind num:quantity(?q, "kmh") as ?a, bind num:quantity(25, "kmh") as ?b, filter num:quantityEqual(?a, ?b).', "select distinct l_orderkey o, l_linenumber l from lineitem where l_quantity = 25")
rules("quantity_subtract", "quantity", 'answer(?o, ?l, ?v) :- quantity(?o, ?l, ?q), bind num:quantity(?q, "second") as ?a, bind num:quantity(0.5, "second") as ?b, bind num:quantitySubtract(?a, ?b) as ?v.', "select distinct l_orderkey o, l_linenumber l, l_quantity - 0.5 v from lineitem", ["o", "l", "cast(v.value as double) v"])


@frame("provider_scalar", "select distinct p_partkey part, case when p_size % 2 = 0 then 'ok' else 'no_match' end status, case when p_size % 2 = 0 then p_size::double * p_size else -1 end value from part")
def provider_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar provider over distinct arguments, answers joined back."""
    from pyspark.sql import types as T

    from .sources.providers import FakeProvider, evaluate

    squares = FakeProvider({("square", k): float(k * k) for k in range(0, 200, 2)})
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey part", "cast(p_size as bigint) size").distinct()
    return evaluate(rows, squares, "square", ["size"], T.DoubleType()).selectExpr("part", "result.status status", "coalesce(result.value, -1D) value")


@frame("provider_scan", "select distinct n_nationkey nation, n_nationkey::bigint + 100 candidate from nation")
def provider_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's enumeration joined to rule bindings."""
    from .functions import builtin
    from .sources.providers import FakeProvider, scan_relation

    provider = FakeProvider(scans={"near": [(k, k + 100) for k in range(25)]})
    registry = builtin().with_scan("urn:x:near", 1, 1, scan_relation(provider, "near", "a long, b long"))
    text = PREFIXES + "answer(?nation, ?candidate) :- nation(?nation, ?r), scan <urn:x:near>(?nation) as ?candidate."
    return run(spark, text, relations_of(spark, sf_dir, "nation"), "answer", registry=registry)


@frame("planar_within", "select a.n_nationkey a, b.n_nationkey b, sqrt(pow((a.n_nationkey - b.n_nationkey) * 3.0, 2) + pow((a.n_regionkey - b.n_regionkey) * 4.0, 2)) metres from nation a, nation b where pow((a.n_nationkey - b.n_nationkey) * 3.0, 2) + pow((a.n_regionkey - b.n_regionkey) * 4.0, 2) <= 36")
def planar_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a projected plane within a radius, boundary included."""
    from .operators.planar import ingest, radius_pairs

    places = ingest(_read(spark, sf_dir, "nation").selectExpr("n_nationkey id", "concat('POINT(', n_nationkey * 3, ' ', n_regionkey * 4, ')') wkt"), "EPSG:25832")
    return radius_pairs(places, places, 6.0).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "metres")


_SPOTS = 'place(?a, ?w), place(?b, ?v), bind geo:geometry(?w, "EPSG:25832") as ?g, bind geo:geometry(?v, "EPSG:25832") as ?h'
_BOX = 'place(?a, ?w), bind geo:geometry(?w, "EPSG:25832") as ?g, bind geo:geometry("POLYGON((0 0, 30 0, 30 8, 0 8, 0 0))", "EPSG:25832") as ?box'
rules("planar_rule_distance", "place", f"answer(?a, ?b, ?d) :- {_SPOTS}, bind geo:planarDistance(?g, ?h) as ?d.", "select a.n_nationkey a, b.n_nationkey b, sqrt(pow((a.n_nationkey - b.n_nationkey) * 3.0, 2) + pow((a.n_regionkey - b.n_regionkey) * 4.0, 2)) d from nation a, nation b")
rules("planar_rule_within", "place", f"answer(?a, ?b) :- {_SPOTS}, filter geo:planarDwithin(?g, ?h, 6).", "select a.n_nationkey a, b.n_nationkey b from nation a, nation b where pow((a.n_nationkey - b.n_nationkey) * 3.0, 2) + pow((a.n_regionkey - b.n_regionkey) * 4.0, 2) <= 36")
rules("planar_rule_contains", "place", f"answer(?a) :- {_BOX}, filter geo:contains(?box, ?g).", "select distinct n_nationkey a from nation where n_nationkey * 3 > 0 and n_nationkey * 3 < 30 and n_regionkey * 4 > 0 and n_regionkey * 4 < 8")
rules("planar_rule_covers", "place", f"answer(?a) :- {_BOX}, filter geo:covers(?box, ?g).", "select distinct n_nationkey a from nation where n_nationkey * 3 between 0 and 30 and n_regionkey * 4 between 0 and 8")
rules("planar_rule_intersects", "place", f"answer(?a) :- {_BOX}, filter geo:intersects(?g, ?box).", "select distinct n_nationkey a from nation where n_nationkey * 3 between 0 and 30 and n_regionkey * 4 between 0 and 8")


@frame("planar_candidates", "select a.n_nationkey a, b.n_nationkey b from nation a, nation b where abs(floor(a.n_nationkey * 3 / 6.0) - floor(b.n_nationkey * 3 / 6.0)) <= 1 and abs(floor(a.n_regionkey * 4 / 6.0) - floor(b.n_regionkey * 4 / 6.0)) <= 1")
def planar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points in neighbouring cells: all that may lie within the radius, and some more."""
    from .operators.planar import ingest, point_candidates

    places = ingest(_read(spark, sf_dir, "nation").selectExpr("n_nationkey id", "concat('POINT(', n_nationkey * 3, ' ', n_regionkey * 4, ')') wkt"), "EPSG:25832")
    return point_candidates(places, places, 6.0).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@frame("osm_projection", "select 'latitude' prop, count(distinct o_orderkey) n from orders union all select 'name', count(distinct o_orderkey) from orders union all select 'tagKey', count(distinct o_orderkey) from orders")
def osm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often some properties occur in the projection of elements made of orders."""
    from .sources.osm import project, validate

    rows = _read(spark, sf_dir, "orders").select("o_orderkey").distinct().selectExpr("'node' type", "o_orderkey id", "1L version", "1D lat", "2D lon", "cast(array() as array<bigint>) nodes", "cast(array() as array<struct<type: string, ref: bigint, role: string>>) members", "map('name', 'v') tags", "'' timestamp", "'' changeset")
    named = project(validate(rows), "s", once=True).select(F.regexp_extract("p", "#(.*)>$", 1).alias("prop"))
    return named.filter("prop in ('latitude', 'name', 'tagKey')").groupBy("prop").agg(F.count("*").alias("n"))


from . import table_ontologies  # noqa: E402, F401  registers more
