"""Dates, instants, durations and half-open intervals of either; times of day too.

Columns of type TIME need the session's spark.sql.timeType.enabled.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .registry import URN, Operation, Result, Typed, domain, fail, type_error

_DAY = 86_400_000_000
#: The one calendar policy: a birthday of 29 February counts on 1 March. A fixed value.
MARCH1 = "urn:dlp:calendar-policy:march1"


def _micros(x: Typed):
    """Microseconds of an instant or a duration."""
    if isinstance(x.type, T.TimestampType):
        return F.unix_micros(x.col)
    day, hour, minute, second = (F.extract(F.lit(p), x.col) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = ((day * 24 + hour) * 60 + minute).cast("long") * 60_000_000
    return whole + (second * 1_000_000).cast("long")


def _compare(test):
    def build(a: Typed, b: Typed) -> Result:
        if domain(a.type) not in ("date", "instant", "duration", "time") or domain(a.type) != domain(b.type):
            return type_error("temporal comparison")
        return Result(test(a.col, b.col))

    return build


def _completed_years(birth: Typed, at: Typed, policy: Typed) -> Result:
    if domain(birth.type) != "date" or domain(at.type) != "date":
        return type_error("temporal:completedYears")
    key = lambda x: F.month(x) * 100 + F.dayofmonth(x)
    years = F.year(at.col) - F.year(birth.col) - (key(at.col) < key(birth.col)).cast("int")
    wrong = fail(policy.col != f"<{MARCH1}>", "DOMAIN_ERROR", "unknown calendar policy")
    return Result(years.cast("long"), F.coalesce(wrong, fail(at.col < birth.col, "DOMAIN_ERROR", "the date precedes the birth")))


def _interval(start: Typed, end: Typed) -> Result:
    if domain(start.type) not in ("date", "instant") or domain(start.type) != domain(end.type):
        return type_error("temporal:interval")
    return Result(F.struct(start.col.alias("start"), end.col.alias("end")), fail(start.col >= end.col, "DOMAIN_ERROR", "an interval must start before its end"))


def _inner(x: Typed) -> T.DataType | None:
    return x.type["start"].dataType if isinstance(x.type, T.StructType) and x.type.fieldNames() == ["start", "end"] else None


def _contains(x: Typed, at: Typed) -> Result:
    if _inner(x) is None or domain(_inner(x)) != domain(at.type):
        return type_error("temporal:contains")
    return Result((x.col["start"] <= at.col) & (at.col < x.col["end"]))


def _pair(test, name: str):
    def build(a: Typed, b: Typed) -> Result:
        if _inner(a) is None or _inner(b) is None or domain(_inner(a)) != domain(_inner(b)):
            return type_error(f"temporal:{name}")
        return Result(test(a.col, b.col))

    return build


def _add(t: Typed, d: Typed) -> Result:
    if domain(d.type) != "duration":
        return type_error("temporal:add")
    micros = _micros(d)
    match domain(t.type):
        case "date":
            days = F.floor(micros / _DAY).cast("int")
            value = F.date_add(t.col, days)
            part = fail(F.pmod(micros, F.lit(_DAY)) != 0, "DOMAIN_ERROR", "a date takes whole days")
            return Result(value, F.coalesce(part, fail((F.year(value) > 9999) | (F.year(value) < 1), "OVERFLOW", "the date leaves years 1 to 9999")))
        case "instant":
            total = F.try_add(_micros(t), micros)
            return Result(F.timestamp_micros(F.coalesce(total, F.lit(0))), fail(total.isNull(), "OVERFLOW", "the instant exceeds 64 bits"))
        case "duration":
            total = F.try_add(_micros(t), micros)
            value = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.coalesce(total, F.lit(0)) / F.lit(1_000_000)).cast("decimal(18,6)"))
            return Result(value, fail(total.isNull(), "OVERFLOW", "the duration exceeds 64 bits"))
        case "time":
            seconds = F.time_diff(F.lit("MICROSECOND"), F.make_time(F.lit(0), F.lit(0), F.lit(0)), t.col) + micros
            ok = (seconds >= 0) & (seconds < _DAY)
            return Result(F.when(ok, t.col + d.col), fail(~ok, "DOMAIN_ERROR", "the time leaves its day"))
    return type_error("temporal:add")


def _elapsed(start: Typed, end: Typed) -> Result:
    if domain(start.type) != "instant" or domain(end.type) != "instant":
        return type_error("temporal:elapsedSeconds")
    micros = F.try_subtract(F.unix_micros(end.col), F.unix_micros(start.col))
    # a shift of the scale, not a division
    text = F.concat(F.when(micros < 0, "-").otherwise(""), F.abs(micros).cast("decimal(38,0)").cast("string"))
    return Result((text.cast("decimal(25,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(37,18)"), fail(micros.isNull(), "OVERFLOW", "the difference exceeds 64 bits"))


OPERATIONS = [
    Operation(f"{URN}temporal:before", 2, _compare(lambda a, b: a < b), boolean=True),
    Operation(f"{URN}temporal:after", 2, _compare(lambda a, b: a > b), boolean=True),
    Operation(f"{URN}temporal:equal", 2, _compare(lambda a, b: a == b), boolean=True),
    Operation(f"{URN}temporal:completedYears", 3, _completed_years),
    Operation(f"{URN}temporal:interval", 2, _interval),
    Operation(f"{URN}temporal:contains", 2, _contains, boolean=True),
    Operation(f"{URN}temporal:intersects", 2, _pair(lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]), "intersects"), boolean=True),
    Operation(f"{URN}temporal:meets", 2, _pair(lambda a, b: a["end"] == b["start"], "meets"), boolean=True),
    Operation(f"{URN}temporal:add", 2, _add),
    Operation(f"{URN}temporal:elapsedSeconds", 2, _elapsed),
]
