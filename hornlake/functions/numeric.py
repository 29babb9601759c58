"""Exact integers and decimals, binary64 and quantities.

Integers are signed 64-bit; decimals have a 64-bit coefficient and a scale of at
most 18, held as DECIMAL(37,18). Sums and products of integers stay integers,
all else is decimal, and what can't be told exactly is an error.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .registry import INTEGERS, URN, Operation, Result, Typed, fail, type_error

DECIMAL = T.DecimalType(37, 18)
MOST = 2**63 - 1
SCALE = 18
UNITS = ("metre", "second", "kmh")  # fixed values


def is_integer(x: Typed) -> bool:
    return isinstance(x.type, INTEGERS)


def exact(x: Typed) -> bool:
    return is_integer(x) or isinstance(x.type, T.DecimalType)


def as_decimal(x: Typed) -> Column:
    return x.col.cast(DECIMAL)


def coefficient_fits(value: Column) -> Column:
    """Whether a decimal's coefficient, without trailing zeros, has 64 bits."""
    digits = F.regexp_replace(F.regexp_replace(F.abs(value).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.", "")
    return F.when(F.length(F.ltrim(F.lit("0"), digits)) <= 19, digits.cast(T.DecimalType(38, 0)) <= F.lit(MOST)).otherwise(F.lit(False))


def _decimal(value: Column) -> Result:
    return Result(value, F.when(value.isNull() | ~coefficient_fits(value), F.lit("OVERFLOW: a decimal's coefficient exceeds 64 bits")))


def _sum(sign: int):
    def build(a: Typed, b: Typed) -> Result:
        if not (exact(a) and exact(b)):
            return type_error("numeric arithmetic")
        if is_integer(a) and is_integer(b):
            f = F.try_add if sign > 0 else F.try_subtract
            value = f(a.col.cast("long"), b.col.cast("long"))
            return Result(value, fail(value.isNull(), "OVERFLOW", "an integer exceeds 64 bits"))
        left, right = as_decimal(a), as_decimal(b)
        return _decimal((left + right if sign > 0 else left - right).cast(DECIMAL))

    return build


def _exactly(value: Decimal) -> tuple[Decimal | None, str | None]:
    value = value.normalize()
    sign, digits, exponent = value.as_tuple()
    if -exponent > SCALE:
        return None, "INEXACT: a decimal needs a scale above 18"
    number = int("".join(map(str, digits)) or "0") * 10 ** max(0, exponent)
    return (value, None) if number <= MOST else (None, "OVERFLOW: a decimal's coefficient exceeds 64 bits")


_PAIR = T.StructType([T.StructField("value", DECIMAL), T.StructField("error", T.StringType())])


_ARROW = pa.struct([("value", pa.decimal128(37, 18)), ("error", pa.string())])


def _once(one):
    """``one`` of two decimals over Arrow batches, computed once for each different pair."""

    @F.arrow_udf(_PAIR)
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (c.dictionary_encode(null_encoding="encode") for c in (a, b))
        n = len(y.dictionary)
        pairs, at = np.unique(x.indices.to_numpy().astype("int64") * n + y.indices.to_numpy(), return_inverse=True)
        xs, ys = x.dictionary.to_pylist(), y.dictionary.to_pylist()
        found = [one(xs[k // n], ys[k % n]) for k in pairs]
        return pa.array([{"value": value, "error": error} for value, error in found], _ARROW).take(pa.array(at))

    return of


def _product_of(x: Decimal, y: Decimal) -> tuple[Decimal | None, str | None]:
    with localcontext() as c:
        c.prec = 80
        return _exactly(x * y)


def _quotient_of(x: Decimal, y: Decimal) -> tuple[Decimal | None, str | None]:
    if not y:
        return None, "DOMAIN_ERROR: division by zero"
    with localcontext() as c:
        c.prec = 120
        q = x / y
        return _exactly(q) if q * y == x and len(q.as_tuple().digits) < 110 else (None, "INEXACT: the quotient has no finite decimal")


_product, _quotient = _once(_product_of), _once(_quotient_of)


def _multiply(a: Typed, b: Typed) -> Result:
    if not (exact(a) and exact(b)):
        return type_error("numeric:multiply")
    if is_integer(a) and is_integer(b):
        value = F.try_multiply(a.col.cast("long"), b.col.cast("long"))
        return Result(value, fail(value.isNull(), "OVERFLOW", "an integer exceeds 64 bits"))
    pair = _product(as_decimal(a), as_decimal(b))
    return Result(pair["value"], pair["error"])


def _divide(a: Typed, b: Typed) -> Result:
    if not (exact(a) and exact(b)):
        return type_error("numeric:divide")
    pair = _quotient(as_decimal(a), as_decimal(b))
    return Result(pair["value"], pair["error"])


def _compare(test):
    def build(a: Typed, b: Typed) -> Result:
        if not (exact(a) and exact(b)):
            return type_error("numeric comparison")
        same = is_integer(a) and is_integer(b)
        return Result(test(a.col, b.col) if same else test(as_decimal(a), as_decimal(b)))

    return build


def _to_float(a: Typed) -> Result:
    if not (exact(a) or isinstance(a.type, T.DoubleType)):
        return type_error("numeric:toFloat")
    value = a.col.cast("double")
    return Result(value, fail(F.isnan(value) | (F.abs(value) == float("inf")), "DOMAIN_ERROR", "a float must be finite"))


def _float_at_most(a: Typed, b: Typed) -> Result:
    if not (isinstance(a.type, T.DoubleType) and isinstance(b.type, T.DoubleType)):
        return type_error("numeric:floatLessThanOrEqual")
    odd = F.isnan(a.col) | F.isnan(b.col) | (F.abs(a.col) == float("inf")) | (F.abs(b.col) == float("inf"))
    return Result(a.col <= b.col, fail(odd, "DOMAIN_ERROR", "a float must be finite"))


def _quantity(value: Typed, unit: Typed) -> Result:
    if not exact(value) or not isinstance(unit.type, T.StringType):
        return type_error("numeric:quantity")
    name = F.regexp_extract(unit.col, r"([A-Za-z]+)>?$", 1)
    return Result(F.struct(as_decimal(value).alias("value"), name.alias("unit")), fail(~name.isin(*UNITS), "DOMAIN_ERROR", "unknown unit"))


def _is_quantity(x: Typed) -> bool:
    return isinstance(x.type, T.StructType) and x.type.fieldNames() == ["value", "unit"]


def _quantities(combine, kind: str):
    def build(a: Typed, b: Typed) -> Result:
        if not (_is_quantity(a) and _is_quantity(b)):
            return type_error(f"numeric:quantity{kind}")
        inner = combine(Typed(a.col["value"], DECIMAL), Typed(b.col["value"], DECIMAL))
        units = fail(a.col["unit"] != b.col["unit"], "TYPE_ERROR", "quantities of different units")
        error = units if inner.error is None else F.coalesce(units, inner.error)
        value = F.struct(inner.value.alias("value"), a.col["unit"].alias("unit")) if kind in ("Add", "Subtract") else inner.value
        return Result(value, error)

    return build


_TESTS = {
    "equal": lambda a, b: a == b,
    "lessThan": lambda a, b: a < b,
    "lessThanOrEqual": lambda a, b: a <= b,
    "greaterThan": lambda a, b: a > b,
    "greaterThanOrEqual": lambda a, b: a >= b,
}

OPERATIONS = [
    Operation(f"{URN}numeric:add", 2, _sum(1)),
    Operation(f"{URN}numeric:subtract", 2, _sum(-1)),
    Operation(f"{URN}numeric:multiply", 2, _multiply),
    Operation(f"{URN}numeric:divide", 2, _divide),
    *(Operation(f"{URN}numeric:{name}", 2, _compare(test), boolean=True) for name, test in _TESTS.items()),
    Operation(f"{URN}numeric:toFloat", 1, _to_float),
    Operation(f"{URN}numeric:floatLessThanOrEqual", 2, _float_at_most, boolean=True),
    Operation(f"{URN}numeric:quantity", 2, _quantity),
    Operation(f"{URN}numeric:quantityAdd", 2, _quantities(_sum(1), "Add")),
    Operation(f"{URN}numeric:quantitySubtract", 2, _quantities(_sum(-1), "Subtract")),
    Operation(f"{URN}numeric:quantityEqual", 2, _quantities(_compare(_TESTS["equal"]), "Equal"), boolean=True),
    Operation(f"{URN}numeric:quantityLessThanOrEqual", 2, _quantities(_compare(_TESTS["lessThanOrEqual"]), "LessThanOrEqual"), boolean=True),
    Operation(f"{URN}numeric:quantityDivide", 2, _quantities(_divide, "Divide")),
]
