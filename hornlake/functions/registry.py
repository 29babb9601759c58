"""Scalar operations as Column builders with explicit failures.

An operation maps typed argument columns to a value and an error column: null,
or a code with a message. Nothing is silently null and no ANSI error can fire on
a row a join would have dropped; guards raise only at a rule's own node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..errors import ValidationError
from ..model import Bind, Filter, Scan

#: Operations exist under this namespace and, for older rules, under the second.
URN, OLD = "urn:dlp:", "urn:dlp:proposed:"


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType


@dataclass(frozen=True)
class Result:
    value: Column
    error: Column | None = None


Build = Callable[..., Result]


@dataclass(frozen=True)
class Operation:
    name: str
    arity: int
    build: Build
    boolean: bool = False
    pure: bool = True


def failure(code: str, message: str) -> Column:
    return F.lit(f"{code}: {message}")


def fail(condition: Column, code: str, message: str) -> Column:
    """The failure where ``condition`` holds, else null."""
    return F.when(condition, failure(code, message))


def type_error(name: str) -> Result:
    return Result(F.lit(None), failure("TYPE_ERROR", f"{name} doesn't take these types"))


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def domain(t: T.DataType) -> str:
    """The ordering domain of a type; '' has no order."""
    if isinstance(t, (*INTEGERS, T.DecimalType)):
        return "numeric"
    if isinstance(t, T.DoubleType):
        return "float64"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampType):
        return "instant"
    if isinstance(t, T.DayTimeIntervalType):
        return "duration"
    if isinstance(t, T.TimeType):
        return "time"
    if isinstance(t, T.StructType) and t.fieldNames() == ["value", "unit"]:
        return "quantity"
    return ""


class Registry:
    """Operations by name; scans are registered providers of rows."""

    def __init__(self, operations: list[Operation] = (), scans: dict | None = None):
        self.operations = {o.name: o for o in operations}
        self.scans = dict(scans or {})

    def with_operation(self, operation: Operation) -> "Registry":
        return Registry([*self.operations.values(), operation], self.scans)

    def with_scan(self, name: str, inputs: int, outputs: int, rows) -> "Registry":
        """``rows(spark)`` gives the provider's relation: its inputs, then its outputs."""
        return Registry(list(self.operations.values()), self.scans | {name: (inputs, outputs, rows)})

    def find(self, name: str) -> Operation | None:
        name = URN + name.removeprefix(OLD) if name.startswith(OLD) else name
        return self.operations.get(name)

    def pure(self, name: str) -> bool:
        found = self.find(name)
        return bool(found and found.pure)

    def check(self, node) -> None:
        if isinstance(node, Scan):
            if node.operation not in self.scans:
                raise ValidationError(f"unknown scan {node.operation}", node.at)
            inputs, outputs, _ = self.scans[node.operation]
            if (len(node.args), len(node.outputs)) != (inputs, outputs):
                raise ValidationError(f"{node.operation} takes {inputs} and gives {outputs}", node.at)
            return
        found = self.find(node.operation)
        if not found:
            raise ValidationError(f"unknown operation {node.operation}", node.at)
        if found.arity != len(node.args):
            raise ValidationError(f"{node.operation} takes {found.arity} arguments", node.at)
        if isinstance(node, Filter) and not found.boolean:
            raise ValidationError(f"{node.operation} is no test", node.at)
        assert isinstance(node, Filter | Bind)
