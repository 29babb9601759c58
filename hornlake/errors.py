"""Typed failures. A query either answers completely or raises one of these."""

from __future__ import annotations

import re

CODES = ("TYPE_ERROR", "DOMAIN_ERROR", "OVERFLOW", "INEXACT", "UNAVAILABLE", "ARITY_ERROR", "RESOURCE_LIMIT")


class EngineError(Exception):
    """Base of all failures of this engine."""


class DomainError(EngineError):
    """A scalar operation met a value it refuses; ``code`` is one of CODES."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ValidationError(EngineError):
    """A program that can't be planned; carries the place in its text."""

    def __init__(self, message: str, at: tuple[str, int, int] | None = None):
        self.source, self.line, self.column = at or ("<rules>", 0, 0)
        super().__init__(f"{self.source}:{self.line}:{self.column}: {message}" if at else message)


class ParseError(ValidationError):
    """Text outside the grammar."""


class IncompleteError(EngineError):
    """A negative or whole answer was asked of a closure that isn't complete."""


class InconsistentError(EngineError):
    """An ordinary question was asked of an inconsistent closure."""


class RetryError(EngineError):
    """A source moved while a query ran."""


def raised_by(error: Exception) -> DomainError | None:
    """The typed error inside a Spark failure, if one of our guards raised it."""
    found = re.search(r"@@([A-Z_]+): ([^@]*)@@", str(error))
    return DomainError(found[1], found[2]) if found else None
