"""RDF literals -> typed columns: strict lexical forms, anything else is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import DomainError
from .numeric import DECIMAL

XSD = "http://www.w3.org/2001/XMLSchema#"
LONGEST = 4096
#: Per target type: the datatypes it takes and the lexical form. Fixed values.
FORMS = {
    "integer": (("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"), r"[+-]?\d{1,19}"),
    "decimal": (("decimal", "integer", "int", "long"), r"[+-]?(\d+(\.\d*)?|\.\d+)"),
    "float": (("double",), r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"),
    "boolean": (("boolean",), r"true|false|0|1"),
    "date": (("date",), r"\d{4}-\d{2}-\d{2}"),
    "instant": (("dateTime", "dateTimeStamp"), r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})"),
    "string": (("string", ""), r"(?s).*"),
}
_TYPES = {"integer": "bigint", "decimal": DECIMAL.simpleString(), "float": "double", "boolean": "boolean", "date": "date", "instant": "timestamp", "string": "string"}


def decode(term: Column, kind: str) -> tuple[Column, Column]:
    """(value, error) of a stored literal read as ``kind``."""
    if kind not in FORMS:
        raise DomainError("TYPE_ERROR", f"unknown type {kind}")
    names, form = FORMS[kind]
    lexical = F.regexp_extract(term, r'(?s)^"(.*)"(?:\^\^<[^<>]*>)?$', 1)
    datatype = F.regexp_extract(term, r'"\^\^<([^<>]*)>$', 1)
    good = term.startswith('"') & datatype.isin(*(f"{XSD}{n}" if n else "" for n in names)) & lexical.rlike(f"^(?:{form})$")
    value = lexical.try_cast(_TYPES[kind])
    error = F.when(F.length(lexical) > LONGEST, F.lit("RESOURCE_LIMIT: a literal is too long")).when(~good, F.concat(F.lit(f"TYPE_ERROR: no {kind}: "), F.substring(term, 1, 60))).when(value.isNull(), F.concat(F.lit("DOMAIN_ERROR: "), F.substring(term, 1, 60)))
    return F.when(good, value), error


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with literal columns decoded; raises, when it runs, on one outside its form."""
    failed = None
    for c in df.columns:
        if c in kinds:
            value, error = decode(F.col(c), kinds[c])
            failed = error if failed is None else F.coalesce(failed, error)
            df = df.withColumn(f"__{c}", value)
    if failed is None:
        return df
    raised = F.raise_error(F.concat(F.lit("@@"), F.col("__error"), F.lit("@@"))).isNull()
    df = df.withColumn("__error", failed).filter(F.when(F.col("__error").isNotNull(), raised).otherwise(F.monotonically_increasing_id() >= 0))
    return df.select(*(F.col(f"__{c}").alias(c) if c in kinds else F.col(c) for c in df.columns if not c.startswith("__")))


def encode(value: Column, kind: str) -> Column:
    """The canonical stored form: decimals keep a fraction, instants six digits and Z."""
    text = {
        "integer": value.cast("string"),
        "decimal": F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0"),
        "float": value.cast("string"),
        "boolean": value.cast("string"),
        "date": F.date_format(value, "yyyy-MM-dd"),
        "instant": F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    }[kind]
    name = {"float": "double", "instant": "dateTime"}.get(kind, kind)
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>'))
