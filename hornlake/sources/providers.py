"""External computation: registered scalar and scan providers over a typed wire.

A provider answers batches of distinct argument tuples. Arguments are made
distinct before the call and the answers joined back, so that a repeated row
never costs a call; one client lives per partition. Every reply is checked:
a status of STATUSES, and a value only with status ok.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import DomainError
from ..functions.registry import Operation, Registry, Result

#: Fixed values.
STATUSES = ("ok", "no_route", "no_match", "out_of_region", "domain_error", "incomplete", "unavailable", "cancelled", "deadline", "protocol_error", "snapshot_changed", "resource_limit")


def encode(value) -> list:
    """A value as a tagged JSON list; exact for integers and decimals."""
    if value is None:
        return ["null"]
    if isinstance(value, bool):
        return ["boolean", value]
    if isinstance(value, int):
        return ["integer", str(value)]
    if isinstance(value, Decimal):
        return ["decimal", str(value)]
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise DomainError("DOMAIN_ERROR", "a float must be finite")
        return ["float", value.hex()]
    if isinstance(value, (tuple, list)):
        return ["tuple", *map(encode, value)]
    return ["text", str(value)]


def decode(wire, depth: int = 0):
    if depth > 64 or not isinstance(wire, list) or not wire:
        raise DomainError("DOMAIN_ERROR", "malformed wire value")
    match wire:
        case ["null"]:
            return None
        case ["boolean", bool() as b]:
            return b
        case ["integer", str() as s]:
            return int(s)
        case ["decimal", str() as s]:
            return Decimal(s)
        case ["float", str() as s]:
            return float.fromhex(s)
        case ["text", str() as s]:
            return s
        case ["tuple", *parts]:
            return tuple(decode(p, depth + 1) for p in parts)
    raise DomainError("DOMAIN_ERROR", "malformed wire value")


def checked(reply) -> tuple[str, object]:
    """(status, value) of a reply; anything else is a protocol error."""
    if not isinstance(reply, dict) or reply.get("status") not in STATUSES or ("value" in reply) != (reply["status"] == "ok"):
        return "protocol_error", None
    return reply["status"], decode(reply["value"]) if "value" in reply else None


@dataclass
class FakeProvider:
    """Deterministic answers for tests: scalars by operation and arguments, scans by operation."""

    scalars: dict[tuple, object] = field(default_factory=dict)
    scans: dict[str, list[tuple]] = field(default_factory=dict)
    revision: str = "1"
    calls: int = 0

    def snapshot(self) -> str:
        return self.revision

    def batch(self, operation: str, rows: list[tuple]) -> list[dict]:
        self.calls += len(rows)
        out = []
        for r in rows:
            found = self.scalars.get((operation, *r))
            out.append({"status": "no_match"} if found is None else {"status": "ok", "value": encode(found)})
        return out

    def scan(self, operation: str) -> list[tuple]:
        return self.scans[operation]


class HTTPProvider:
    """JSON over HTTP: POST {endpoint}/snapshot and /batch, bounded in time and size."""

    def __init__(self, endpoint: str, timeout: float = 10.0, most: int = 16 * 2**20):
        self.endpoint, self.timeout, self.most = endpoint.rstrip("/"), timeout, most

    def _post(self, path: str, body) -> dict:
        request = urllib.request.Request(f"{self.endpoint}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            data = reply.read(self.most + 1)
        if len(data) > self.most:
            raise DomainError("RESOURCE_LIMIT", "a reply is too large")
        return json.loads(data)

    def snapshot(self) -> str:
        return self._post("snapshot", {})["snapshot"]

    def batch(self, operation: str, rows: list[tuple]) -> list[dict]:
        try:
            replies = self._post("batch", {"operation": operation, "rows": [encode(r) for r in rows]})["replies"]
        except TimeoutError:
            return [{"status": "deadline"}] * len(rows)
        except (OSError, KeyError, ValueError):
            return [{"status": "unavailable"}] * len(rows)
        return replies if isinstance(replies, list) and len(replies) == len(rows) else [{"status": "protocol_error"}] * len(rows)


def dispatch(provider, path: str, body: dict) -> dict:
    """The server's side of the wire, in process."""
    if path == "snapshot":
        return {"snapshot": provider.snapshot()}
    if path == "batch":
        return {"replies": provider.batch(body["operation"], [decode(r) for r in body["rows"]])}
    raise DomainError("UNAVAILABLE", f"unknown path {path}")


def osrm_lengths(endpoint: str, snap: float, box: tuple[float, float, float, float], fetch: Callable[[str], dict] | None = None):
    """A provider of fastest-route lengths of an OSRM server: rows (lon1, lat1, lon2, lat2) -> metres."""

    def get(url: str) -> dict:
        with urllib.request.urlopen(url, timeout=10) as reply:
            return json.loads(reply.read(2**20))

    class Provider:
        def snapshot(self) -> str:
            return endpoint

        def batch(self, operation: str, rows: list[tuple]) -> list[dict]:
            out = []
            for x1, y1, x2, y2 in rows:
                if not all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in ((x1, y1), (x2, y2))):
                    out.append({"status": "out_of_region"})
                    continue
                try:
                    found = (fetch or get)(f"{endpoint}/route/v1/driving/{x1},{y1};{x2},{y2}?overview=false")
                except OSError:
                    out.append({"status": "unavailable"})
                    continue
                if found.get("code") == "NoRoute":
                    out.append({"status": "no_route"})
                elif found.get("code") != "Ok":
                    out.append({"status": "no_match"})
                elif any(w.get("distance", 0) > snap for w in found.get("waypoints", [])):
                    out.append({"status": "no_match"})
                else:
                    out.append({"status": "ok", "value": encode(float(found["routes"][0]["distance"]))})
            return out

    return Provider()


def evaluate(rows: DataFrame, provider, operation: str, args: list[str], kind: T.DataType, batch: int = 512, deadline: float | None = None) -> DataFrame:
    """``rows`` with a column ``result`` (status, value): one call for each distinct argument tuple."""
    schema = T.StructType([*(rows.schema[a] for a in args), T.StructField("result", T.StructType([T.StructField("status", T.StringType()), T.StructField("value", kind)]))])
    before = provider.snapshot()
    arrow_kind = pa.struct([("status", pa.string()), ("value", {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}[kind.simpleString()])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = time.monotonic()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                if deadline is not None and time.monotonic() - began > deadline:
                    replies = [{"status": "deadline"}] * part.num_rows
                else:
                    replies = provider.batch(operation, list(zip(*(part.column(k).to_pylist() for k in range(len(args))), strict=True)))
                found = [dict(zip(("status", "value"), checked(r), strict=True)) for r in replies]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow_kind)], [*args, "result"])

    answers = rows.select(*args).distinct().mapInArrow(run, schema)
    if provider.snapshot() != before:
        raise DomainError("UNAVAILABLE", "the provider moved")
    return rows.join(answers, args, "left")


def is_ok(result: Column) -> Column:
    return result["status"] == "ok"


def value(result: Column) -> Column:
    """The value; raises where the status isn't ok."""
    raised = F.raise_error(F.concat(F.lit("@@UNAVAILABLE: "), result["status"], F.lit("@@")))
    return F.when(result["status"] == "ok", result["value"]).otherwise(raised.cast("double"))


def status_operations() -> list[Operation]:
    """isOK and value for rules over provider results. Fixed names."""
    good = lambda r: Result(r.col["status"] == "ok")
    take = lambda r: Result(r.col["value"], F.when(r.col["status"] != "ok", F.concat(F.lit("UNAVAILABLE: "), r.col["status"])))
    return [Operation("urn:dlp:provider:isOK", 1, good, boolean=True, pure=False), Operation("urn:dlp:provider:value", 1, take, pure=False)]


def scan_relation(provider, operation: str, schema: str) -> Callable[[SparkSession], DataFrame]:
    """A finite enumeration as a relation for ``Registry.with_scan``."""
    return lambda spark: spark.createDataFrame(provider.scan(operation), schema)


def extended(registry: Registry) -> Registry:
    for o in status_operations():
        registry = registry.with_operation(o)
    return registry
