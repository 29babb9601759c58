"""Event-time windows with corrections: batch plans and a stateful stream.

An event is (event_id, event_time in microseconds, key, value, revision). The
last revision of an id counts; a window [end - width, end) is evaluated at an
explicit clock. Events older than the watermark allows are reported, not dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import DomainError

EVENT = "event_id string, event_time long, key string, value double, revision long"


def latest(events: DataFrame, identity: str = "event_id", revision: str = "revision") -> DataFrame:
    """The highest revision of each event; ``deleted`` ones (if there is such a column) go."""
    columns = [c for c in events.columns if c != identity]
    kept = events.groupBy(identity).agg(F.max_by(F.struct(*columns), revision).alias("__e")).select(identity, *(F.col(f"__e.{c}").alias(c) for c in columns))
    return kept.filter("not deleted").drop("deleted") if "deleted" in kept.columns else kept


def window_rows(events: DataFrame, end: int, width: int, time: str = "event_time") -> DataFrame:
    """Events in [end - width, end)."""
    if width <= 0:
        raise DomainError("DOMAIN_ERROR", "a window needs a positive width")
    return events.filter((F.col(time) >= end - width) & (F.col(time) < end))


def history(events: DataFrame, end: int, width: int, key: str = "key", time: str = "event_time", identity: str = "event_id") -> DataFrame:
    """The window and, per key, the last event before it."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(identity))
    before = events.filter(F.col(time) < end - width).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return window_rows(events, end, width, time).unionByName(before)


def entries(events: DataFrame, end: int, width: int, holds: Column, key: str = "key", time: str = "event_time", identity: str = "event_id") -> DataFrame:
    """Window events where ``holds`` is true and was false at the predecessor; without a predecessor it isn't known."""
    line = Window.partitionBy(key).orderBy(time, identity)
    marked = events.filter(F.col(time) < end).withColumn("__now", holds).withColumn("__was", F.lag("__now").over(line))
    return window_rows(marked, end, width, time).filter("__now and not __was").drop("__now", "__was")


def late(events: DataFrame, watermark: int, lateness: int, time: str = "event_time") -> DataFrame:
    """Events older than the watermark allows: a side output."""
    return events.filter(F.col(time) < watermark - lateness)


def refuse_late(events: DataFrame, watermark: int, lateness: int, time: str = "event_time") -> DataFrame:
    """The events; raises, when it runs, on one that is too old."""
    raised = F.raise_error(F.lit("@@DOMAIN_ERROR: an event is older than the watermark allows@@")).isNull()
    return events.filter(F.when(F.col(time) < watermark - lateness, raised).otherwise(F.monotonically_increasing_id() >= 0))


def expired(events: DataFrame, end: int, width: int, watermark: int, lateness: int, key: str = "key", time: str = "event_time", identity: str = "event_id") -> DataFrame:
    """What a window no longer keeps: older than the cutoff and not the last before the window of its key."""
    cutoff = min(end - width, watermark - lateness)
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(identity))
    ranked = events.filter(F.col(time) < end - width).withColumn("__n", F.row_number().over(order))
    return ranked.filter((F.col(time) < cutoff) & (F.col("__n") > 1)).drop("__n")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, …): rows added to and removed from a window."""
    added = new.join(old, new.columns, "left_anti").select(F.lit("add").alias("op"), *new.columns)
    return added.union(old.join(new, old.columns, "left_anti").select(F.lit("remove").alias("op"), *old.columns))


class WindowStore:
    """One key range's window state: corrections, tombstones, offsets, clock, limits.

    Pure Python over one key's events; the stream below keeps one per key. Every
    change either succeeds whole or leaves the state as it was.
    """

    LIMITS = {"events": 10_000, "bytes": 16 * 2**20, "sources": 128}

    def __init__(self, width: int, lateness: int = 0, state: dict | None = None, gaps: bool = False):
        """``gaps``: whether offsets of a source may leave numbers out."""
        if width <= 0 or lateness < 0:
            raise DomainError("DOMAIN_ERROR", "a window needs a positive width and no negative lateness")
        self.width, self.lateness, self.gaps = width, lateness, gaps
        self.state = state or {"events": {}, "gone": {}, "offsets": {}, "end": None, "watermark": None, "revision": 0}

    def _active(self) -> dict:
        end = self.state["end"]
        return {} if end is None else {i: e for i, e in self.state["events"].items() if end - self.width <= e["event_time"] < end}

    def _offset(self, source: str | None, offset: int | None, content) -> bool:
        """Whether the delivery is a replay; gaps and changed replays raise."""
        if source is None:
            return False
        last = self.state["offsets"].get(source)
        if last is not None and offset <= last[0]:
            if offset == last[0] and last[1] != json.dumps(content, sort_keys=True):
                raise DomainError("DOMAIN_ERROR", "a replay differs from what it repeats")
            return True
        if last is not None and offset != last[0] + 1 and not self.gaps:
            raise DomainError("UNAVAILABLE", f"offsets {last[0] + 1} to {offset - 1} of {source} are missing")
        return False

    def _commit(self, before: dict, new: dict) -> dict:
        old, self.state = self.state, new
        start = None if new["end"] is None else new["end"] - self.width
        if start is not None:
            mark = new["watermark"] if new["watermark"] is not None else start
            cutoff = min(start, mark - self.lateness)
            older = sorted((e["event_time"], i) for i, e in new["events"].items() if e["event_time"] < start)
            keep = {older[-1][1]} if older else set()
            new["events"] = {i: e for i, e in new["events"].items() if e["event_time"] >= cutoff or i in keep}
            new["gone"] = {i: g for i, g in new["gone"].items() if g["event_time"] >= cutoff}
        if len(new["events"]) > self.LIMITS["events"] or len(new["offsets"]) > self.LIMITS["sources"] or len(json.dumps(new)) > self.LIMITS["bytes"]:
            self.state = old
            raise DomainError("RESOURCE_LIMIT", "the window holds too much")
        after = self._active()
        added = {i: e for i, e in after.items() if before.get(i) != e}
        removed = {i: e for i, e in before.items() if after.get(i) != e}
        if added or removed or new["end"] != old["end"]:
            new["revision"] += 1
        return {"added": added, "removed": removed}

    def _copy(self) -> dict:
        return json.loads(json.dumps(self.state))

    def upsert(self, event: dict, source: str | None = None, offset: int | None = None) -> dict:
        before = self._active()
        if self._offset(source, offset, event):
            return {"added": {}, "removed": {}}
        new, i = self._copy(), event["event_id"]
        known = new["events"].get(i) or new["gone"].get(i)
        if known is not None:
            if known == event:
                return {"added": {}, "removed": {}}
            if event["revision"] <= known["revision"]:
                raise DomainError("DOMAIN_ERROR", "a correction needs a higher revision")
        if new["watermark"] is not None and event["event_time"] < new["watermark"] - self.lateness:
            raise DomainError("DOMAIN_ERROR", "an event is older than the watermark allows")
        new["events"][i] = event
        new["gone"].pop(i, None)
        if source is not None:
            new["offsets"][source] = [offset, json.dumps(event, sort_keys=True)]
        return self._commit(before, new)

    def remove(self, event_id: str, revision: int, source: str | None = None, offset: int | None = None) -> dict:
        content = {"event_id": event_id, "revision": revision, "removed": True}
        if self._offset(source, offset, content):
            return {"added": {}, "removed": {}}
        before, new = self._active(), self._copy()
        if source is not None:
            new["offsets"][source] = [offset, json.dumps(content, sort_keys=True)]
        if event_id in new["gone"]:
            return self._commit(before, new)
        if event_id not in new["events"]:
            raise DomainError("UNAVAILABLE", f"event {event_id} isn't known")
        event = new["events"].pop(event_id)
        if revision <= event["revision"]:
            raise DomainError("DOMAIN_ERROR", "a removal needs a higher revision")
        new["gone"][event_id] = event | {"revision": revision}
        return self._commit(before, new)

    def advance(self, end: int, watermark: int) -> dict:
        old = self.state
        if watermark > end or (old["end"] is not None and (end < old["end"] or watermark < old["watermark"])):
            raise DomainError("DOMAIN_ERROR", "clock and watermark only rise, the watermark no further than the clock")
        before, new = self._active(), self._copy()
        new["end"], new["watermark"] = end, watermark
        return self._commit(before, new)

    def forget_key(self) -> dict:
        """Drops the key's events and tombstones; clock, watermark and offsets stay, so that replays stay replays."""
        before, new = self._active(), self._copy()
        new["events"], new["gone"] = {}, {}
        return self._commit(before, new)

    def rows(self) -> list[dict]:
        return sorted(self._active().values(), key=lambda e: (e["event_time"], e["event_id"]))

    def predecessor(self, event_id: str) -> dict | None:
        own = self.state["events"][event_id]
        older = [e for e in self.state["events"].values() if (e["event_time"], e["event_id"]) < (own["event_time"], event_id)]
        return max(older, key=lambda e: (e["event_time"], e["event_id"]), default=None)

    def entry_rows(self, holds: Callable[[dict], bool]) -> list[dict]:
        return [e for e in self.rows() if holds(e) and (p := self.predecessor(e["event_id"])) is not None and not holds(p)]

    def checkpoint(self) -> bytes:
        import hashlib

        body = json.dumps({"width": self.width, "lateness": self.lateness, "state": self.state}, sort_keys=True).encode()
        return hashlib.sha256(body).hexdigest().encode() + b"\n" + body

    @classmethod
    def restore(cls, data: bytes, width: int, lateness: int = 0) -> "WindowStore":
        import hashlib

        digest, _, body = data.partition(b"\n")
        if hashlib.sha256(body).hexdigest().encode() != digest:
            raise DomainError("DOMAIN_ERROR", "the checkpoint is damaged")
        saved = json.loads(body)
        if (saved["width"], saved["lateness"]) != (width, lateness):
            raise DomainError("DOMAIN_ERROR", "the checkpoint is of another window")
        return cls(width, lateness, saved["state"])


CHANGE = "key string, op string, event_id string, event_time long, value double, revision long, error string"


def stream_changes(events: DataFrame, width: int, lateness: int) -> DataFrame:
    """A stream of window changes per key from a stream of ``EVENT`` rows (and ``deleted``).

    The clock of a key is its greatest event time plus one. Late events and bad
    corrections come out as rows with an error, so that nothing is lost silently.
    State is one JSON document a key; the stream's checkpoint keeps it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = WindowStore(width, lateness, json.loads(state.get[0]) if state.exists else None)
        out = []

        def note(change: dict) -> None:
            out.extend((key[0], op, e["event_id"], e["event_time"], e["value"], e["revision"], None) for op, rows in (("remove", change["removed"]), ("add", change["added"])) for e in rows.values())

        for pdf in frames:
            for r in pdf.sort_values(["event_time", "event_id", "revision"]).to_dict("records"):
                event = {k: (float if k == "value" else int if k in ("event_time", "revision") else str)(r[k]) for k in ("event_id", "event_time", "value", "revision")}
                try:
                    note(store.remove(event["event_id"], event["revision"]) if r.get("deleted") else store.upsert(event))
                    end = max(store.state["end"] or 0, event["event_time"] + 1)
                    note(store.advance(end, end))
                except DomainError as e:
                    out.append((key[0], "error", event["event_id"], event["event_time"], event["value"], event["revision"], str(e)))
        state.update((json.dumps(store.state),))
        yield pd.DataFrame(out, columns=["key", "op", "event_id", "event_time", "value", "revision", "error"])

    return events.groupBy("key").applyInPandasWithState(step, CHANGE, "state string", "append", GroupStateTimeout.NoTimeout)


def publish_each(stream: DataFrame, runtime, relation: str, sink: Callable[[object, int], None]):
    """``foreachBatch`` writer: each micro-batch of window rows is evaluated by the rule runtime, its deltas go to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        sink(runtime.evaluate({relation: df}), number)

    return stream.writeStream.foreachBatch(batch)
