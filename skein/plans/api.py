"""Requests by field name over the read service and the views, with limits, a cache and an audit log.

A request is {"field": ..., "args": {...}, "select": [...]}; an answer is a table, a dict of tables or a plain dict.
There is no server here: what carries requests is left to the caller.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict, deque
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lookup, search
from ..operators.textindex import TextIndex
from .service import Service
from .views import Engine


class Rejected(ValueError):
    """A request beyond a limit."""


#: Fields that walk edges.
WALKS = ("traverse", "paths", "impact")


class Limits:
    """What one request may cost, and how many a user may send in a time."""

    def __init__(self, cost: int = 1000, requests: int = 100, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.cost, self.requests, self.seconds, self._clock = cost, requests, seconds, clock
        self._seen: dict[str, deque[float]] = {}

    def check(self, user: str, request: dict) -> None:
        args = request.get("args", {})
        # a step deeper may reach ten times as much; a page costs its rows. A walk without a depth goes as deep as it may
        unsaid = graph.DEEPEST if request.get("field") in WALKS else 0
        depth = args.get("depth")
        spent = 10 ** int(unsaid if depth is None else depth) + int(args.get("limit", 0) or 0)
        if spent > self.cost:
            raise Rejected(f"a cost of {spent} is beyond {self.cost}")
        now, times = self._clock(), self._seen.setdefault(user, deque())
        while times and times[0] <= now - self.seconds:
            times.popleft()
        if len(times) >= self.requests:
            raise Rejected(f"more than {self.requests} requests in {self.seconds} seconds")
        times.append(now)


class Cache:
    """Answers by request, the least used ones dropped; tables in them are persisted while they are held."""

    def __init__(self, most: int = 100) -> None:
        self.most, self._held = most, OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> tuple[object, bool]:
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key], True
        answer = self._held[key] = make()
        for table in _tables(answer):
            table.persist()
        while len(self._held) > self.most:
            self._drop(next(iter(self._held)))
        return answer, False

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)

    def _drop(self, key: str) -> None:
        for table in _tables(self._held.pop(key)):
            table.unpersist()


def _tables(answer: object) -> list[DataFrame]:
    values = answer.values() if isinstance(answer, dict) else [answer]
    return [v for v in values if isinstance(v, DataFrame)]


class Audit:
    """An append-only table of who asked for what: at, user, action, target, outcome. ``most`` rows are held back and written together."""

    def __init__(self, spark: SparkSession, path: str, most: int = 100) -> None:
        self.spark, self.path, self.most = spark, path, most
        self._held: list[tuple[str, ...]] = []

    def add(self, user: str, action: str, target: str, outcome: str) -> None:
        self._held.append((datetime.now(UTC).isoformat(), user, action, target, outcome))
        if len(self._held) >= self.most:
            self.flush()

    def flush(self) -> None:
        """Write what is held back; callers do so before they end."""
        if self._held:
            rows, self._held = self._held, []
            self.spark.createDataFrame(rows, "at string, user string, action string, target string, outcome string").coalesce(1).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema("at string, user string, action string, target string, outcome string").json(self.path).orderBy("at")


class Api:
    """Fields: entry, entries, traverse, paths, impact, search, ask, state, difference, and one for every view.

    A search is by shared words, or by BM25 where an ``index`` of the nodes' texts is given. Answers are cached by
    user and by the version of the tables, so that a change is seen by the next request.
    """

    def __init__(self, service: Service, engine: Engine, tables: dict[str, tuple[DataFrame, ...]], limits: Limits | None = None, cache: Cache | None = None, audit: Audit | None = None, index: TextIndex | None = None, version: Callable[[], object] = lambda: None) -> None:
        self.service, self.engine, self.tables = service, engine, tables
        self.limits, self.cache, self.audit, self.index, self.version = limits or Limits(), cache or Cache(), audit, index, version

    def fields(self) -> list[str]:
        return sorted(["entry", "entries", "traverse", "paths", "impact", "search", "ask", "state", "difference", *self.engine.list()])

    def _answer(self, field: str, args: dict) -> object:
        s = self.service
        if field == "entry":
            return lookup.entry(s.nodes, s.edges, args["id"])
        if field == "entries":
            return s.entries(args.get("type"), **{k: v for k, v in args.items() if k != "type"})
        if field == "traverse":
            return s.traverse(**args)
        if field == "paths":
            return s.paths(**args)
        if field == "impact":
            return graph.impact(s.edges, args["start"], args.get("severity", 1.0), args.get("depth", graph.DEEPEST))
        if field == "state":
            return s.state_at(args["at"])
        if field == "difference":
            return s.diff(args["earlier"], args["later"])
        if field == "search" and self.index is not None:
            asked = s.nodes.sparkSession.createDataFrame([(0, args["text"])], "id int, text string")
            return self.index.search(asked, args.get("limit", 10)).select(F.col("doc").alias("id"), "score", "place").orderBy("place")
        if field == "search":
            return search.keyword_top(s.nodes, args["text"], args.get("limit", 10))
        if field == "ask":
            kind = search.intent(args["question"])
            return {"intent": kind, "plan": search.route(kind)["stores"], "evidence": search.retrieved(args["question"], s.nodes, s.edges, args.get("limit", 10))}
        if field in self.engine.list():
            return self.engine.get(field, *self.tables[field], **args)
        raise Rejected(f"no such field: {field}")

    def execute(self, request: dict, user: str = "anonymous") -> dict:
        """field, data, cache_hit of one request."""
        field, args = request["field"], request.get("args", {})
        outcome = "refused"
        try:
            self.limits.check(user, request)
            data, hit = self.cache.get(json.dumps([field, args, user, self.version(), self.engine.version(field)], sort_keys=True, default=str), lambda: self._answer(field, args))
            outcome = "answered"
        finally:
            if self.audit is not None:
                self.audit.add(user, field, json.dumps(args, sort_keys=True), outcome)
        if (names := request.get("select")) and isinstance(data, DataFrame):
            data = data.select(*[F.col(n) for n in names])
        return {"field": field, "data": data, "cache_hit": hit}
