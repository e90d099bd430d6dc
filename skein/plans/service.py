"""The read service: every answer passes an access policy first, and its cost is reported."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lookup, search, temporal
from .tables import settled

Policy = Callable[[DataFrame], DataFrame]


class Service:
    """nodes and edges behind policies (pass-through by default) and a sink of metrics."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, log: DataFrame | None = None, nodes_policy: Policy = lambda d: d, edges_policy: Policy = lambda d: d, metrics: Callable[[dict], None] = lambda m: None) -> None:
        self.nodes, self.edges, self.log, self._metrics = nodes_policy(nodes), edges_policy(edges), log, metrics

    def _timed(self, kind: str, answer: Callable[[], object]) -> object:
        began = time.time()
        out = answer()
        self._metrics({"kind": kind, "stores": search.route(kind)["stores"], "ms": (time.time() - began) * 1000, "cache_hit": False})
        return out

    def entry(self, node_id: str) -> dict | None:
        row = self._timed("entityLookup", lambda: lookup.get_node(self.nodes, node_id).first())
        return row.asDict(recursive=True) if row else None

    def entries(self, kind: str | None, **options) -> dict:
        return self._timed("typeListing", lambda: lookup.list_entries(self.nodes, kind, **options))

    def traverse(self, start: str, depth: int = graph.DEEPEST, with_edges: bool = True, **options) -> dict:
        """nodes (id, depth) and edges (edge_id) as tables; truncated: whether the depth asked for is beyond ``DEEPEST``."""

        def answer() -> dict:
            starts = self.nodes.sparkSession.createDataFrame([(start,)], "id string")
            reached, seen = graph.traverse(self.nodes, self.edges, starts, depth=min(depth, graph.DEEPEST), **options)
            return {"nodes": reached, "edges": seen if with_edges else seen.limit(0), "truncated": depth > graph.DEEPEST}

        return self._timed("traversal", answer)

    def paths(self, source: str, target: str, depth: int = graph.DEEPEST, limit: int | None = None, kinds: list[str] | None = None) -> dict:
        """paths (nodes, edge_ids, length) as a table, and whether there is any; the depth is not cut."""

        def answer() -> dict:
            found = graph.simple_paths(self.edges, source, target, depth, limit, kinds)
            return {"paths": found, "found": not found.isEmpty()}

        return self._timed("pathFinding", answer)

    def state_at(self, moment: str) -> DataFrame:
        return self._timed("temporal", lambda: temporal.state_at(self.log, moment))

    def diff(self, earlier: str, later: str) -> DataFrame:
        return self._timed("temporal", lambda: temporal.difference(self.log, earlier, later))


def allowed(rows: DataFrame, grants: DataFrame, user: str, action: str = "read") -> DataFrame:
    """Rows (type, scope) that a user was granted an action on (grants: user, action, kind, scope; * for any)."""
    mine = grants.where((F.col("user") == user) & F.col("action").isin(action, "*")).select("kind", "scope").distinct()
    # each row may match four ways, each an equality, so the join hashes
    asked = rows.withColumn("_ask", F.explode(F.array(*[F.struct(k.alias("kind"), s.alias("scope")) for k in (F.col("type"), F.lit("*")) for s in (F.col("scope"), F.lit("*"))])))
    hit = asked.join(mine, (F.col("_ask.kind") == mine["kind"]) & (F.col("_ask.scope") == mine["scope"]), "left_semi")
    return hit.drop("_ask").dropDuplicates(["id"])


def held_roles(members: DataFrame, most: int = 50) -> DataFrame:
    """user, principal, distance of the roles that users hold, directly or through other roles, themselves at distance 0.

    members: member (user or role), role. Circles end, as a role counts once, at its least distance; hierarchies
    deeper than ``most`` steps are refused.
    """
    links = members.where("member is not null and role is not null").select("member", "role").distinct()
    users = links.select(F.col("member").alias("user")).distinct()
    now = held = settled(users.select("user", F.col("user").alias("principal"), F.lit(0).alias("distance")), "roles")
    for distance in range(1, most + 1):
        further = now.join(links.withColumnRenamed("member", "principal"), "principal").select("user", F.col("role").alias("principal")).distinct()
        now = settled(further.join(held, ["user", "principal"], "left_anti").withColumn("distance", F.lit(distance)), "roles")
        if now.isEmpty():
            return held
        held = settled(held.unionByName(now), "roles")
    raise ValueError(f"roles are nested more than {most} deep")


def decided(rows: DataFrame, grants: DataFrame, roles: DataFrame, action: str = "read") -> DataFrame:
    """rows (id, user, kind, scope) with allowed and the grant that decided it (rule: explicit, wildcard, inherited, none).

    grants: principal, action, kind, scope, effect (allow or deny), * for any; roles: as ``held_roles`` gives them. A user's own
    grant for the very kind and scope decides first, then own grants with wildcards, then those of the nearest role; among
    equals the one with fewer wildcards, and a denial before a permission. Nothing that fits is a denial.
    """
    own = rows.select("user").distinct().select("user", F.col("user").alias("principal"), F.lit(0).alias("distance"))
    holds = roles.where("distance > 0").unionByName(own)
    mine = grants.where(F.col("action").isin(action, "*")).join(holds, "principal")
    wild = lambda c: (F.col(c) == "*").cast("int")
    mine = mine.withColumn("_wild", wild("kind") + wild("scope") + wild("action"))
    rank = F.struct(F.when(F.col("distance") > 0, 2).when(F.col("_wild") > 0, 1).otherwise(0).alias("rule"), "distance", "_wild", (F.col("effect") != "deny").alias("allowed"))
    best = mine.groupBy("user", F.col("kind").alias("_kind"), F.col("scope").alias("_scope")).agg(F.min(rank).alias("_rank"))
    # each row may match four ways, each an equality, so the join hashes; a user's grants are aggregated before
    ways = F.array(*[F.struct(k.alias("_kind"), s.alias("_scope")) for k in (F.col("kind"), F.lit("*")) for s in (F.col("scope"), F.lit("*"))])
    asked = rows.select("id", "user", F.explode(ways).alias("_w")).select("id", "user", "_w.*")
    found = asked.join(best, ["user", "_kind", "_scope"]).groupBy("id", "user").agg(F.min("_rank").alias("_rank"))
    rule = F.get(F.array(*map(F.lit, ["explicit", "wildcard", "inherited"])), F.col("_rank.rule"))
    return rows.join(found, ["id", "user"], "left").withColumns({"allowed": F.coalesce("_rank.allowed", F.lit(False)), "rule": F.coalesce(rule, F.lit("none"))}).drop("_rank")


def seed_paths(explicit: list[str] | None, domain: str | None, data: str | None, demo: str) -> list[str]:
    """Where a graph is loaded from: what was named, else the first folder that exists."""
    if explicit:
        return explicit
    for folder in (domain, data):
        if folder and Path(folder).is_dir():
            return sorted(str(p) for p in Path(folder).glob("*.jsonl"))
    return sorted(str(p) for p in Path(demo).glob("*.jsonl"))
