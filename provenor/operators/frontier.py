"""Expanding seeds through collectors, level by level, within a case's budgets."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions.text import lookup
from provenor.operators.record import audit
from provenor.operators.resolution import checkpointed
from provenor.sources.case import Case, source_class


@dataclass(frozen=True)
class Collector:
    """A source of claims: given identifiers (key, kind, value) it returns claims about them."""

    name: str
    accepts: tuple[str, ...]
    collect: Callable[[DataFrame], DataFrame]
    source_class: str = "public_registry"
    priority: int = 5
    person_scoped: bool = False


@dataclass(frozen=True)
class Expansion:
    """``stopped``: the budget that ended it early; ``gated``: collectors that were not asked, and why."""

    claims: DataFrame | None
    seen: DataFrame
    nodes_truncated: bool
    stopped: str = ""
    requests: int = 0
    gated: tuple[tuple[str, str], ...] = ()


def over_claims(claims: DataFrame, name: str = "table", accepts: tuple[str, ...] = K.KINDS) -> Collector:
    """A collector over a table of claims: what is said of an identifier, from either end."""

    def collect(asked: DataFrame) -> DataFrame:
        keys = asked.select("key")
        return claims.join(keys, F.col("subject_key") == F.col("key"), "left_semi").unionByName(claims.join(keys, F.col("object_key") == F.col("key"), "left_semi")).dropDuplicates(["claim_pos"])

    return Collector(name, accepts, collect)


def expand(seeds: DataFrame, collectors: list[Collector], ingest: Callable[[DataFrame], DataFrame] = lambda c: c, radius: int = 3, max_nodes: int = 20_000, before_resolve: Callable[[DataFrame], DataFrame] | None = None, case: Case | None = None) -> Expansion:
    """``seeds``: key, kind, value. Each level's identifiers are asked for once; those of pivotable kinds are gone on with.

    A ``case`` sets radius and budgets, keeps out collectors of persons that it does not allow, and is told in its
    audit log what was gated or cut. Collectors of denied classes are refused before anything is asked. A budget of
    requests is spent level by level: a level that would exceed it is not asked.
    """
    for c in collectors:
        source_class(c.source_class)
    gated, stopped, requests, begun = [], "", 0, time.monotonic()
    most, longest = (1 << 62, 1 << 62)
    if case is not None:
        radius, max_nodes, most, longest = case.pivot_radius, case.max_nodes, case.max_requests, case.max_runtime_s
        for c in [c for c in collectors if c.person_scoped]:
            ok, why = case.persona_gate(c.name)
            if not ok:
                gated.append((c.name, why))
                audit(case, "collector_gated", collector=c.name, reason=why)
        collectors = [c for c in collectors if c.name not in dict(gated)]
    seen = checkpointed(seeds.select("key", "kind", "value").dropDuplicates(["key"]).withColumn("depth", F.lit(0)))
    level, gathered, cut = seen, None, False
    for depth in range(radius + 1):
        if time.monotonic() - begun > longest:
            stopped = "max_runtime_s"
            break
        if case is not None:
            asked = level.agg(*[F.count_if(F.col("kind").isin(*c.accepts)).alias(f"n{i}") for i, c in enumerate(collectors)]).head() if collectors else ()
            if requests + sum(asked) > most:
                stopped = "max_requests"
                break
            requests += sum(asked)
        found = None
        for c in sorted(collectors, key=lambda c: c.priority):
            got = c.collect(level.where(F.col("kind").isin(*c.accepts)))
            found = got if found is None else found.unionByName(got)
        if found is None:
            break
        gathered = checkpointed(ingest(found if gathered is None else gathered.unionByName(found)).dropDuplicates(["claim_pos"]))
        if depth == radius:
            break
        ends = gathered.select(F.col("subject_key").alias("key"), F.col("subject_kind").alias("kind"), F.col("subject_value").alias("value")).unionByName(gathered.where("object_kind is not null").select(F.col("object_key").alias("key"), F.col("object_kind").alias("kind"), F.col("object_value").alias("value")))
        fresh = ends.where(F.col("kind").isin(*K.PIVOTABLE)).dropDuplicates(["key"]).join(seen, "key", "left_anti")
        fresh = fresh.withColumn("depth", F.lit(depth + 1)).withColumn("priority", lookup(K.PRIORITY, F.col("kind"), K.DEFAULT_PRIORITY))
        room = max_nodes - seen.count()
        fresh = checkpointed(fresh)
        if fresh.count() > room:
            cut, fresh = True, checkpointed(fresh.orderBy("priority", "key").limit(max(room, 0)))
        level = fresh.drop("priority")
        if level.isEmpty():
            break
        seen = checkpointed(seen.unionByName(level))
    if gathered is not None and before_resolve:
        gathered = before_resolve(gathered)
    if case is not None and (stopped or cut):
        audit(case, "budget_stop", reason=stopped or "max_nodes")
    return Expansion(gathered, seen, cut, stopped, requests, tuple(gated))
