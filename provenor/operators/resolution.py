"""Merging pairs into entities under constraints, highest score first.

Merges never leave a connected component of the mergeable pairs, so components are found
first, as a distributed iteration, and the greedy merge runs inside each. What limits it is the
largest component, not the number of claims.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions.text import entity_type, kind_of
from provenor.scratch import scratch_dir

MUST_NOT_LINK = "must-not-link"
TOO_FEW_GROUPS = "insufficient independent evidence groups"
TYPE_CONFLICT = "type conflict"
#: No pair that is merged, nor the best of a cluster, has less, unless it is definitional or of one key: a probability of 0.8.
INSIDE_LOG_ODDS = 1.386


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared checkpoint folder; one is made where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def mergeable(scored: DataFrame) -> DataFrame:
    sure = F.col("definitional") & F.col("band").isin("MODERATE_EVIDENCE", "STRONG_EVIDENCE")
    return scored.where((F.col("log_odds") >= K.MERGE_LOG_ODDS) | sure)


def forbidden_pairs(claims: DataFrame) -> DataFrame:
    """(case_ref, a, b) that contradict each other or are related as different things."""
    some = claims.where(F.col("object_kind").isNotNull() & F.col("predicate").isin("contradicts", *K.RELATIONSHIPS))
    return some.select("case_ref", F.least("subject_key", "object_key").alias("a"), F.greatest("subject_key", "object_key").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(case_ref, key, component): minimum labels with pointer jumping until nothing changes."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    # an edge's two ways are laid out from one row: what makes the edges runs once
    both = checkpointed(edges.select("case_ref", F.explode(ways).alias("e")).select("case_ref", "e.a", "e.b").distinct())
    labels = checkpointed(both.groupBy("case_ref", F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("key", "b"), ["case_ref", "b"]).groupBy("case_ref", F.col("a").alias("key")).agg(F.min("component").alias("near"))
        lower = labels.join(near, ["case_ref", "key"]).select("case_ref", "key", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        above = labels.select("case_ref", F.col("key").alias("via"), F.col("component").alias("above"))
        labels = checkpointed(lower.join(above, ["case_ref", "via"]).select("case_ref", "key", "old", F.least("via", "above").alias("component")))
        if labels.where("old <> component").isEmpty():
            return labels.select("case_ref", "key", "component")
        labels = labels.drop("old")
    raise RuntimeError("components did not settle")


def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component's rows (what: pair or forbidden) merged in order; its members and rejections."""
    pairs = pdf[pdf.what == "pair"].sort_values(["log_odds", "rank"], ascending=[False, True], kind="stable")
    against: dict[str, set[str]] = {}
    for a, b in pdf.loc[pdf.what == "forbidden", ["a", "b"]].itertuples(index=False):
        against.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)
    keys = dict.fromkeys([*pairs.a, *pairs.b])
    cluster = {k: k for k in keys}
    members = {k: {k} for k in keys}
    enemies = {k: set(against.get(k, ())) for k in keys}
    flags = {k: {K.ENTITY_TYPES.get(k.split(":", 1)[0], "Unknown")} & {"Person", "Company"} for k in keys}
    out = []
    for a, b, band, definitional in pairs[["a", "b", "band", "definitional"]].itertuples(index=False):
        x, y = cluster[a], cluster[b]
        small, large = (x, y) if len(members[x]) <= len(members[y]) else (y, x)
        if members[small] & enemies[large] or (x == y and enemies[x] & members[x]):
            out.append(("rejected", a, b, MUST_NOT_LINK))
        elif band in ("WEAK", K.LOWEST_BAND) and not definitional:
            out.append(("rejected", a, b, TOO_FEW_GROUPS))
        elif len(flags[x] | flags[y]) == 2:
            out.append(("rejected", a, b, TYPE_CONFLICT))
        elif x != y:
            for k in members[small]:
                cluster[k] = large
            members[large] |= members.pop(small)
            enemies[large] |= enemies.pop(small)
            flags[large] |= flags.pop(small)
    roots = {r: min(m) for r, m in members.items()}
    out += [("member", k, roots[cluster[k]], "") for k in keys]
    return pd.DataFrame(out, columns=["what", "a", "b", "reason"]).assign(case_ref=pdf.case_ref.iloc[0])


def merge(scored: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(case_ref, what, a, b, reason): 'member' rows give key and cluster, 'rejected' rows pairs that were not merged."""
    candidates = mergeable(scored).select("case_ref", "a", "b", "log_odds", "band", "definitional", "pair_ord")
    label = components(candidates)
    of_a = label.select("case_ref", F.col("key").alias("a"), "component")
    of_b = label.select("case_ref", F.col("key").alias("b"), F.col("component").alias("other"))
    rank = F.struct("pair_ord.arm", "pair_ord.object_first", "pair_ord.pos", "a", "b")
    pairs = candidates.join(of_a, ["case_ref", "a"]).select("case_ref", "component", F.lit("pair").alias("what"), "a", "b", "log_odds", "band", "definitional", F.to_json(rank).alias("__"), rank.alias("rank"))
    # the order within equal scores, as text that sorts alike
    text = F.format_string("%d %020d %020d %s %s", "rank.arm", "rank.object_first", "rank.pos", "a", "b")
    pairs = pairs.withColumn("rank", text).drop("__")
    barred = forbidden.join(of_a, ["case_ref", "a"]).join(of_b, ["case_ref", "b"]).where("component = other").select(
        "case_ref", "component", F.lit("forbidden").alias("what"), "a", "b", F.lit(0.0).alias("log_odds"), F.lit("").alias("band"), F.lit(False).alias("definitional"), F.lit("").alias("rank")
    )
    return pairs.unionByName(barred).groupBy("case_ref", "component").applyInPandas(greedy, "what string, a string, b string, reason string, case_ref string")


def rejected(merged: DataFrame) -> DataFrame:
    return merged.where("what = 'rejected'").select("case_ref", "a", "b", "reason")


def membership(merged: DataFrame, idents: DataFrame) -> DataFrame:
    """(case_ref, key, kind, value, cluster): every identifier, alone where nothing merged it."""
    own = merged.where("what = 'member'").select("case_ref", F.col("a").alias("key"), F.col("b").alias("cluster"))
    return idents.join(own, ["case_ref", "key"], "left").withColumn("cluster", F.coalesce("cluster", "key"))


def entities(members: DataFrame, scored: DataFrame, claims: DataFrame, allowed: tuple[str, ...] = K.TYPE_RANK) -> DataFrame:
    """(case_ref, entity_id, type, identifiers, labels, best_label, attributes, log_odds)."""
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(K.TYPE_RANK) for x in (t, i)])
    by = members.groupBy("case_ref", "cluster").agg(F.max(F.element_at(ranks, entity_type(F.col("kind")))).alias("rank"), F.array_sort(F.collect_set("key")).alias("identifiers"))
    by = by.withColumn("type", F.element_at(F.array(*[F.lit(t) for t in K.TYPE_RANK]), F.col("rank") + 1))
    by = by.where((F.col("type").isin(*allowed) | (F.col("type") == "Unknown")) & ~((F.size("identifiers") == 1) & (F.col("type") == "Unknown")))
    place = members.select("case_ref", F.col("key").alias("subject_key"), "cluster")
    inside = scored.join(members.select("case_ref", F.col("key").alias("a"), F.col("cluster").alias("ca")), ["case_ref", "a"]).join(members.select("case_ref", F.col("key").alias("b"), F.col("cluster").alias("cb")), ["case_ref", "b"])
    best = inside.where("ca = cb").groupBy("case_ref", F.col("ca").alias("cluster")).agg(F.max("log_odds").alias("log_odds"))
    labels = entity_labels(members, claims.join(place, ["case_ref", "subject_key"]))
    attributes = entity_attributes(claims.join(place, ["case_ref", "subject_key"]))
    named = labels.groupBy("case_ref", "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "weight")))).alias("labels"), F.min(F.struct((-F.col("weight")).alias("w"), "ord", "label"))["label"].alias("best_label"))
    listed = attributes.groupBy("case_ref", "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "vals")))).alias("attributes"))
    out = by.join(best, ["case_ref", "cluster"], "left").join(named, ["case_ref", "cluster"], "left").join(listed, ["case_ref", "cluster"], "left")
    return out.select("case_ref", F.sha2(F.col("cluster"), 256).alias("entity_id"), "cluster", "type", "identifiers", "labels", F.coalesce("best_label", F.element_at("identifiers", 1)).alias("best_label"), "attributes", F.coalesce("log_odds", F.lit(0.0)).alias("log_odds"))


def entity_labels(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(case_ref, cluster, label, weight, ord): 1 for a name identifier, twice the reliability for a legal name."""
    names = members.where(F.col("kind").isin("org_name", "person_name")).select("case_ref", "cluster", F.col("value").alias("label"), F.lit(1.0).alias("w"), F.struct(F.lit(0).alias("s"), F.col("first_pos").alias("p")).alias("o"))
    legal = placed.where("predicate = 'legal_name'").select("case_ref", "cluster", F.col("object_value").alias("label"), (F.col("reliability") * 2).alias("w"), F.struct(F.lit(1).alias("s"), F.col("claim_pos").alias("p")).alias("o"))
    return names.unionByName(legal).groupBy("case_ref", "cluster", "label").agg(F.sum("w").alias("weight"), F.min("o").alias("ord"))


def entity_attributes(placed: DataFrame) -> DataFrame:
    """(case_ref, cluster, predicate, vals): distinct values in order of arrival."""
    own = placed.where(F.col("predicate").isin(*K.ATTRIBUTES)).groupBy("case_ref", "cluster", "predicate", "object_value").agg(F.min("claim_pos").alias("pos"))
    vals = F.transform(F.array_sort(F.collect_list(F.struct("pos", "object_value"))), lambda x: x["object_value"])
    return own.groupBy("case_ref", "cluster", "predicate").agg(vals.alias("vals"))


def resolve(claims: DataFrame, scored: DataFrame, idents: DataFrame, allowed: tuple[str, ...] = K.TYPE_RANK) -> tuple[DataFrame, DataFrame]:
    """Entities and rejections of scored claims; ``idents`` has case_ref, key, kind, value, first_pos."""
    scored = checkpointed(scored.where((F.col("log_odds") >= INSIDE_LOG_ODDS) | F.col("definitional") | (F.col("a") == F.col("b"))))
    merged = checkpointed(merge(scored, forbidden_pairs(claims)))
    return entities(membership(merged, idents), scored, claims, allowed), rejected(merged)


def unknown_kind(key: str = "key"):
    return entity_type(kind_of(F.col(key)))
