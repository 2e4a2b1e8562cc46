"""From claims to scored pairs: holders, likelihoods, candidate pairs and the three levels of aggregation.

A claims table has claim_pos, case_ref, subject_kind, subject_value, subject_key, predicate,
object_kind (null for a literal), object_value, object_key, collector, source_url, reliability,
weight, observed_at, retrieved_at, correlation_group, dependence_class, raw. ``claim_pos`` is the
order of arrival; it decides every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import scoring as S
from provenor.operators import cells
from provenor.operators.cells import SHOWN


def complete(claims: DataFrame) -> DataFrame:
    """Fill what a claim may leave out."""
    return claims.withColumns({
        "observed_at": F.coalesce("observed_at", "retrieved_at"),
        "correlation_group": F.when(F.coalesce("correlation_group", F.lit("")) == "", F.concat_ws("|", "collector", "source_url")).otherwise(F.col("correlation_group")),
    })


def identifiers(claims: DataFrame) -> DataFrame:
    """(key, kind, value, first_pos): every subject and identifier object, the first sight of each."""
    ends = claims.select(F.col("subject_key").alias("key"), F.col("subject_kind").alias("kind"), F.col("subject_value").alias("value"), "claim_pos").unionByName(
        claims.where("object_kind is not null").select(F.col("object_key").alias("key"), F.col("object_kind").alias("kind"), F.col("object_value").alias("value"), "claim_pos")
    )
    first = F.min_by(F.struct("kind", "value"), "claim_pos")
    return ends.groupBy("key").agg(first.alias("x"), F.min("claim_pos").alias("first_pos")).select("key", "x.kind", "x.value", "first_pos")


def holders(claims: DataFrame) -> DataFrame:
    """(key, holders): distinct subjects of an object, and the object itself."""
    own = F.max((F.col("subject_key") == F.col("object_key")).cast("bigint"))
    some = claims.where("object_kind is not null")
    return some.groupBy(F.col("object_key").alias("key")).agg((F.count_distinct("subject_key") + 1 - own).alias("holders"))


def composite_holders(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first index where it counts anything, else the second."""
    both = primary.select("key", F.col("holders").alias("p")).join(fallback.select("key", F.col("holders").alias("f")), "key", "full_outer")
    return both.select("key", F.when(F.col("p") > 0, F.col("p")).otherwise(F.coalesce("f", F.lit(0))).alias("holders"))


def with_evidence(claims: DataFrame, index: DataFrame, as_of: Column, universe: float = K.DEFAULT_UNIVERSE, ascii_only: bool = False) -> DataFrame:
    """Add target_key, holders, llr, gkey, definitional and substantive."""
    target = F.when(F.col("object_kind").isNotNull(), F.col("object_key")).otherwise(F.col("subject_key"))
    out = claims.withColumn("target_key", target).join(index.select(F.col("key").alias("target_key"), "holders"), "target_key", "left")
    return _judged(out, as_of, universe, ascii_only)


def _judged(out: DataFrame, as_of: Column, universe: float, ascii_only: bool) -> DataFrame:
    return out.withColumns({
        "holders": F.coalesce("holders", F.lit(1)),
        "gkey": S.canonical_group(F.col("correlation_group"), ascii_only),
        "definitional": S.definitional(F.col("predicate"), F.col("reliability"), F.col("weight"), F.col("collector")),
        "substantive": ~F.col("predicate").isin(*K.CORROBORATIVE),
    }).withColumn("llr", S.claim_llr(F.col("predicate"), F.col("reliability"), F.col("weight"), F.col("observed_at"), as_of, F.col("holders"), universe))


def pairable(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("object_kind").isNotNull() & ~F.col("predicate").isin(*K.RELATIONSHIPS, *K.ATTRIBUTES))


#: What a group of claims comes to, and how the parts of a group combine.
def _summary(ordinal: Column) -> dict[str, Column]:
    llr = F.col("llr")
    first = F.struct(ordinal.alias("ord"), F.col("collector").alias("collector"))
    # sums of multiples of 2^-28 and of what is left are exact, so no order of rows decides which of two equal groups is stronger
    against = F.when(llr < 0, llr).otherwise(0.0)
    coarse = F.rint(against * 2.0**28) / 2.0**28
    return {
        "top": F.max(F.when(llr > 0, llr)), "n_pos": F.count_if(llr > 0), "neg": F.sum(coarse), "fine": F.sum(F.nanvl(against - coarse, F.lit(0.0))),
        "definitional": F.bool_or("definitional"), "substantive": F.bool_or("substantive"), "first": F.min(first),
        "declared": F.collect_set(F.when(F.col("dependence_class").isin(*K.DISCOUNTS), F.col("dependence_class"))),
    }


def legs(evidence: DataFrame) -> DataFrame:
    """(case_ref, subject_key, object_key, gkey) with what the claims between the two come to.

    Maxima, counts, sums and firsts combine, so pairs are made of these and not of claims.
    """
    keys = ["case_ref", "subject_key", "object_key", "gkey"]
    out = pairable(evidence).groupBy(*keys).agg(*[c.alias(n) for n, c in _summary(F.col("claim_pos")).items()])
    return out


_LEG = ("gkey", "top", "n_pos", "neg", "fine", "definitional", "substantive", "first", "declared")


def pair_legs(legs_table: DataFrame) -> DataFrame:
    """(case_ref, a, b, leg, arm, object_first): direct edges and both legs of shared objects, all kept.

    ``arm`` 0 is direct, 1 shared; with ``object_first`` and the leg's first claim it is the order of arrival.
    """
    leg = F.struct(*_LEG).alias("leg")
    direct = legs_table.select("case_ref", F.least("subject_key", "object_key").alias("a"), F.greatest("subject_key", "object_key").alias("b"), leg, F.lit(0).alias("arm"), F.lit(0).cast("bigint").alias("object_first"))
    held = legs_table.groupBy("case_ref", "object_key", "subject_key").agg(F.collect_list(F.struct(*_LEG)).alias("legs"), F.min("first.ord").alias("first_pos"))
    # a subject's groups under one object travel together: one join gives a pair both legs
    left = held.select("case_ref", "object_key", F.col("subject_key").alias("a"), F.col("legs").alias("left_legs"), F.col("first_pos").alias("left_first"))
    right = held.select("case_ref", "object_key", F.col("subject_key").alias("b"), F.col("legs").alias("right_legs"), F.col("first_pos").alias("right_first"))
    firsts = legs_table.groupBy("case_ref", "object_key").agg(F.min("first.ord").alias("object_first"))
    shared = left.join(right, ["case_ref", "object_key"]).where("a < b").join(firsts, ["case_ref", "object_key"])
    both = shared.select("case_ref", "a", "b", F.explode(F.concat("left_legs", "right_legs")).alias("leg"), F.lit(1).alias("arm"), "object_first")
    return direct.unionByName(both)


def direct_pairs(claims: DataFrame) -> DataFrame:
    return pairable(claims).select("case_ref", F.least("subject_key", "object_key").alias("a"), F.greatest("subject_key", "object_key").alias("b")).distinct()


def coreference_pairs(claims: DataFrame) -> DataFrame:
    """(case_ref, a, b, objects): pairs of subjects and how many objects they share."""
    held = pairable(claims).select("case_ref", "object_key", "subject_key").distinct()
    left, right = held.withColumnRenamed("subject_key", "a"), held.withColumnRenamed("subject_key", "b")
    return left.join(right, ["case_ref", "object_key"]).where("a < b").groupBy("case_ref", "a", "b").agg(F.count("*").alias("objects"))


def group_aggregate(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(case_ref, a, b, gkey): the strongest likelihood plus ln of how many, capped, and all that is against."""
    leg = F.col("leg")
    ordinal = F.struct(F.col("arm").alias("arm"), F.col("object_first").alias("object_first"), leg["first"]["ord"].alias("pos"))
    out = pairs.groupBy("case_ref", "a", "b", leg["gkey"].alias("gkey")).agg(
        F.max(leg["top"]).alias("top"), F.sum(leg["n_pos"]).alias("n_pos"), (F.sum(leg["neg"]) + F.sum(leg["fine"])).alias("neg"),
        F.bool_or(leg["definitional"]).alias("definitional"), F.bool_or(leg["substantive"]).alias("substantive"),
        F.min(F.struct(ordinal.alias("ord"), leg["first"]["collector"].alias("collector"))).alias("first"),
        F.array_distinct(F.flatten(F.collect_list(leg["declared"]))).alias("declared"),
    )
    declared = F.try_element_at(F.array_sort("declared"), F.lit(1))
    if strict:
        said = F.concat(F.lit("correlation group carries conflicting dependence classes: "), F.col("gkey"))
        declared = F.when(F.size("declared") > 1, F.raise_error(said)).otherwise(declared)
    cap = F.when(F.col("definitional"), K.DEFINITIONAL_GROUP_CAP).otherwise(K.GROUP_CAP)
    support = F.when(F.col("n_pos") > 0, F.least(F.col("top") + F.ln(F.col("n_pos")), cap)).otherwise(0.0)
    return out.select(
        "case_ref", "a", "b", "gkey", (support + F.col("neg")).alias("llr"), "n_pos", "definitional", "substantive",
        F.col("first.ord").alias("ord"), F.col("first.collector").alias("collector"),
        S.classify_group(F.col("gkey"), F.col("first.collector"), declared).alias("class"),
    )


def class_aggregate(groups: DataFrame) -> DataFrame:
    """(case_ref, a, b, class): the strongest group whole, the others discounted; and how many lines of evidence it is."""
    factor = F.element_at(F.create_map(*[F.lit(x) for p in K.DISCOUNTS.items() for x in p]), F.col("class"))
    counted = F.col("substantive") & (F.col("llr") != 0)
    # what is shown of a pair is marked first, so that no row gathers more of its evidence than that
    place = F.row_number().over(W.partitionBy("case_ref", "a", "b").orderBy((-F.abs("llr")), "ord", "gkey", "llr"))
    shown = F.struct((-F.abs("llr")).alias("size"), "ord", "gkey", "llr")
    out = groups.withColumn("place", place).groupBy("case_ref", "a", "b", "class").agg(
        F.count("*").alias("n_groups"), F.sum("llr").alias("raw"),
        # of equal strength the first
        F.min(F.struct((-F.abs("llr")).alias("size"), F.col("ord").alias("ord"), F.col("llr").alias("llr")))["llr"].alias("strongest"),
        F.count_if(counted).alias("counted"), F.bool_or("definitional").alias("definitional"), F.min("ord").alias("ord"),
        F.collect_list(F.when(F.col("place") <= SHOWN, shown)).alias("evidence"),
    )
    whole = (F.col("class") == "independent") | (F.col("n_groups") == 1)
    return out.withColumns({
        "adjusted": F.when(whole, F.col("raw")).otherwise(F.col("strongest") + factor * (F.col("raw") - F.col("strongest"))),
        "lines": F.when(F.col("class") == "independent", F.col("counted")).otherwise(F.least("counted", F.lit(1))),
        "discounted": F.when(whole, 0).otherwise(F.col("n_groups") - 1),
    })


def assessments(classes: DataFrame) -> DataFrame:
    """(case_ref, a, b): log-odds, probability, band and what they rest on."""
    out = classes.groupBy("case_ref", "a", "b").agg(
        (F.lit(S.PRIOR_LOG_ODDS) + F.sum("adjusted")).alias("log_odds"), F.sum("lines").cast("bigint").alias("independent_groups"),
        F.bool_or("definitional").alias("definitional"), F.min("ord").alias("pair_ord"),
        F.sum("raw").alias("raw_total"), F.sum("adjusted").alias("adjusted_total"), F.sum("discounted").cast("bigint").alias("discounted_groups"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n_groups")))).alias("classes"),
        F.array_sort(F.flatten(F.collect_list("evidence"))).alias("evidence"),
    )
    out = out.withColumn("probability", S.probability(F.col("log_odds")))
    out = out.withColumn("band", S.band(F.col("probability"), F.col("independent_groups"), F.col("definitional")))
    return out.withColumns({
        "top_evidence": F.transform("evidence", lambda e: F.struct(e["gkey"].alias("group"), e["llr"].alias("llr"))),
        "reduction": F.when(F.col("raw_total") != 0, 1 - F.col("adjusted_total") / F.col("raw_total")).otherwise(0.0),
        "estimative": S.estimative(F.col("band")),
    }).drop("evidence")


def in_cells(claims: DataFrame, as_of: Column, index: DataFrame | None = None, universe: float = K.DEFAULT_UNIVERSE, ascii_only: bool = False, **how) -> DataFrame:
    """All candidate pairs of the claims at one level of aggregation, found and summed up in cells; see ``cells.scored``."""
    some = pairable(claims)
    index = (holders(claims) if index is None else index).select(F.col("key").alias("object_key"), "holders")
    # these claims' targets are their objects: joined by object, they stay where they are for all that follows up to the blocks
    found = legs(_judged(some.join(index, "object_key", "left"), as_of, universe, ascii_only))
    own = F.col("case_ref").isNotNull() & F.col("object_key").isNotNull()
    first = F.when(own, F.min("first.ord").over(W.partitionBy("case_ref", "object_key"))).otherwise(F.col("first.ord"))
    p = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.scored(found.withColumn("object_first", first), cells.blocks(some.count(), p), **how)


def banded(pairs: DataFrame) -> DataFrame:
    """Probability and band of (log_odds, independent_groups, definitional)."""
    out = pairs.withColumn("probability", S.probability(F.col("log_odds")))
    return out.withColumn("band", S.band(F.col("probability"), F.col("independent_groups"), F.col("definitional")))


def assess_pairs(claims: DataFrame, as_of: Column, index: DataFrame | None = None, universe: float = K.DEFAULT_UNIVERSE, ascii_only: bool = False, strict: bool = False) -> DataFrame:
    """All candidate pairs of the claims, scored."""
    out = banded(in_cells(claims, as_of, index, universe, ascii_only, strict=strict))
    return out.withColumns({
        "reduction": F.when(F.col("raw_total") != 0, 1 - F.col("adjusted_total") / F.col("raw_total")).otherwise(0.0),
        "estimative": S.estimative(F.col("band")),
    })


def sub_additive(values: Column, discount: float) -> Column:
    """The value of largest size whole, the others discounted."""
    ordered = F.array_sort(F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("i"), v.alias("v"))))
    top = F.try_element_at(ordered, F.lit(1))["v"]
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) == 0, 0.0).otherwise(top + F.lit(discount) * (total - top))
