"""Deciding at arrival whether a claim is kept, demoted or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.functions import constants as K


def blacklist(lines: DataFrame) -> DataFrame:
    """(domain) from text lines: comments after #, blanks and case do not count."""
    d = F.lower(F.trim(F.split_part(F.col("value"), F.lit("#"), F.lit(1))))
    return lines.select(d.alias("domain")).where("domain <> ''").distinct()


def _static(shared: Column) -> list[tuple[Column, str, str]]:
    """The rules that look at the claim alone, in order: condition, verdict, reason."""
    kind, value = F.col("object_kind"), F.col("object_value")
    local = F.split_part(value, F.lit("@"), F.lit(1))
    name = kind.isin("person_name", "org_name")
    return [
        ((kind == "email") & (local.isin(*K.ROLE_ACCOUNTS) | local.startswith("noreply")), "drop", "role account"),
        (name & value.rlike(f"(?iu){K.PRIVACY_PROXY}"), "drop", "privacy placeholder"),
        (name & value.rlike(f"(?iu){K.NOMINEE_AGENT}"), "demote", "registered agent or nominee"),
        (name & (F.length(value) < 3), "drop", "name too short"),
        ((kind == "domain") & shared, "demote", "shared infrastructure"),
        ((kind == "postal_address") & value.rlike(f"(?iu){K.NOMINEE_AGENT}"), "demote", "mass registration address"),
        ((F.col("predicate") == "registrant") & value.rlike(f"(?iu){K.HOSTING_ORG}"), "demote", "hosting or registrar organisation"),
    ]


def _chain(rules: list[tuple[Column, Column | str]], last: Column) -> Column:
    out = None
    for condition, value in rules:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(last)


def verdicts(claims: DataFrame, shared: DataFrame | None = None, max_holders: int = K.MAX_HOLDERS) -> DataFrame:
    """Add verdict, reason and holders_before (as the index stood when the claim arrived).

    Dropped claims never reach the index; that rule looks at the claim alone, so the running
    count is a window over the others.
    """
    if shared is not None:
        claims = claims.join(shared.select(F.col("domain").alias("object_value"), F.lit(True).alias("__shared")), "object_value", "left")
    else:
        claims = claims.withColumn("__shared", F.lit(False))
    rules = _static(F.coalesce("__shared", F.lit(False)))
    own = claims.withColumns({"__verdict": _chain([(c, F.lit(v)) for c, v, _ in rules], F.lit(None).cast("string")), "__reason": _chain([(c, F.lit(r)) for c, _, r in rules], F.lit(None).cast("string"))})
    entered = F.coalesce(F.col("__verdict") != "drop", F.lit(True)) & F.col("object_kind").isNotNull()
    first = F.row_number().over(W.partitionBy("case_ref", "object_key", "subject_key", entered).orderBy("claim_pos")) == 1
    # the object itself counts as a holder before anyone has claimed it
    new = entered & first & (F.col("subject_key") != F.col("object_key"))
    before = F.sum(F.col("__new").cast("bigint")).over(W.partitionBy("case_ref", "object_key").orderBy("claim_pos").rowsBetween(W.unboundedPreceding, -1))
    counted = own.withColumn("__new", new).withColumn("holders_before", F.when(F.col("object_kind").isNotNull(), F.coalesce(before, F.lit(0)) + 1).otherwise(0))
    crowded = F.col("holders_before") > max_holders
    return counted.withColumns({
        "verdict": F.coalesce("__verdict", F.when(crowded, "demote").otherwise("keep")),
        "reason": F.coalesce("__reason", F.when(crowded, "low selectivity").otherwise("")),
    }).drop("__verdict", "__reason", "__new", "__shared")


def ingest(claims: DataFrame, shared: DataFrame | None = None, max_holders: int = K.MAX_HOLDERS) -> DataFrame:
    """The claims that enter: without the dropped; the demoted weigh nothing but stay."""
    judged = verdicts(claims, shared, max_holders).where("verdict <> 'drop'")
    return judged.withColumns({"weight": F.when(F.col("verdict") == "demote", 0.0).otherwise(F.col("weight")), "demoted": F.when(F.col("verdict") == "demote", F.col("reason"))}).drop("verdict", "reason", "holders_before")
