"""Absence as evidence: what a source was asked for and did not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.functions import scoring as S

#: What two domains under common control should show: description, source, how to look.
COMMON_CONTROL = (
    ("the registrar of {a} is that of {b}", "rdap", "look both up and set the registrars side by side"),
    ("{a} and {b} were registered at about the same time", "rdap", "set the dates of registration side by side"),
    ("one certificate names {a} and {b}", "crtsh", "look for certificates with both among their names"),
    ("{a} and {b} list one seller of advertisements as their own", "sellers_json", "set their direct sellers side by side"),
    ("the archive has {a} and {b} from the same years", "wayback", "set the first and last captures side by side"),
)


def with_absence(checks: DataFrame) -> DataFrame:
    """Add llr, weight and strength to (source, kind, ...)."""
    out = checks.withColumn("llr", S.absence_llr(F.col("source"), F.col("kind")))
    return out.withColumns({"weight": F.least(F.abs("llr") / 4.0, F.lit(1.0)), "strength": S.absence_strength(F.col("source"))})


def absence_claims(checks: DataFrame) -> DataFrame:
    """Claims from (claim_pos, case_ref, subject_kind, subject_value, subject_key, source, kind, query_url, sought, observed_at).

    They contradict with the weight that gives the absence its size, at moderate reliability.
    """
    c = with_absence(checks)
    raw = F.to_json(F.struct(F.col("kind").alias("absence_kind"), "sought", F.round("llr", 3).alias("llr"), "strength"))
    return c.select(
        "claim_pos", "case_ref", "subject_kind", "subject_value", "subject_key", F.lit("contradicts").alias("predicate"),
        F.lit(None).cast("string").alias("object_kind"), F.concat(F.lit("absent:"), "source").alias("object_value"), F.lit(None).cast("string").alias("object_key"),
        F.concat("source", F.lit(":negative")).alias("collector"), F.col("query_url").alias("source_url"), F.lit(0.65).alias("reliability"), "weight",
        "observed_at", F.col("observed_at").alias("retrieved_at"), F.concat_ws("|", F.lit("absence"), "source", "subject_key").alias("correlation_group"), F.lit("").alias("dependence_class"), raw.alias("raw"),
    )


def expectations(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, description, source, check): the checklist for each pair."""
    rows = [F.struct(F.replace(F.replace(F.lit(d), F.lit("{a}"), F.col(a)), F.lit("{b}"), F.col(b)).alias("description"), F.lit(s).alias("source"), F.lit(c).alias("check")) for d, s, c in COMMON_CONTROL]
    return pairs.select(a, b, F.explode(F.array(*rows)).alias("e")).select(a, b, "e.*")


def status(satisfied: Column) -> Column:
    return F.when(satisfied.isNull(), "not checked").when(satisfied, "confirmed").otherwise("not found")


def failed_expectations(checked: DataFrame) -> DataFrame:
    """Of (source, satisfied, ...) what was checked and not found, as expected absences."""
    return with_absence(checked.where(~F.col("satisfied")).withColumn("kind", F.lit("expected_absent")))


def expectation_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(status(F.col("satisfied")).alias("status")).agg(F.count("*").alias("n"))
