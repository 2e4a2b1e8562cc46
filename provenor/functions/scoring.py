"""The scalar formulas of evidence scoring, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions.text import lookup, normalise


def selectivity(holders: Column, universe: float | Column = K.DEFAULT_UNIVERSE, cardinality: int = 2) -> Column:
    others = F.greatest(holders, F.lit(1)) - 1 + K.ALPHA
    total = (universe if isinstance(universe, Column) else F.lit(float(universe))) + K.ALPHA * cardinality
    return F.greatest(others / total, F.lit(K.SELECTIVITY_FLOOR))


def decay(predicate: Column, observed_at: Column, as_of: Column) -> Column:
    """Half as much after each half-life; times to come count as now."""
    days = F.greatest(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(observed_at), F.lit(0)) / 8.64e10
    lasting = [p for p, h in K.HALF_LIVES.items() if h is None]
    return F.when(predicate.isin(*lasting), 1.0).otherwise(F.pow(F.lit(0.5), days / lookup(K.HALF_LIVES, predicate, K.DEFAULT_HALF_LIFE)))


def claim_llr(predicate: Column, reliability: Column, weight: Column, observed_at: Column, as_of: Column, holders: Column, universe=K.DEFAULT_UNIVERSE) -> Column:
    support = reliability * weight * decay(predicate, observed_at, as_of) * F.ln(1.0 / selectivity(holders, universe))
    return F.when(weight <= 0, 0.0).when(predicate == "contradicts", -reliability * weight * K.CONTRADICTION_LLR).otherwise(support)


def canonical_group(group: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(normalise(group, True, ascii_only=ascii_only), r"\|[0-9]{1,3}$", "")


def classify_group(label: Column, collector: Column, declared: Column | None = None) -> Column:
    """A declared known class, else the first pattern found in the label or the collector."""
    out = F.lit(None).cast("string")
    if declared is not None:
        out = F.when(declared.isin(*K.DISCOUNTS), declared)
    chain = None
    for name, pattern in K.DEPENDENCE_PATTERNS:
        hit = label.rlike(f"(?iu){pattern}") | collector.rlike(f"(?iu){pattern}")
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.coalesce(out, chain.otherwise("unknown"))


def definitional(predicate: Column, reliability: Column, weight: Column, collector: Column) -> Column:
    trusted = F.lower(F.trim(collector)).isin(*K.DEFINITIONAL_COLLECTORS)
    return (predicate == "same_as") & (reliability == 1.0) & (weight > 0) & trusted


def probability(log_odds: Column) -> Column:
    return F.when(log_odds <= -700, 0.0).otherwise(1.0 / (1.0 + F.exp(-log_odds)))


def raw_band(p: Column) -> Column:
    out = None
    for least, name in K.BANDS:
        out = F.when(p >= least, name) if out is None else out.when(p >= least, name)
    return out.otherwise(K.LOWEST_BAND)


def band(p: Column, independent: Column, is_definitional: Column) -> Column:
    """With fewer than two independent lines the band is WEAK at best."""
    raw = raw_band(p)
    weaker = F.when(raw == K.LOWEST_BAND, raw).otherwise(F.lit("WEAK"))
    return F.when(is_definitional, raw).when(independent < K.MIN_INDEPENDENT_GROUPS, weaker).otherwise(raw)


# What a band says in words.
ESTIMATIVE = {
    "STRONG_EVIDENCE": "strongly supported by the evidence", "MODERATE_EVIDENCE": "moderately supported by the evidence", "LIMITED_EVIDENCE": "weakly supported by the evidence",
    "WEAK": "insufficiently supported", "UNSUPPORTED": "contradicted or unsupported",
}


def estimative(band_column: Column) -> Column:
    return lookup(ESTIMATIVE, band_column)


def correct_for_prevalence(p: Column, sample: Column, target: Column) -> Column:
    """Odds shifted from the sample's prevalence to the target's; as it is where either is 0 or 1."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = q / (1 - q) * (target / (1 - target)) / (sample / (1 - sample))
    usable = (sample > 0) & (sample < 1) & (target > 0) & (target < 1)
    return F.when(usable, odds / (1 + odds)).otherwise(p)


def absence_llr(source: Column, kind: Column) -> Column:
    """Log-likelihood ratio of not finding: ``kind`` is not_checked, checked_absent or expected_absent."""
    cover = lookup({k: c for k, (c, _) in K.COVERAGE.items()}, source, 0.0)
    least = F.ln(F.greatest(1 - cover, F.lit(K.ABSENCE_LEAST))) * F.when(kind == "expected_absent", K.ABSENCE_EXPECTED_FACTOR).otherwise(1.0)
    return F.when((kind == "not_checked") | (cover == 0), 0.0).otherwise(F.greatest(least, F.lit(K.ABSENCE_FLOOR)))


def absence_strength(source: Column) -> Column:
    cover = lookup({k: c for k, (c, _) in K.COVERAGE.items()}, source, 0.0)
    return F.when(cover >= 0.95, "strong").when(cover >= 0.80, "moderate").otherwise("weak")


PRIOR_LOG_ODDS = math.log(K.PRIOR_ODDS)
#: Below the log-odds of every band but the lowest, by more than rounding.
WEAK_LOG_ODDS = math.log(K.BANDS[-1][0] / (1 - K.BANDS[-1][0])) - 1e-6
