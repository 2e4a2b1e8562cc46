"""How well scores hold against labels, and recalibration.

Labelled pairs have a, b, label (boolean), predicted, log_odds, band, label_source, case_ref.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import scoring as S


def _hit() -> Column:
    return F.col("label").cast("double")


def prevalence(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(_hit()), F.lit(0.0)).alias("prevalence"), F.count("*").alias("n"))


def bin_of(p: Column, bins: int) -> Column:
    """The bin's number; the last holds 1, none holds what is outside 0 to 1. Edges are i / bins."""
    out = None
    for i in range(bins):
        inside = (p >= i / bins) & ((p < (i + 1) / bins) if i < bins - 1 else (p <= 1.0))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def reliability_diagram(pairs: DataFrame, bins: int = 10) -> DataFrame:
    by = pairs.withColumn("bin", bin_of(F.col("predicted"), bins)).where("bin is not null").groupBy("bin")
    return by.agg(F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg(_hit()).alias("observed"))


def calibration_error(diagram: DataFrame) -> DataFrame:
    gap = F.abs(F.col("observed") - F.col("mean_predicted"))
    return diagram.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """score, reliability, resolution, uncertainty: one pass by bin, one over the bins."""
    squared = (F.col("predicted") - _hit()) ** 2
    by = pairs.withColumn("bin", bin_of(F.col("predicted"), bins)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("predicted").alias("p"), F.avg(_hit()).alias("o"), F.sum(squared).alias("loss"), F.sum(_hit()).alias("hits"))
    total = by.agg(F.sum("n").alias("total"), (F.sum("hits") / F.sum("n")).alias("base"), (F.sum("loss") / F.sum("n")).alias("score"))
    joined = by.where("bin is not null").crossJoin(F.broadcast(total))
    return joined.agg(
        F.first("score").alias("score"), F.sum(F.col("n") / F.col("total") * (F.col("p") - F.col("o")) ** 2).alias("reliability"),
        F.sum(F.col("n") / F.col("total") * (F.col("o") - F.col("base")) ** 2).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def band_performance(pairs: DataFrame, operational: float = 1e-5) -> DataFrame:
    """(band, n, true_positives, precision_sample, precision_operational, recall)."""
    name = F.coalesce(F.nullif(F.col("band"), F.lit("")), S.raw_band(F.col("predicted")))
    by = pairs.groupBy(name.alias("band")).agg(F.count("*").alias("n"), F.count_if("label").alias("true_positives"))
    total = pairs.agg(F.count_if("label").alias("hits"), F.avg(_hit()).alias("sample"))
    out = by.crossJoin(F.broadcast(total)).withColumn("precision_sample", F.col("true_positives") / F.col("n"))
    return out.select(
        "band", "n", "true_positives", "precision_sample",
        S.correct_for_prevalence(F.col("precision_sample"), F.col("sample"), F.lit(operational)).alias("precision_operational"),
        F.when(F.col("hits") > 0, F.col("true_positives") / F.col("hits")).otherwise(0.0).alias("recall"),
    )


@dataclass
class Platt:
    a: float = 1.0
    b: float = 0.0
    n_fit: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05) -> Platt:
        """Gradient steps from the identity; what they reach in so many, not the optimum."""
        if not len(x):
            return cls()
        scale = max(1.0, float(np.abs(x).max()))
        u, w = x / scale, np.array([1.0, 0.0])
        design = np.column_stack([u, np.ones_like(u)])
        for _ in range(steps):
            w = w - rate * design.T @ (1 / (1 + np.exp(-np.clip(design @ w, -30, 30))) - y) / len(u)
        return cls(float(w[0] / scale), float(w[1]), len(x))

    def column(self, log_odds: Column) -> Column:
        z = F.least(F.greatest(log_odds * self.a + self.b, F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-z))


@dataclass
class Isotonic:
    xs: list[float] = field(default_factory=list)
    ys: list[float] = field(default_factory=list)
    n_fit: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Isotonic:
        """Blocks of rising means; a block is known by its least x. Equal x are not pooled."""
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # x, sum, weight
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([a, b, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
                _, s, w = blocks.pop()
                blocks[-1][1] += s
                blocks[-1][2] += w
        return cls([b[0] for b in blocks], [b[1] / b[2] for b in blocks], len(x))

    def column(self, log_odds: Column) -> Column:
        """The value of the first block whose span to the next holds the score."""
        if not self.xs:
            return Platt().column(log_odds)
        knots = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in zip(self.xs, self.ys, strict=True)])
        below = F.filter(knots, lambda k: k["x"] < log_odds)
        left = F.try_element_at(below, F.lit(-1))["y"]
        return F.when(log_odds >= self.xs[-1], self.ys[-1]).otherwise(F.coalesce(left, F.lit(self.ys[0])))


def fit_platt(pairs: DataFrame) -> Platt:
    return Platt.fit(*_arrays(pairs))


def fit_isotonic(pairs: DataFrame) -> Isotonic:
    return Isotonic.fit(*_arrays(pairs))


def _arrays(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labelled pairs are judged by people: they are few. Only two numbers of each are brought together."""
    pdf: pd.DataFrame = pairs.select("log_odds", _hit().alias("y")).toPandas().sort_values(["log_odds", "y"], kind="stable")
    return pdf.log_odds.to_numpy(float), pdf.y.to_numpy(float)


def split_by_case(pairs: DataFrame, test_fraction: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by case, never by pair; a pair without a case is its own."""
    named = pairs.withColumn("__case", F.coalesce(F.nullif(F.col("case_ref"), F.lit("")), F.concat(F.lit("__"), "a", F.lit("|"), "b")))
    cases = sorted(r[0] for r in named.select("__case").distinct().collect())
    random.Random(seed).shuffle(cases)
    test = named.sparkSession.createDataFrame([(c,) for c in cases[: max(1, int(len(cases) * test_fraction))]], "__case string")
    return named.join(test, "__case", "left_anti").drop("__case"), named.join(test, "__case", "left_semi").drop("__case")


def report(pairs: DataFrame, operational: float = 1e-5, bins: int = 10) -> str:
    """A Markdown summary; every table it shows is small."""
    n = pairs.count()
    if not n:
        return "# Calibration\n\nNo labelled pairs."
    diagram = reliability_diagram(pairs, bins).orderBy("bin").collect()
    bands = {r.band: r for r in band_performance(pairs, operational).collect()}
    error, parts = calibration_error(reliability_diagram(pairs, bins)).head(), brier(pairs, bins).head()
    out = [
        "# Calibration", "", f"- Labelled pairs: {n}", f"- Sample prevalence: {prevalence(pairs).head()[0]:.1%}", f"- Operational prevalence: {operational:.1e}", "",
        "| Band | n | true | precision (sample) | precision (operational) | recall |", "|---|---:|---:|---:|---:|---:|",
        *[f"| {b} | {r.n} | {r.true_positives} | {r.precision_sample:.3f} | {r.precision_operational:.3f} | {r.recall:.3f} |" for b in (*[x for _, x in K.BANDS], K.LOWEST_BAND) if (r := bands.get(b))],
        "", f"- Expected calibration error: {error.ece:.4f}", f"- Maximum calibration error: {error.mce:.4f}", "",
        "| Predicted | n | mean | observed |", "|---|---:|---:|---:|",
        *[f"| {r.bin / bins:.1f} to {(r.bin + 1) / bins:.1f} | {r.n} | {r.mean_predicted:.3f} | {r.observed:.3f} |" for r in diagram],
        "", f"- Brier score {parts.score:.4f} = reliability {parts.reliability:.4f} - resolution {parts.resolution:.4f} + uncertainty {parts.uncertainty:.4f}, nearly",
    ]
    return "\n".join(out)
