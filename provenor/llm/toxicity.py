"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled by two models of letters, one trained on toxic texts and one on
ordinary texts. The highest order of each is its own discounted counts; all lower
orders are continuation counts shared by both, so an expression that neither class
has seen often is judged alike by both and weighs little. A word's evidence is the
difference of its log-likelihoods; a text's are length-normalised differences: of
the whole text and of its strongest windows. A logistic fit on rows that the models
have not seen turns these into a score.

Counts come from at most about ``per_class`` labelled texts of each class (twice that
as a hard bound). Every text is scored, and whole.

Edge cases: null and empty texts, and texts without letters, score as no evidence
(the fit's intercept). Without labels of both classes every score is 0. A text with
two labels counts for each. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import bounded_sample
from provenor.llm.letters import FACTORS, HashTable, letters

#: Stands before and after each word.
EDGE = " "
ORDER, DISCOUNT = 5, 0.75
WINDOWS = (1, 4, 16)
#: A letter that the counts don't have gets this share of the uniform distribution.
ALPHABET = 300


class ClassModels:
    """Two letter models with shared backoff, from {word: (count in ordinary, count in toxic)}."""

    def __init__(self, words: dict[str, tuple[int, int]], order: int = ORDER):
        self.order = order
        full = [Counter(), Counter()]
        lower: set[str] = set()
        for w, pair in words.items():
            s = f"{EDGE}{w}{EDGE}"
            for end in range(2, len(s) + 1):
                gram = s[max(0, end - order) : end]
                for c in (0, 1):
                    if pair[c]:
                        full[c][gram] += pair[c]
                # types of the next lower order, seen with what precedes them
                lower.add(gram)
        self.full = [dict(f) for f in full]
        self.context = [self._totals(f) for f in self.full]
        # shared continuation counts: in how many longer contexts, of either class, a shorter gram occurs
        self.cont: dict[str, int] = {}
        level = lower
        while level:
            seen = Counter(g[1:] for g in level if len(g) > 1)
            for g, n in seen.items():
                self.cont[g] = self.cont.get(g, 0) + n
            level = {g for g in seen if len(g) > 1}
        self.cont_context = self._totals(self.cont)
        self._shared_memo: dict[str, float] = {}

    @staticmethod
    def _totals(grams: dict[str, int]) -> dict[str, tuple[int, int]]:
        out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for g, n in grams.items():
            t = out[g[:-1]]
            t[0] += n
            t[1] += 1
        return {k: (a, b) for k, (a, b) in out.items()}

    def shared(self, gram: str) -> float:
        """The shared probability of a gram's last letter after the others."""
        got = self._shared_memo.get(gram)
        if got is None:
            below = self.shared(gram[1:]) if len(gram) > 1 else 1 / ALPHABET
            total, kinds = self.cont_context.get(gram[:-1], (0, 0))
            got = below if not total else (max(self.cont.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * below) / total
            if len(self._shared_memo) > 500_000:
                self._shared_memo.clear()
            self._shared_memo[gram] = got
        return got

    def ratio(self, gram: str) -> float:
        """log P(a gram's last letter | the others, toxic) - log P(it | the others, ordinary)."""
        below, p = self.shared(gram[1:]), []
        for c in (0, 1):
            total, kinds = self.context[c].get(gram[:-1], (0, 0))
            p.append(below if not total else (max(self.full[c].get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * below) / total)
        return math.log(p[1] / p[0])

    def tables(self) -> Ratios:
        """All that the ratio can be: by gram where a class has seen it, else by context, else 0.

        A gram that no class has seen is backed off by both to the same shared probability;
        what remains is how much each class leaves to the backoff after that context.
        """
        grams = sorted(set(self.full[0]) | set(self.full[1]))
        contexts = sorted(set(self.context[0]) | set(self.context[1]))
        left = []
        for x in contexts:
            (t0, k0), (t1, k1) = (self.context[c].get(x, (0, 0)) for c in (0, 1))
            left.append(math.log((DISCOUNT * k1 / t1 if t1 else 1.0) / (DISCOUNT * k0 / t0 if t0 else 1.0)))
        return Ratios(self.order, HashTable(_keys(grams, 0), np.array([self.ratio(g) for g in grams], np.float32)), HashTable(_keys(contexts, 1), np.array(left, np.float32)))


def _keys(grams: list[str], last: int) -> np.ndarray:
    """Hashes of grams; ``last``: how far their last symbol is from the predicted one."""
    out = np.zeros(len(grams), np.uint64)
    for i, g in enumerate(grams):
        k = 0
        for j, ch in enumerate(reversed(g)):
            k += (1 if ch == EDGE else ord(ch) + 1) * int(FACTORS[j + last])
        out[i] = k & (2**64 - 1)
    return out


class Ratios:
    def __init__(self, order: int, grams: HashTable, contexts: HashTable):
        self.order, self.grams, self.contexts = order, grams, contexts

    def words(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The evidence and the number of predicted letters (with the end) of each word."""
        s = letters(text).astype(np.uint64)
        n = len(s) - 1
        if n < 1:
            return np.zeros(0), np.zeros(0)
        context, valid = s[:-1] * FACTORS[1], np.ones(n, bool)
        for j in range(2, min(self.order, n + 1)):
            # one symbol further back, unless the word begins in between
            valid[: j - 1] = False
            valid[j - 1 :] &= s[1 : n - j + 2] != 1
            context[j - 1 :] += np.where(valid[j - 1 :], s[: n - j + 1], 0) * FACTORS[j]
        got = self.grams.find(context + s[1:] * FACTORS[0])
        lost = np.flatnonzero(np.isnan(got))
        got[lost] = self.contexts.find(context[lost], 0.0)
        ends = np.flatnonzero(s[1:] == 1)
        total = np.concatenate([[0.0], got.cumsum(dtype=float)])[ends + 1]
        return np.diff(total, prepend=0.0), np.diff(ends, prepend=-1).astype(float)


def words_of(text: str | None) -> list[str]:
    return "".join(" " if x == 1 else chr(x - 1) for x in letters(text).tolist()).split(" ")[1:-1]


def features(text: str | None, ratios: Ratios) -> list[float]:
    """The text's length-normalised evidence: mean, and the strongest window of each width."""
    evidence, size = ratios.words(text)
    if not len(evidence):
        return [0.0] * (1 + len(WINDOWS))
    e, n = np.concatenate([[0.0], evidence.cumsum()]), np.concatenate([[0.0], size.cumsum()])
    out = [e[-1] / n[-1]]
    for w in WINDOWS:
        k = min(w, len(evidence))
        # windows of few letters are no surer than long ones: at least four letters a word count
        out.append(float(((e[k:] - e[:-k]) / np.maximum(n[k:] - n[:-k], 4 * k)).max()))
    return out


class ToxicityModel:
    def __init__(self, ratios: Ratios | None, weights: np.ndarray, shift: np.ndarray, scale: np.ndarray):
        self.ratios, self.weights, self.shift, self.scale = ratios, weights, shift, scale

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        x = np.array([features(t, self.ratios) for t in texts]).reshape(len(texts), -1)
        return squash((x - self.shift) / self.scale @ self.weights[:-1] + self.weights[-1])


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = squash(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + keep
        w = w + np.linalg.solve(h, x.T @ (y - p) - keep @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4000, seed: int = 4, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """``train``: a condition on ``labels``' doc_id that says which labelled rows may be learnt from."""
    marked = labels.where(train & labels["toxic"].isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    marked = bounded_sample(marked, "toxic", per_class, seed).drop("place")
    half = F.pmod(F.xxhash64(F.col("__id"), F.lit(seed + 1)), F.lit(3)) == 0
    texts = docs.select(docs[id_col].alias("__id2"), docs[text_col].alias("text")).join(F.broadcast(marked), F.col("__id2") == F.col("__id")).select(half.alias("later"), "toxic", "text")

    def count(batches):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for later, toxic, text in zip(*(b.column(n).to_pylist() for n in ("later", "toxic", "text")), strict=True):
                if not later:
                    found[int(toxic > 0)].update(words_of(text))
        for c, words in found.items():
            yield pa.record_batch({"toxic": pa.array([c] * len(words), pa.int32()), "word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    table = texts.mapInArrow(count, "toxic int, word string, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t")).toArrow().sort_by("word")
    words = dict(zip(table.column("word").to_pylist(), zip(table.column("o").to_pylist(), table.column("t").to_pylist(), strict=True), strict=True))
    ratios = ClassModels(words).tables()
    del words, table
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def look(batches):
        ratios = shared.value
        for b in batches:
            later = [(t, x) for z, t, x in zip(*(b.column(n).to_pylist() for n in ("later", "toxic", "text")), strict=True) if z]
            yield pa.record_batch({"toxic": pa.array([int(t > 0) for t, _ in later], pa.int32()), "x": pa.array([features(x, ratios) for _, x in later], pa.list_(pa.float64()))})

    got = texts.mapInArrow(look, "toxic int, x array<double>").toArrow()
    y = np.array(got.column("toxic").to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(None, np.zeros(0), np.zeros(0), np.ones(0))
    x = np.array(got.column("x").to_pylist())
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return ToxicityModel(ratios, logistic((x - shift) / scale, y), shift, scale)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                s = model.score(b.column("text").to_pylist())
                yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
