"""Text quality by ordinal cumulative-link regression.

A rating is one of the grades 0 to K-1. P(grade <= k) = sigmoid(theta_k - w.x): one
vector of hashed-text weights w is shared by all grades, the thresholds theta are
kept in order by construction. The expected grade ranks texts; the tail
probability P(grade >= k) selects them.

x are shares: of each hashed feature of a token (the word, its ends, its shape) among
all tokens of the text, and a few features of the whole text (how often its words and
lines repeat, its length). A token's features depend on the token alone, so scoring
adds up one remembered number a word.

The fit reads at most about ``per_grade`` rated texts of each grade (twice that as a
hard bound). Every text is scored, and whole.

Edge cases: null text counts as empty; empty texts have only the whole-text features.
Without ratings of two grades every expected grade is 0 and every tail probability
0. A text with two ratings counts for each. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import Memo, bounded_sample

DIM = 1 << 15
_CLASSES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0"))
#: Weight of a feature of the whole text among the shares.
WHOLE = 0.2


def _h(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % DIM


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as A, a, 0; other characters once a run."""
    s = token
    for pattern, to in _CLASSES:
        s = pattern.sub(to, s)
    return re.sub(r"(.)\1+", r"\1\1", s)[:12]


def token_features(token: str) -> bytes:
    return np.array([_h("w" + token.lower()), _h("s" + shape(token)), _h("e" + token[-3:].lower()), _h("b" + token[:3].lower())], "<u2").tobytes()


def whole_features(n: int, kinds: int, lines: int, line_kinds: int) -> list[int]:
    return [_h(f"#words{int(10 * kinds / max(n, 1))}"), _h(f"#lines{int(10 * line_kinds / max(lines, 1))}"), _h(f"#length{n.bit_length()}")]


def _parts(text: str | None) -> tuple[Counter, int, list[int]]:
    text = text or ""
    words = Counter(text.split())
    n = sum(words.values())
    lines = text.split("\n")
    return words, n, whole_features(n, len(words), len(lines), len(set(lines)))


def features(text: str | None, memo: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values."""
    words, n, whole = _parts(text)
    ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u2")
    share = np.repeat(np.fromiter(words.values(), float, len(words)) / max(n, 1), 4)
    dense = np.bincount(ids, share, DIM) if len(ids) else np.zeros(DIM)
    for i in whole:
        dense[i] += WHOLE
    at = np.flatnonzero(dense)
    return at.astype("<u2"), dense[at].astype("<f4")


class OrdinalModel:
    """Shared weights, ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._memo = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, k: int, rounds: int = 250, rate: float = 0.02, ridge: float = 1e-3) -> OrdinalModel:
        """Adam on the mean log-likelihood; thresholds are a start and positive steps."""
        if len(set(grades.tolist())) < 2:
            return cls(np.zeros(DIM), np.full(k - 1, np.inf))
        n = len(rows)
        flat, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(float)
        row = np.repeat(np.arange(n), [len(i) for i, _ in rows])
        # what fewer than three texts have tells nothing of the others
        often = np.bincount(flat, minlength=DIM)[flat] > 2
        value, row = value[often], row[often]
        used, flat = np.unique(flat[often], return_inverse=True)
        d = len(used)
        # frequent features weigh alike whatever their size, rare ones as their shares
        scale = np.sqrt(np.bincount(flat, value**2, d) / n) + 0.05
        value = value / scale[flat]
        share = np.clip(np.array([(grades <= j).mean() for j in range(k - 1)]), 1e-3, 1 - 1e-3)
        cut = np.log(share / (1 - share))
        p = np.concatenate([np.zeros(d), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        balance = n / (len(set(grades.tolist())) * np.bincount(grades, minlength=k)[grades])
        for t in range(1, rounds + 1):
            steps = np.exp(p[d + 1 :])
            theta = np.concatenate([[-np.inf], p[d] + np.concatenate([[0.0], steps.cumsum()]), [np.inf]])
            z = np.bincount(row, p[:d][flat] * value, n)
            hi, lo = _sigmoid(theta[grades + 1] - z), _sigmoid(theta[grades] - z)
            like = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / like * balance, lo * (1 - lo) / like * balance
            g_z = -(d_hi - d_lo)
            g_theta = np.bincount(grades, d_hi, k)[: k - 1] - np.bincount(grades, d_lo, k)[1:]
            tail = g_theta[::-1].cumsum()[::-1]
            g = -np.concatenate([np.bincount(flat, g_z[row] * value, d), tail[:1], tail[1:] * steps]) / n
            g[:d] += ridge * p[:d]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(DIM)
        weights[used] = p[:d] / scale
        return cls(weights, p[d] + np.concatenate([[0.0], np.exp(p[d + 1 :]).cumsum()]))

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each text."""
        if self._memo is None:
            self._memo = Memo(lambda t: float(self.weights[np.frombuffer(token_features(t), "<u2")].sum()), 400_000)
        memo, z = self._memo, []
        for text in texts:
            words, n, whole = _parts(text)
            z.append(sum(memo[w] * c for w, c in words.items()) / max(n, 1) + WHOLE * sum(self.weights[i] for i in whole))
        return 1 - _sigmoid(self.thresholds[None, :] - np.array(z)[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(docs: DataFrame, ratings: DataFrame, train: Column, grades: int, per_grade: int = 2000, seed: int = 2, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """``ratings``: doc_id, grade (0 to grades - 1); ``train``: which of them may be learnt from."""
    marked = ratings.where(train & ratings["grade"].isNotNull()).select(F.col("doc_id").alias("__id"), F.col("grade").cast("int").alias("grade"))
    marked = bounded_sample(marked, "grade", per_grade, seed).drop("place")
    texts = docs.select(docs[id_col].alias("__id2"), docs[text_col].alias("text")).join(F.broadcast(marked), F.col("__id2") == F.col("__id")).select("__id", "grade", "text")

    def run(batches):
        memo = Memo(token_features, 200_000)
        for b in batches:
            got = [features(t, memo) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"id": b.column("__id"), "grade": b.column("grade"), "i": pa.array([i.tobytes() for i, _ in got], pa.binary()), "v": pa.array([v.tobytes() for _, v in got], pa.binary())})

    got = texts.mapInArrow(run, f"id {texts.schema['__id'].dataType.simpleString()}, grade int, i binary, v binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("grade", "ascending"), ("i", "ascending")])
    rows = [(np.frombuffer(i, "<u2"), np.frombuffer(v, "<f4")) for i, v in zip(got.column("i").to_pylist(), got.column("v").to_pylist(), strict=True)]
    return OrdinalModel.fit(rows, np.array(got.column("grade").to_pylist(), int), grades)


def score(docs: DataFrame, model: OrdinalModel, select_from: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """doc_id, expected_grade, tail_prob (P(grade >= select_from)), selected (tail_prob >= least)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                tails = model.tails(b.column("text").to_pylist())
                tail = tails[:, select_from - 1]
                yield pa.record_batch({"doc_id": b.column("doc_id"), "expected_grade": pa.array(tails.sum(1)), "tail_prob": pa.array(tail), "selected": pa.array(tail >= least)})

    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_prob double, selected boolean")
