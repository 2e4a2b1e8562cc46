"""Language identification by nearest clustered centroid.

A text becomes a vector of hashed letter n-grams (one to four, within words and
with word ends), sublinear counts times inverse document frequency, of length one.
Each language has several centroids from spherical k-means; a text takes the
language of the centroid with the largest cosine. A text farther from every
centroid than nearly all training texts are from their own is *rejected*: its cosine is below
``slack`` (a half) times what all but one in a thousand training texts reach. The half keeps short clean texts,
whose few n-grams lie farther out; it also keeps languages that share most n-grams with a learned one.

The centroids are fitted on a sample of at most about ``per_lang`` texts a language
(twice that as a hard bound). Every text is predicted, and whole.

Edge cases: null text and texts without letters get ``und``, score 0 and are
rejected. A text with letters always gets a learned language; where it is rejected
the flag says so. With no training rows every text gets ``und``. Ties go to the
language that sorts first. Identifiers and carried columns may be of any type and name; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenor.llm.common import bounded_sample, tidy
from provenor.llm.letters import FACTORS, letters

ORDER, BITS = 4, 12
DIM = 1 << BITS
UNDETERMINED = "und"
SHARPNESS = 25.0


def counts(text: str | None) -> np.ndarray | None:
    """The n-gram counts of a whole text; None if it has no letter."""
    s = letters(text).astype(np.uint64)
    if len(s) < 2:
        return None
    inner, h, out = s != 1, s * FACTORS[0], np.zeros(DIM, np.int64)
    for n in range(1, ORDER + 1):
        if n > 1:
            # one symbol more in front; a word's end stands first or last, never between
            h = h[1:] + s[: len(s) - n + 1] * FACTORS[n - 1]
        between = np.ones(len(h), bool) if n == 2 else inner[:] if n == 1 else inner[1 : len(s) - n + 2].copy()
        for k in range(2, n - 1):
            between &= inner[k : len(s) - n + 1 + k]
        found = h if between.all() else h[between]
        out += np.bincount(((found ^ (found >> np.uint64(32))) * FACTORS[7] >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
    return out.astype(np.float32)


def _clusters(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    for _ in range(1, min(k, len(x))):
        far = 1 - (x @ np.stack(c).T).max(1)
        c.append(x[int(np.argmax(far * rng.random(len(x))))])
    c = np.stack(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own := x[near == j]).size:
                m = own.sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


class CentroidModel:
    """Inverse document frequencies, centroids (rows), each row's language, and the least cosine a language accepts.

    ``tf``: rows of counts in 16 bits, the one large array on the driver; they are made unit vectors in place.
    """

    def __init__(self, tf: np.ndarray, langs: list[str], clusters: int = 4, rounds: int = 12, seed: int = 5, slack: float = 0.5):
        self.langs = sorted(set(langs))
        here = np.zeros(DIM, np.int64)
        for i in range(0, len(tf), 256):
            here += (tf[i : i + 256] > 0).sum(0)
        self.idf = np.log((1 + len(tf)) / (1 + here)).astype(np.float32) + 1 if len(tf) else np.ones(DIM, np.float32)
        for i in range(0, len(tf), 256):
            tf[i : i + 256] = self._unit(tf[i : i + 256].astype(np.float32))
        y = np.searchsorted(self.langs, langs) if langs else np.zeros(0, int)
        rows, owner, least = [], [], []
        for i in range(len(self.langs)):
            x = tf[y == i].astype(np.float32)
            c = _clusters(x, clusters, rounds, seed)
            rows.append(c)
            owner += [i] * len(c)
            least.append(slack * float(np.quantile((x @ c.T).max(1), 0.001)))
        self.centroids = np.concatenate(rows) if rows else np.zeros((0, DIM), np.float32)
        self.owner, self.least = np.array(owner, int), np.array(least)

    def _unit(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and whether rejected, of rows of counts."""
        cos = self._unit(tf) @ self.centroids.T
        best = np.stack([cos[:, self.owner == i].max(1) for i in range(len(self.langs))], 1)
        near = best.argmax(1)
        top = best[np.arange(len(best)), near]
        share = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(1)
        return near, share, top < self.least[near]


def fit(docs: DataFrame, train: Column, per_lang: int = 1000, clusters: int = 4, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CentroidModel:
    rows = docs.where(train & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = bounded_sample(rows.where(F.col("text").rlike(r"\p{L}")), "lang", per_lang, seed)

    def features(batches):
        for b in batches:
            got = [counts(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"place": b.column("place"), "lang": b.column("lang"), "tf": pa.array([np.minimum(g, 60000).astype(np.float16).tobytes() if g is not None else None for g in got], pa.binary())})

    got = rows.mapInArrow(tidy(features), "place long, lang string, tf binary").where("tf is not null").toArrow()
    order = np.argsort(got.column("place").to_numpy())
    tf = np.empty((len(order), DIM), np.float16)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    for i, v in zip(at, got.column("tf"), strict=True):
        tf[i] = np.frombuffer(v.as_buffer(), np.float16)
    langs = got.column("lang").take(pa.array(order)).to_pylist()
    del got
    return CentroidModel(tf, langs, clusters, seed=seed)


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, rows: int = 256, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``carry`` (default: the id as doc_id) and what was found, as ``names``; one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(carry or [docs[id_col].alias("doc_id")]))
    inner = [f"c{i}" for i in range(len(kept.columns))]
    given = docs.select(docs[text_col].cast("string").alias("text"), *[c.alias(n) for c, n in zip(carry or [docs[id_col]], inner, strict=True)])

    def predict(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = [counts(t) for t in part.column("text").to_pylist()]
                lang, score, rejected = [UNDETERMINED] * len(got), np.zeros(len(got)), np.ones(len(got), bool)
                some = [i for i, g in enumerate(got) if g is not None] if model.langs else []
                if some:
                    near, s, r = model.predict(np.stack([got[i] for i in some]))
                    score[some], rejected[some] = s, r
                    for i, n in zip(some, near, strict=True):
                        lang[i] = model.langs[n]
                yield pa.record_batch([part.column(n) for n in inner] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*inner, "lang", "score", "rejected"])

    schema = T.StructType([f for f in given.schema.fields if f.name != "text"] + T.DataType.fromDDL("lang string, score double, rejected boolean").fields)
    return given.mapInArrow(tidy(predict), schema).toDF(*kept.columns, *names)
