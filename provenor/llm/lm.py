"""Scoring texts with a log-bilinear language model.

Tokens are a text's words, ASCII-lower-cased, and one end. The model predicts each token
from the one before it (the end, at the start): score(w | h) = q_h . r_w + b_w, over the
``size - 2`` most frequent words, the end and one token for all other words, whose share is
divided by their counts plus one (words never seen count as one word more). Scores are
made a distribution by the sum over all tokens, a table from batched matrix products.
``size`` is by default about the square root of the training tokens, up to ``MOST``: every worker
holds the table, whose size is the square.

It is fitted by noise-contrastive estimation in numpy. What the objective needs of the
corpus are the counts of pairs of tokens; they are counted over all training texts
and are at most ``size`` squared numbers. With them the expectations over data and noise are
taken exactly, in matrix products, instead of by drawing.

Unigram counts are of all training tokens and stay a distributed table. Words frequent
enough to be among ``hot`` (at most so many, of at most 64 bytes) are sent to the workers;
a text's other words are looked up by a join.

Edge cases: null text counts as empty, one end token. Repeated rows and shared identifiers
are scored each. Without training texts every count is 0 and the model is uniform.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import materialise, tidy

#: The end as a row of the counts; no word is empty.
END = b""
END_ID, OTHER_ID = 0, 1
LEAST, MOST = 256, 4096


def size_for(total: int) -> int:
    """The next power of two above the square root of the training tokens, within bounds."""
    return min(max(LEAST, 1 << -(-max(total - 1, 0).bit_length() // 2)), MOST)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


class Ranks(dict):
    """Word to its place among the hot words; -1 for others."""

    def __missing__(self, _):
        return -1


class Vocabulary:
    """The hot words, most frequent first, and their counts; sums over all training tokens."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, kinds: int, size: int, end_count: int):
        self.words, self.counts, self.total, self.kinds, self.end_count = words, counts, total, kinds, end_count
        self.size = min(size, len(words) + 2)
        inside = int(counts[: self.size - 2].sum()) + end_count
        #: Tokens and kinds of tokens that the model calls "other".
        self.other_total, self.other_kinds = total - inside, kinds - (self.size - 2) - (end_count > 0)
        self.name = uuid.uuid4().hex


_RANKS: dict[str, Ranks] = {}


def ranks(v: Vocabulary) -> Ranks:
    if v.name not in _RANKS:
        _RANKS.clear()
        _RANKS[v.name] = Ranks(zip(v.words, range(len(v.words)), strict=True))
    return _RANKS[v.name]


def model_ids(place: np.ndarray, size: int) -> np.ndarray:
    """Model tokens of hot places: 2 and on for the most frequent, or the token for others."""
    return np.where((place >= 0) & (place < size - 2), place + 2, OTHER_ID)


def unigrams(train: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, c) over all rows of ``train`` (text as binary)."""

    def run(batches):
        held: Counter = Counter()

        def out():
            b = pa.record_batch({"word": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return b

        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(tokens(t))
                if len(held) > flush:
                    yield out()
        yield out()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, size: int | None, hot: int) -> Vocabulary:
    """``counts``: a written table (word, c)."""
    rank = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    sums = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).head()
    size = size or size_for(sums[0] or 0)
    words = counts.where((F.length("word") > 0) & (F.length("word") <= 64)).withColumn("r", rank)
    # a histogram over the logarithm of the count tells from where on the words are few enough
    least, n = None, 0
    for r, k in sorted(words.groupBy("r").agg(F.count("*")).collect(), reverse=True):
        if n + k > hot:
            break
        least, n = r, n + k
    table = words.where(F.col("r") >= F.lit(least)).select("word", "c").toArrow() if least is not None else None
    pairs = sorted(zip(table.column("word").to_pylist(), table.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0])) if table else []
    return Vocabulary([w for w, _ in pairs], np.array([c for _, c in pairs], np.int64), sums[0] or 0, sums[1] or 0, size, sums[2] or 0)


class Pairs:
    """Counts of (previous, next) model tokens; dense only a few rows at a time."""

    def __init__(self, size: int, at: np.ndarray, n: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.size, self.at, self.n = size, at[order].astype(np.int64), n[order].astype(float)

    @classmethod
    def of(cls, dense: np.ndarray) -> Pairs:
        at = np.flatnonzero(dense)
        return cls(len(dense), at, dense.ravel()[at])

    def rows(self, first: int, end: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.at, (first * self.size, end * self.size))
        out = np.zeros((end - first) * self.size, np.float32)
        out[self.at[lo:hi] - first * self.size] = self.n[lo:hi]
        return out.reshape(-1, self.size)

    def sums(self) -> tuple[np.ndarray, np.ndarray, float]:
        """How often each token precedes, follows, and all."""
        return np.bincount(self.at // self.size, self.n, self.size), np.bincount(self.at % self.size, self.n, self.size), float(self.n.sum())


def merged(at: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts n at places, added up by place."""
    where, of = np.unique(np.concatenate(at), return_inverse=True)
    return where, np.bincount(of, np.concatenate(n), len(where)).astype(np.int64)


def bigrams(train: DataFrame, v: Vocabulary, shared) -> Pairs:
    """The counts of (previous, next) model tokens over all rows of ``train``."""
    size = v.size

    def run(batches):
        v = shared.value
        find, held, n = ranks(v).__getitem__, [], 0
        at, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                place = np.fromiter(map(find, tokens(t)), np.int64)
                ids = model_ids(place, size)
                ids[-1] = END_ID
                held.append(np.concatenate([[END_ID], ids[:-1]]) * size + ids)
                n += len(ids)
                if n > 1_000_000:
                    at, total = merged([at, *held], [total, np.ones(n, np.int64)])
                    held, n = [], 0
        at, total = merged([at, *held], [total, np.ones(n, np.int64)])
        for i in range(0, len(at), 100_000):
            yield pa.record_batch({"pair": pa.array(at[i : i + 100_000].astype(np.int32)), "n": pa.array(total[i : i + 100_000])})

    got = train.mapInArrow(tidy(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return Pairs(size, got.column("pair").to_numpy(), got.column("n").to_numpy())


class LogBilinear:
    """Context vectors q, token vectors r, biases b."""

    def __init__(self, q: np.ndarray, r: np.ndarray, b: np.ndarray):
        self.q, self.r, self.b = q, r, b

    @classmethod
    def fit(cls, pairs: Pairs, dim: int = 32, noise: float = 25.0, rounds: int = 60, rate: float = 0.1, seed: int = 10, rows: int = 512) -> LogBilinear:
        """Adam on the exact noise-contrastive objective; noise is the smoothed unigram distribution."""
        size, (before, after, seen) = pairs.size, pairs.sums()
        total = max(seen, 1.0)
        unigram = ((after + 1) / (seen + size)).astype(np.float32)
        context = (before / total).astype(np.float32)
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 0.1, (size, dim)).astype(np.float32), rng.normal(0, 0.1, (size, dim)).astype(np.float32), np.log(unigram)]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        offset = np.log(noise * unigram)
        for t in range(1, rounds + 1):
            q, r, b = p
            g = [np.empty_like(q), np.zeros_like(r), np.zeros_like(b)]
            for i in range(0, size, rows):
                s = slice(i, i + rows)
                true = 1 / (1 + np.exp(np.clip(offset - b - q[s] @ r.T, -30, 30)))
                d = pairs.rows(i, min(i + rows, size)) / np.float32(total) * (1 - true) - noise * context[s, None] * unigram * true
                g[0][s] = d @ r
                g[1] += d.T @ q[s]
                g[2] += d.sum(0)
            step = rate * (1 - t / (rounds + 1))
            for k in range(3):
                # a row's scale is its context's or token's share of the corpus
                m[k] = 0.9 * m[k] - 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-12)
        return cls(*p)

    def table(self, rows: int = 512) -> np.ndarray:
        """log10 P(next | previous), normalised, for all pairs."""
        out = np.empty((len(self.q), len(self.r)), np.float32)
        for i in range(0, len(self.q), rows):
            s = self.q[i : i + rows] @ self.r.T + self.b
            top = s.max(1, keepdims=True)
            out[i : i + rows] = (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)
        return out


_TABLES: dict[str, np.ndarray] = {}


def _table(v: Vocabulary, model: LogBilinear) -> np.ndarray:
    if v.name not in _TABLES:
        _TABLES.clear()
        _TABLES[v.name] = model.table()
    return _TABLES[v.name]


def score(docs: DataFrame, train: Column, size: int | None = None, hot: int = 262_144, dim: int = 32, rounds: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``train`` says which rows are learnt from."""
    spark = docs.sparkSession
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learn = given.where("train").select("text")
    counts = materialise(unigrams(learn), "lm-counts")
    v = vocabulary(counts, size, hot)
    shared_v = spark.sparkContext.broadcast(v)
    model = LogBilinear.fit(bigrams(learn, v, shared_v), dim, rounds=rounds)
    shared = spark.sparkContext.broadcast(model)
    base, other = v.total + v.kinds + 1, v.other_total + v.other_kinds + 1

    def run(batches):
        v = shared_v.value
        find, table = ranks(v).__getitem__, _table(v, shared.value)
        logs, known = np.log10(np.concatenate([v.counts, [0]]) + 1.0), np.concatenate([np.ones(len(v.counts), np.int64), [0]])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b, rows = batch.slice(at, 512), []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    words = tokens(text)
                    place = np.fromiter(map(find, words), np.int64, len(words))
                    ids = model_ids(place, v.size)
                    ids[-1] = END_ID
                    place[-1] = -1
                    cold = Counter(words[i] for i in np.flatnonzero(place[:-1] < 0))
                    n_cold, n_other = sum(cold.values()), int((ids == OTHER_ID).sum())
                    hot_logs = logs[place]
                    own = float(hot_logs.sum()) + np.log10(v.end_count + 1.0)
                    model_score = float(table[np.concatenate([[END_ID], ids[:-1]]), ids].sum(dtype=float)) + float(hot_logs[ids == OTHER_ID].sum()) - n_other * np.log10(other)
                    key = xxhash.xxh3_128_hexdigest(repr(doc_id).encode() + b" " + (text or b"")) + ("n" if text is None else "t")
                    rows.append((key, len(words), int(known[place].sum()) + (v.end_count > 0), own - len(words) * np.log10(base), model_score, list(cold), list(cold.values())))
                key, n, k, own, s, cold, times = zip(*rows, strict=True)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id"), "key": pa.array(key), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64()), "base_score": pa.array(own, pa.float64()), "score": pa.array(s, pa.float64()),
                    "cold": pa.array(cold, pa.list_(pa.binary())), "times": pa.array(times, pa.list_(pa.int32())),
                })

    kind = given.schema["doc_id"].dataType.simpleString()
    rows = materialise(given.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key string, n_tokens long, n_known long, base_score double, score double, cold array<binary>, times array<int>"), "lm-rows")
    cold = rows.select("key", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("key", F.col("x.cold").alias("word"), F.col("x.times").alias("times"))
    found = cold.join(counts, "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("times").alias("known"))
    # repeated rows share a key: what the join found is divided among them
    once = rows.groupBy("doc_id", "key", "n_tokens", "n_known", "base_score", "score").agg(F.count("*").alias("m"))
    full = once.join(found, "key", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    logs = F.coalesce(F.col("logs") / F.col("m"), F.lit(0.0))
    return full.select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("known") / F.col("m")).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
