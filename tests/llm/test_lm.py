import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from provenor.llm import lm


def test_scores(spark):
    texts = ["the cat sat on The mat", "the dog sat", None, "", "new words here the", "the cat", " the\tcat "] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2 + [(None, "the dog \xa0x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    held = {4, 5, 11}
    train = ~F.coalesce(docs["doc_id"], F.lit(-1)).isin(list(held))
    for size, hot in ((4, 5), (2048, 262_144), (3, 0)):
        got = lm.score(docs, train, size=size, hot=hot, dim=4, rounds=5).collect()
        c = Counter(t for i, x in rows if i not in held for t in lm.tokens((x or "").encode()))
        n, v = sum(c.values()), len(c)
        want = Counter()
        for i, x in rows:
            t = lm.tokens((x or "").encode())
            want[i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 8)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_table_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    truth = rng.dirichlet(np.full(12, 0.3), 12)
    pairs = np.round(truth * 5000)
    table = lm.LogBilinear.fit(lm.Pairs.of(pairs), dim=12, rounds=300).table()
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-4)
    unigram = np.log10(pairs.sum(0) / pairs.sum())
    best = (pairs * np.log10(np.maximum(truth, 1e-12))).sum()
    assert (pairs * table).sum() > 0.9 * best + 0.1 * (pairs * unigram).sum()


def test_the_vocabulary_grows_with_the_corpus():
    assert [lm.size_for(n) for n in (0, 1, 65_536, 65_537, 4_000_000, 10**7, 10**9)] == [256, 256, 256, 512, 2048, 4096, 4096]
    dense = np.random.default_rng(1).integers(0, 3, (7, 7)).astype(float)
    pairs = lm.Pairs.of(dense)
    assert (pairs.rows(2, 5) == dense[2:5]).all() and all((a == b).all() for a, b in zip(pairs.sums(), (dense.sum(1), dense.sum(0), dense.sum()), strict=True))
    assert [x.tolist() for x in lm.merged([np.array([5, 2]), np.array([2])], [np.array([1, 4]), np.array([3])])] == [[2, 5], [7, 1]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(True), rounds=1).collect() == []
