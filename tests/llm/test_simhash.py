import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from provenor.llm import simhash


def plain(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, radius):
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= radius) for f in fps}
        if new == label:
            return label
        label = new


def near(seed, n, radius):
    """Fingerprints in balls, chains and alone."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            out.append(base)
            for _ in range(rng.randint(1, radius + 1)):
                base ^= 1 << rng.randrange(64)
    return sorted(set(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_is_near(spark):
    for radius, dense in ((2, 8192), (2, 3), (3, 8192), (6, 2)):
        fps = near(radius + dense, 150, radius)
        df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        got = {r.v: r.root for r in simhash.components(simhash.links(df, radius, dense)).collect()}
        want = roots(fps, radius)
        classes = {}
        for f in fps:
            classes.setdefault(want[f], set()).add(signed(f))
        assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(v for v in got if got[v] == r) for r in set(got.values())}


def test_classes(spark):
    texts = ["a b c d e f g", "A b c\td e f g", None, "", "x", "x y", " ", "a b c d e f g h"] + ["w%d " % (i % 7) * 30 for i in range(9)]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, "alone in the text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.classes(docs, 3, 2).collect()
    assert sorted((r.doc_id, r.fp % 2**64) for r in got if r.doc_id is not None) == sorted((i, plain(t, 3)) for i, t in rows if i is not None)
    label = roots(sorted({plain(t, 3) for _, t in rows}), 2)
    for r in got:
        ids = [i for i, t in rows if label[plain(t, 3)] == label[r.fp % 2**64] and i is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_one_of_each_class_stays(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "q r s"), (None, "a b c d e f"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, root string")
    got = simhash.drop_near_copies(docs, 5, 2)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [3, 7, 9]


def test_pivots_lose_no_pair():
    fps = np.array(near(11, 400, 2), np.uint64)
    got = simhash.linked(fps, 2, simhash.pivots())
    joined = {i: i for i in range(len(fps))}
    for a, b in got:
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2
        x, y = joined[a], joined[b]
        joined = {k: (min(x, y) if v in (x, y) else v) for k, v in joined.items()}
    want = roots([int(f) for f in fps], 2)
    assert len(set(joined.values())) == len(set(want.values()))


def least_reachable(edges):
    label = {v: v for e in edges for v in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components_of_any_shape(spark):
    rng = random.Random(2)
    order = rng.sample(range(3000), 600)
    shapes = [
        list(zip(order, order[1:], strict=False)),
        [(i + 1, i) for i in range(300)],
        [(900, i) for i in range(300)] + [(1000, i + 1001) for i in range(300)],
        [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        [(5, 5), (7, 6), (6, 7), (7, 7), (-(2**63), 2**63 - 1)],
    ]
    # told apart by their place, so that one run has them all
    edges = [(a + i * 10_000 if i < 4 else a, b + i * 10_000 if i < 4 else b) for i, shape in enumerate(shapes) for a, b in shape]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.v for r in got}) and {r.v: r.root for r in got} == least_reachable(edges)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_a_chain_write_rows_in_proportion_to_it(spark, monkeypatch):
    written, write = [], simhash.materialise

    def counted(df, name, *by):
        out = write(df, name, *by)
        written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    order = random.Random(3).sample(range(1000), 100)
    simhash.components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")).collect()
    assert sum(written) < 1000


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
