import random

import pytest

from provenor.llm import near_dedup


def shingled(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def firsts(texts, least=0.8):
    """Brute force: the least identifier of each component of pairs with a similarity of ``least``."""
    sets = {i: shingled(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(12, 120))]
        for edits in (0, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy + [rng.choice(words)] * (edits % 2)))
    # one passage in many texts that share little else, and a large group of near copies
    passage = " ".join(rng.choice(words) for _ in range(25))
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 60))) for _ in range(40)]
    crowd = [rng.choice(words) for _ in range(90)]
    for i in range(40):
        copy = list(crowd)
        for at in rng.sample(range(90), rng.randint(1, 4)):
            copy[at] = f"x{i}"
        out.append(" ".join(copy))
    out += [None, "", " \t", "one two", "ONE two", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("small", "sample"), [(8, 8000), (2, 20)])
def test_matches_brute_force(spark, small, sample):
    texts = corpus()
    want = firsts(texts)
    assert 20 < len(set(want.values())) < len(texts) - 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.classes(docs, small=small, sample=sample).collect()
    assert {r.doc_id: r.first.doc_id for r in got} == want


def test_stage_keeps_one_of_each_class_by_similarity(spark):
    import corpus_pipeline

    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, node string")
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(firsts(texts).values()))


def test_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "A b c d e f"), (9, "q")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [4, 9]
    assert near_dedup.drop_near_copies(docs.limit(0)).collect() == []


def test_a_long_chain_of_near_copies_is_one_class(spark):
    # each text is similar to the one before and the one after it only
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(8 * i, 8 * i + 90))) for i in range(400)], "doc_id long, text string")
    assert {r.first.doc_id for r in near_dedup.classes(docs).collect()} == {0}


def test_a_large_group_yields_a_forest_with_every_link():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(150):
        mine = base.copy()
        at = rng.choice(60, rng.integers(2, 14), replace=False)
        mine[at] = rng.integers(0, 2**63, len(at))
        sets.append(np.unique(mine))
    sets.sort(key=len)
    m = np.array([len(x) << 32 for x in sets])
    root = np.arange(150) // 2
    pairs = [(i, j) for i in range(150) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]

    def parts(links):
        label = root.copy()
        for i, j in links:
            label[label == label[i]] = label[j]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    links = near_dedup.forest(near_dedup._all_pairs(m, 0.8), root, near_dedup.similar(sets, 0.8)).tolist()
    assert set(map(lambda x: (max(x), min(x)), links)) <= set(pairs) and len(links) < 75 < len(pairs)
    assert parts(links) == parts(pairs) and 1 < len(parts(pairs)) < 75


def test_pivots_discard_only_what_is_far():
    import numpy as np

    prints = np.random.default_rng(5).integers(0, 2**64, (40, near_dedup.LANES), np.uint64, endpoint=False)
    table = near_dedup.pivot_table(prints).astype(int)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2, dtype=int)
    assert (np.abs(table[:, None] - table[None]).max(2) <= apart).all() and (np.abs(table[:, None] - table[None]).max(2) > near_dedup.RADIUS).any()
