import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from provenor.llm import substring_dedup


def brute(rows, window):
    """Straight from the definition; rows of one identifier and text are one document."""
    key = lambda i, t: (i is not None, i or 0, int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little", signed=True))
    texts = {key(i, t): (t or "").encode().split() for i, t in rows}
    seen, out = {}, {}
    for k in sorted(texts):
        for s in range(len(texts[k]) - window + 1):
            seen.setdefault(tuple(texts[k][s : s + window]), (k, s))
    for k, words in texts.items():
        gone = set()
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] != (k, s):
                gone |= set(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[k] = (len(words), len(gone), kept.decode())
    return [(i, *out[key(i, t)]) for i, t in rows]


def rows():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno")
    passages = [[word() for _ in range(rng.randint(5, 14))] for _ in range(5)]
    out = [(1, None), (2, ""), (3, " a\xa0b\t"), (4, "x " * 40), (5, "x " * 39 + "y")]
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 12))]
        out.append((10 + rng.randrange(80), " ".join(words)))
    return out + [(out[8][0], out[8][1])] * 2 + [(500, out[9][1]), (None, out[10][1]), (501, out[10][1].replace(" ", "\n "))]


def test_matches_the_definition(spark):
    given = rows()
    clash = {"digest": F.lit("clash"), "k": F.lit(1), "id": F.lit("i"), "state": F.lit(1), "z": F.lit(None).cast("binary"), "c0": F.array(F.lit(2.5)), "found": F.lit(True)}
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns(clash).repartition(3)
    for window, gram, block, share in ((6, 2, 500_000, None), (6, 3, 30, 1), (4, 4, 1, 5)):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs, window, gram, block, share).collect())
        want = brute(given, window)
        assert got == Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want)
        assert sum(g for _, _, g, _ in want) > 100
    new = substring_dedup.rewritten(docs, 6, 2, 40, 3)
    assert new.schema == docs.schema or new.dtypes == docs.dtypes
    assert {(r.digest, r.k, r.id, r.state, r.z, tuple(r.c0), r.found) for r in new.collect()} == {("clash", 1, "i", 1, None, (2.5,), True)}
    assert Counter((r.doc_id, r.text) for r in new.collect()) == Counter((i, t if not g else k) for (i, n, g, k), (_, t) in zip(brute(given, 6), given, strict=True))


def test_empty_table(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
