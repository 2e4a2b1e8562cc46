import hashlib
from collections import Counter

from pyspark.sql import functions as F

from provenor.llm import exact_dedup

ROWS = [(5, "a"), (3, "a"), (9, "b"), (None, "a"), (None, "c"), (7, None), (8, ""), (9, "b"), (1, "x" * 100_000), (2, "x" * 100_000), (4, "a ")]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "keep_id", "size", "Lost_Id", "word", "best")})


def expected(keep):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        for i in ids:
            out[i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_groups(spark):
    for name, keep, rows in (("largest", max, 1), ("smallest", min, 4096), ("smallest", min, 2)):
        got = exact_dedup.exact_dedup(table(spark).coalesce(2), keep=name, memtable_rows=rows, fanout=2).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == expected(keep)
        kept = Counter(r.digest for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in ROWS})


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    weak = lambda text: F.lpad(F.hex(F.length(text) % 2), 64, "0")
    got = exact_dedup.exact_dedup(table(spark), digest=weak).collect()
    want = Counter((i, best, n) for (i, best, n, _), times in expected(max).items() for _ in range(times))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def test_survivors_keep_their_columns(spark):
    docs = table(spark)
    got = exact_dedup.drop_exact_copies(docs, memtable_rows=2)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter([(5, "a"), (9, "b"), (None, "c"), (8, ""), (2, "x" * 100_000), (4, "a ")])


def test_index_probe_and_compaction(spark):
    index = exact_dedup.LsmDigestIndex(keep="smallest", fanout=2)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    for part in (range(0, 20), range(10, 30), range(25, 40)):
        index.flush(spark.createDataFrame([(digests[i], 100 + i, 1) for i in part], "digest string, keep_id long, size long"))
    assert [len(level) for level in index.levels] == [1, 1]
    got = {r.digest: (r.keep_id, r.size) for r in index.probe(spark.createDataFrame([(d,) for d in digests[15:]], "digest string")).collect()}
    assert got == {digests[i]: (100 + i, (10 <= i < 20) + 1 + (25 <= i < 30) if i < 30 else 1) for i in range(15, 40)}
    assert exact_dedup.LsmDigestIndex().probe(spark.createDataFrame([(digests[0],)], "digest string")).collect() == []


def test_many_hits_are_not_broadcast(spark, monkeypatch):
    small = exact_dedup.if_small
    monkeypatch.setattr(exact_dedup, "if_small", lambda t: small(t, -1))
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 4}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    size = Counter(t for _, t in rows)
    best = {t: max(str(i) for i, u in rows if u == t) for t in ("hot", "t0", "t7", "t749")}
    text = {str(i): t for i, t in rows}
    assert len(got) == 3000 and all(r.group_size == size[text[r.doc_id]] for r in got)
    assert all(r.keep_id == best[text[r.doc_id]] for r in got if text[r.doc_id] in best)
    assert sum(r.kept for r in got) == len(size) == exact_dedup.drop_exact_copies(docs).count()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).collect() == [] and exact_dedup.drop_exact_copies(empty).collect() == []
