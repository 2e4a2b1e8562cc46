import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from provenor.llm import fingerprint


def test_edits_and_successors(spark):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice("ab é日\n. ") for _ in range(rng.randint(0, 80)))) for i in range(200)] + [(7, None), (-5, ""), (8, "x\n" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("clash"), "head": F.lit("clash")})
    order = sorted((i, t or "") for i, t in rows)
    after = {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    got = fingerprint.edited_pairs(docs).collect()
    assert len(got) == len(rows)
    texts = dict(order)
    for r in got:
        text = texts[r.doc_id]
        q = len(text) // 4
        assert r.text == text and r.n_chars == len(text) and r.edited == text[: len(text) - q] + after[r.doc_id][:q]


def vector(text):
    """The sums, from the definition."""
    seeded = lambda seed, x: xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
    lines = [x for x in (text or "").split("\n") if x]
    pieces = [seeded(fingerprint.EXACT, p) for x in lines for p in re.split(r"(?<=[.!?,;|])[ \t\x0b\f\r]+", x) if p]
    exact = [sum(seeded(j, x) for x in lines) % 2**60 for j in range(fingerprint.EXACT)]
    like = [sum(h >> j & (1 | 1 << 20 | 1 << 40) for h in pieces) % 2**60 for j in range(fingerprint.LIKENESS)]
    return exact + like + [len(pieces)]


def likeness(a, b):
    if a == b:
        return 1.0
    signs = [[2 * (v[fingerprint.EXACT + i // 3] >> 20 * (i % 3) & (1 << 20) - 1) - v[-1] for i in range(fingerprint.LANES)] for v in (a, b)]
    both = sum(x * x for v in signs for x in v)
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(*signs, strict=True)) / both) if both else 0.0


def test_query_matches_plain_code(spark, tmp_path):
    from provenor.llm.queries import op6_fingerprint

    rng = random.Random(4)
    words = ["ab", "c.", "d, ", " e;", "é日", "f!  ", "\t", "g|\r"]
    rows = [(rng.randrange(10**6), "".join(rng.choice([*words, " ", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, rows[0][1]), (10**6 + 4, "\n".join(reversed(rows[0][1].split("\n")))), (-4, "a, b. " * 4000)]
    rows = list({i: (i, t) for i, t in rows}.values())
    spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, vector string, k double").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_fingerprint(spark, str(tmp_path)).collect()}
    texts = dict(sorted((i, t or "") for i, t in rows))
    order = list(texts)
    shown = lambda v: "".join(f"{x:015x}" for x in v)
    assert len(got) == len(rows)
    for n, i in enumerate(order):
        t, after = texts[i], texts[order[(n + 1) % len(order)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r, v = got[i], vector(t)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(v), shown(vector(edited)))
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(v, vector(edited)), likeness(v, vector(after))))
    assert got[10**6 + 3].fingerprint == got[10**6 + 4].fingerprint == got[rows[0][0]].fingerprint


def test_order_of_lines_does_not_matter(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = ["".join(rng.choice(["a.", "b, ", " ", "  c", "d! ", "\t"]) for _ in range(rng.randint(0, 5))) for _ in range(6)]
        rows.append((2 * i, "\n".join(lines)))
        rng.shuffle(lines)
        rows.append((2 * i + 1, "\n".join(lines)))
    fp = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(fp[2 * i] == fp[2 * i + 1] for i in range(60))


def test_repeated_rows_null_ids_and_one_document(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (2, "bbbb"), (2, "azzz"), (None, "cccc")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.edited) for r in fingerprint.edited_pairs(docs).collect()), key=str)
    assert got == sorted([(1, "aaaa"), (1, "aaaa"), (2, "bbbc"), (2, "azzc"), (None, "ccca")], key=str)
    assert [r.edited for r in fingerprint.edited_pairs(docs.where("text = 'bbbb'")).collect()] == ["bbbb"]
    assert fingerprint.edited_pairs(docs.limit(0)).collect() == []


def test_sums_ignore_order_and_can_be_edited(spark):
    rows = [(1, "one.\ntwo, three\nfour"), (2, "four\none.\ntwo, three"), (3, "one.\nfour"), (4, "two, three"), (5, ""), (6, None), (7, "\n"), (8, "one.\ntwo, threE\nfour")]
    df = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    fp = {r.doc_id: r for r in df.collect()}
    assert fp[1].fingerprint == fp[2].fingerprint != fp[8].fingerprint and len(fp[1].fingerprint) == 15 * 25
    assert set(fp[5].vector) == {0} == set(fp[6].vector) == set(fp[7].vector)
    pair = df.where("doc_id = 3").select(F.col("vector").alias("a")).crossJoin(df.where("doc_id = 4").select(F.col("vector").alias("b"))).crossJoin(df.where("doc_id = 1").select(F.col("vector").alias("c")))
    r = pair.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("less"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same"), fingerprint.likeness(F.col("a"), F.col("c")).alias("part"), "a", "c").head()
    assert list(r["sum"]) == list(r["c"]) and list(r["less"]) == list(r["a"]) and r["same"] == 1.0 and 0 <= r["part"] < 1


def test_hash_of_text_is_deterministic(spark):
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest()) for i in range(20)]
    df = spark.createDataFrame(rows + [(i + 100, t) for i, t in rows], "doc_id long, text string")
    fp = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert all(fp[i] == fp[i + 100] for i in range(20)) and len(set(fp.values())) == 20
