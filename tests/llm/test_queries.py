"""The registered queries over a small written table, against plain code.

The table has nulls, empty texts, repeats, a long text, and columns whose names the operators use themselves.
"""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenor.llm import langid, lm, packing, quality, queries, simhash, toxicity
from provenor.llm.common import fold
from tests.llm.test_simhash import roots
from tests.llm.test_substring_dedup import brute

CLASHES = ("k", "id", "state", "z", "digest", "score", "place", "text_", "rejected", "lang_pred", "held_out", "word", "node", "kept", "size", "piece", "length", "c0", "fp", "vector", "__text")


def texts():
    rng = random.Random(12)
    parts = {"aa": ["bra", "kto", "mni", "plo"], "bb": ["shu", "wel", "yop", "gan"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 60))]
        if i % 5 == 0:
            words.insert(3, "zvugzvug" + rng.choice(parts[lang]))
        rows.append((i, " ".join(words) + rng.choice(["", "!", ".\n" + words[0]]), lang))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(8)]
    rows += [(300 + i, rows[i][1] + " " + rows[i + 1][1], None) for i in range(20)]
    return rows + [(400, None, "aa"), (401, "", None), (402, " \t\n", "bb"), (403, "12 34 !?", None), (404, rows[2][1] * 300, "aa"), (405, "日本語 é ß", None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(i % 7 != 0), int(i % 5 == 0 and i < 150)) for i, _, _ in texts() if i % 11]
    spark.createDataFrame([(*m, "clash") for m in marks], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return folder


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def rows_of(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == len(texts())
    return {r.doc_id: r for r in got}


def test_byte_bpe(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(spark, sf, "op1_byte_bpe")
    for i, t, _ in texts():
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_quality(spark, sf):
    got = rows_of(spark, sf, "op2_quality")
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = marks.select("doc_id", grade.alias("grade"))
    model = quality.fit(docs, ratings, fold(ratings["doc_id"], 3) != 1, grades=3)
    assert model.thresholds[0] < model.thresholds[1]
    memo = quality.Memo(quality.token_features)
    for i, t, _ in texts():
        at, value = quality.features(t, memo)
        z = float(model.weights[at.astype(int)] @ value.astype(float))
        tails = [1 - 1 / (1 + math.exp(-(c - z))) for c in model.thresholds]
        assert got[i].held_out == (crc(i, 3) == 1)
        assert (got[i].expected_grade, got[i].tail_prob) == pytest.approx((sum(tails), tails[0]), abs=1e-5)


def test_substring(spark, sf):
    got = queries.QUERIES["op3_substring_dedup"](spark, sf).collect()
    want = brute([(i, t) for i, t, _ in texts()], 20)
    assert sum(g for _, _, g, _ in want) > 500
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want)


def test_toxicity(spark, sf):
    got = rows_of(spark, sf, "op4_toxicity")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if crc(r.doc_id, 3) != 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    later = {i for i in marks if signed(xxhash.xxh64_intdigest(struct.pack("<i", 5), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))) % 3 == 0}
    known = {i: t for i, t, _ in texts()}
    counts = {}
    for i in sorted(set(marks) - later):
        for w in toxicity.words_of(known[i]):
            pair = counts.setdefault(w, [0, 0])
            pair[int(marks[i] > 0)] += 1
    model = toxicity.ClassModels({w: tuple(p) for w, p in sorted(counts.items())})

    def features(t):
        words = toxicity.words_of(t)
        if not words:
            return [0.0] * 4
        e = [sum(model.ratio(f" {w} "[max(0, k - 5) : k]) for k in range(2, len(w) + 3)) for w in words]
        n = [len(w) + 1 for w in words]
        out = [sum(e) / sum(n)]
        for width in (1, 4, 16):
            k = min(width, len(words))
            out.append(max(sum(e[j : j + k]) / max(sum(n[j : j + k]), 4 * k) for j in range(len(words) - k + 1)))
        return out

    x = np.array([features(known[i]) for i in later])
    y = np.array([float(marks[i] > 0) for i in later])
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    w = toxicity.logistic((x - shift) / scale, y)
    for i, t, _ in texts():
        score = 1 / (1 + math.exp(-float(np.clip((np.array(features(t)) - shift) / scale @ w[:-1] + w[-1], -40, 40))))
        assert got[i].score == pytest.approx(score, abs=2e-3) and got[i].held_out == (crc(i, 3) == 1)
        assert got[i].predicted == (got[i].score >= 0.7)


def test_language(spark, sf):
    got = rows_of(spark, sf, "op5_language")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, fold(docs["doc_id"], 4) != 2)
    assert model.langs == ["aa", "bb"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=2e-3)
    for i, t, _ in texts():
        n = langid.counts(t)
        assert got[i].held_out == (crc(i, 4) == 2)
        if n is None:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        v = [math.log1p(a) * b for a, b in zip(n.tolist(), model.idf.tolist(), strict=True)]
        long = math.sqrt(sum(a * a for a in v))
        best = {}
        for c, owner in zip(model.centroids.tolist(), model.owner.tolist(), strict=True):
            cos = sum(a * b for a, b in zip(v, c, strict=True) if a) / long
            best[owner] = max(best.get(owner, -1.0), cos)
        top = max(best, key=best.get)
        assert got[i].lang_pred == model.langs[top] and got[i].rejected == (best[top] < model.least[top])
        assert got[i].score == pytest.approx(1 / sum(math.exp(25 * (c - best[top])) for c in best.values()), abs=1e-3)
    assert all(got[i].lang_pred == lang for i, t, lang in texts()[:150])


def test_packing(spark, sf):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text, _ in texts():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want[i, n, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    got = queries.QUERIES["op7_packing"](spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and max(w[1] for w in want) > 0
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    # best-fit decreasing, one document at a time
    open_bins = []
    for n in sorted((w[3] for w in want), reverse=True):
        fit = min((b for b in range(len(open_bins)) if open_bins[b] >= n), key=lambda b: open_bins[b], default=None)
        if fit is None:
            open_bins.append(4096 - n)
        else:
            open_bins[fit] -= n
    assert max(room.values()) <= 4096 and len(room) == len(open_bins)


def test_packed_sequences_can_be_laid_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = packing.pack(docs, P.path("word_bpe_49k.json"), 512, 1, ids=True).collect()
    assert got and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    laid = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        laid.setdefault(r.sequence_id, []).extend(r.ids)
    assert sum(map(len, laid.values())) == sum(r.length for r in got) and max(map(len, laid.values())) <= 512


def test_exact_dedup(spark, sf):
    got = rows_of(spark, sf, "op8_exact_dedup")
    groups = {}
    for i, t, _ in texts():
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_simhash(spark, sf):
    got = rows_of(spark, sf, "op9_simhash")

    def plain(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: plain(t) for i, t, _ in texts()}
    label = roots(sorted(set(fp.values())), 2)
    first = {}
    for i in sorted(fp):
        first.setdefault(label[fp[i]], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{x:016x}", first[label[x]]) for i, x in fp.items()}
    assert {simhash.fingerprint((t or "").encode(), 3) for _, t, _ in texts()} == set(fp.values())


def test_lm_scores(spark, sf):
    got = rows_of(spark, sf, "op10_lm_score")
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t, _ in texts()}
    train = [i for i in tokens if crc(i, 7) != 2]
    c = Counter(w for i in train for w in tokens[i])
    total, kinds = sum(c.values()), len(c)
    words = sorted((w for w in c if w), key=lambda w: (-c[w], w))[: lm.size_for(total) - 2]
    number = {b"": 0} | {w: n + 2 for n, w in enumerate(words)}
    size = len(words) + 2
    pairs = np.zeros((size, size))
    ids = {i: [number.get(w, 1) for w in ws] for i, ws in tokens.items()}
    for i in train:
        for a, b in zip([0, *ids[i]], ids[i], strict=False):
            pairs[a, b] += 1
    model = lm.LogBilinear.fit(lm.Pairs.of(pairs), 32, rounds=60)
    q, r, b = (x.astype(float) for x in (model.q, model.r, model.b))
    known = {}

    def log_p(h, w):
        if h not in known:
            s = r @ q[h] + b
            known[h] = s - s.max() - math.log(np.exp(s - s.max()).sum())
        return known[h][w] / math.log(10)

    other = total - sum(c[w] for w in number) + (kinds - len([w for w in number if c[w]])) + 1
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ws)
        score = sum(log_p(a, w) for a, w in zip([0, *ids[i]], ids[i], strict=False))
        score += sum(math.log10((c[w] + 1) / other) for w in ws if w not in number)
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (crc(i, 7) == 2, len(ws), sum(w in c for w in ws), total)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score, rel=2e-3, abs=1e-2)


def test_text_identifiers(spark, tmp_path):
    rows = [(f"d{i}", t, lang) for i, t, lang in texts()[:30]] + [("n", None, None)]
    spark.createDataFrame(rows, "doc_id string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"d{i}", i % 2, i % 3 % 2) for i in range(30)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in queries.QUERIES.items():
        got = query(spark, str(tmp_path)).select("doc_id").collect()
        assert {r.doc_id for r in got} == {i for i, _, _ in rows}, name
