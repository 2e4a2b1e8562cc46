import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from provenor.llm import langid, quality, toxicity
from provenor.llm.common import fold
from provenor.llm.letters import FACTORS, HashTable, letters

ODD = [None, "", " \n", "123 !?", "日本語 テキスト", "x", "é" * 5000]


def language_rows():
    rng = random.Random(5)
    parts = {"aa": ["bra", "kto", "mni"], "bb": ["shu", "wel", "yop"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang) for i in range(120) for lang in [rng.choice(["aa", "bb"])]]
    return rows + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(3, rows[3][1], rows[3][2]), (None, rows[4][1], None)]


def test_letters():
    assert [chr(c - 1) if c > 1 else " " for c in letters("Ab1c, É\n")] == list(" ab c é ")
    assert letters(None).tolist() == [1] and letters("12").tolist() == [1]


def test_hash_table():
    keys = np.random.default_rng(1).integers(1, 2**64, 5000, np.uint64)
    table = HashTable(keys, np.arange(5000, dtype=np.float32))
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys ^ np.uint64(1 << 40), -1.0) == -1).all()
    assert np.isnan(HashTable(keys[:0], np.zeros(0, np.float32)).find(keys[:3])).all()


def test_ngram_counts():
    text = "ab abc é"
    want = np.zeros(langid.DIM)
    for w in ("ab", "abc", "é"):
        s = f" {w} "
        for n in range(1, langid.ORDER + 1):
            for i in range(len(s) - n + 1):
                if s[i : i + n].strip():
                    k = sum((1 if c == " " else ord(c) + 1) * int(FACTORS[j]) for j, c in enumerate(reversed(s[i : i + n]))) & (2**64 - 1)
                    want[((k ^ k >> 32) * int(FACTORS[7]) & (2**64 - 1)) >> 64 - langid.BITS] += 1
    got = langid.counts(text)
    assert got.sum() == want.sum() and (got == want).all()
    assert all(langid.counts(t) is None for t in (None, "", "123 !?"))


def test_language(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs, fold(docs["doc_id"], 4) != 2, per_lang=100)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and 0 <= by[i].score <= 1 and not by[i].rejected for i, _, lang in rows[:120])
    assert [by[1000 + i].lang_pred == "und" for i in range(len(ODD))] == [True] * 4 + [False] * 3
    assert all(by[1000 + i].rejected for i in range(4))
    none = langid.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs, none).collect()} == {("und", True)}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_kneser_ney_is_a_distribution_and_the_tables_are_the_model():
    words = {"abc": (5, 1), "abd": (2, 0), "bad": (0, 4), "é": (1, 1), "cab": (3, 3)}
    model = toxicity.ClassModels(words)
    alphabet = sorted({c for w in words for c in w} | {" "})
    for context in (" a", " ab", "b", " zz"):
        for c in (0, 1):
            total, kinds = model.context[c].get(context, (0, 0))
            if total:

                    def of(x):
                        return (max(model.full[c].get(context + x, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * model.shared((context + x)[1:])) / total

                    assert abs(sum(map(of, alphabet)) + (toxicity.ALPHABET - len(alphabet)) * of("?") - 1) < 1e-9
    text = "abc bad zab é baa"
    got, sizes = model.tables().words(text)
    for e, n, w in zip(got, sizes, toxicity.words_of(text), strict=True):
        s = f" {w} "
        assert n == len(w) + 1 and abs(e - sum(model.ratio(s[max(0, k - 5) : k]) for k in range(2, len(s) + 1))) < 1e-4


def toxic_rows():
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), "zvug" + rng.choice(plain))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, rng.choice([0, 1])))
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, rows[5][1]), (None, rows[6][1])], labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([(i, t, "x") for i, t, _ in labels], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, marks, fold(marks["doc_id"], 3) != 1)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks, F.lit(False))).collect()} == {0.0}


def test_quality(spark):
    rng = random.Random(4)
    rows, ratings = [], []
    for i in range(400):
        grade = rng.randrange(3)
        rows.append((i, " ".join(rng.choice(["good", "text", "with", "words"]) + ("!!" if rng.random() > 0.05 + grade * 0.4 else "") for _ in range(rng.randint(20, 60)))))
        ratings.append((i, grade, "x"))
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "good")], "doc_id long, text string").withColumn("grade", F.lit("clash"))
    marks = spark.createDataFrame(ratings, "doc_id long, grade int, text string")
    model = quality.fit(docs, marks, fold(marks["doc_id"], 3) != 1, grades=3)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score(docs, model, select_from=1).collect()
    assert len(got) == 408 and all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    by = {r.doc_id: r.expected_grade for r in got}
    held = [(g, by[i]) for i, g, _ in ratings if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(round(e) == g for g, e in held) > 0.85 * len(held)
    assert {r.tail_prob for r in quality.score(docs, quality.fit(docs, marks, F.lit(False), grades=3)).collect()} == {0.0}
    assert quality.score(docs.limit(0), model).collect() == []
