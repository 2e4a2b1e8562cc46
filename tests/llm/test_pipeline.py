import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from provenor.llm import simhash
from tests.llm.test_simhash import roots
from tests.llm.test_substring_dedup import brute


def corpus():
    rng = random.Random(7)
    parts = {"aa": ["bra", "kto", "mni", "plo", "ster"], "bb": ["shu", "wel", "yop", "gan", "dif"]}
    rows = []
    for i in range(80):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(words), lang, "s", 0))
    rows += [(100 + i, rows[i][1], rows[i][2], "t", 0) for i in range(10)]
    for i in range(20, 30):
        words = rows[i][1].split() * 6
        rows.append((200 + i, " ".join(words), rows[i][2], "u", 0))
        words[5] = "odd"
        rows.append((300 + i, " ".join(words), rows[i][2], "u", 0))
    rows += [(400, None, "aa", "v", 0), (401, "", "aa", "v", 0), (402, "12 34", "bb", "v", 0), (3, rows[3][1], "aa", "w", 0), (500, " ".join(rows[7][1].split()[:25]) + " " + rows[8][1], "aa", "v", 0)]
    return rows


def test_pipeline_matches_plain_steps(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # language: only what has no letters is far from both made-up languages
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in kept:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    kept = [(i, t) for t, i in best.items()]
    fp = {i: simhash.fingerprint(t.encode(), 5) for i, t in kept}
    label = roots(sorted(set(fp.values())), 6)
    first = {}
    for i, _ in sorted(kept):
        first.setdefault(label[fp[i]], i)
    kept = [(i, t) for i, t in kept if first[label[fp[i]]] == i]
    assert len(kept) < len(best)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for (i, _, gone, left), (_, text) in zip(brute(kept, 20), kept, strict=True):
        ids = [*t.encode(left if gone else text, add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
