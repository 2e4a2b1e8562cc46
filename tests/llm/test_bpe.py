import base64
import random

import public_tokenizers as P
import tiktoken

from provenor.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = ["a", "be", "é", "'ll", " ", "  ", "\n", "\t", "12", "!?", "日本", " ", "<|endoftext|>", "x" * 90, " " * 70]
    return [None, "", " ", "\n\n ", "hello world"] + ["".join(rng.choice(alphabet) for _ in range(n)) for n in (5, 50, 400, 900)] + ["z" * 700, " " * 700, "ab " + "\n" * 300 + "x"]


def test_whole_and_chunked_texts_match_the_reference(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "\n\n "), (7, texts()[7]), (None, texts()[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", __import__("pyspark").sql.functions.lit("clash"))
    enc = reference()
    for size, overlap in ((40, 5), (64, 20), (65_536, 256)):
        got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, PATH, P.PATTERN, size, overlap).collect()), key=str)
        want = sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
        assert got == want


def test_long_repeats_and_copies(spark):
    text = "ab cd " * 300
    rows = [(1, text)] * 5 + [(2, text), (3, "x" + text)]
    enc = reference()
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, 40, 5).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, enc.encode_ordinary(t)) for i, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, P.PATTERN, digests=True).collect() == []
