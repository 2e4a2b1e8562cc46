import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from provenor.llm import packing

PATH = P.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing in its plainest form: the sorted list of fillings of the sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return Counter(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for trial in range(60):
        capacity = rng.choice([1, 7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        rows = packing.plan(dict(Counter(lengths)), capacity)
        filled, numbers = defaultdict(list), defaultdict(list)
        for length, number, n, first, offset in rows.tolist():
            numbers[length] += range(number, number + n)
            for s in range(first, first + n):
                filled[s].append((offset, length))
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert Counter(capacity - sum(x for _, x in p) for p in filled.values()) == one_by_one(lengths, capacity)


def test_pack(spark):
    text = "Hello World's end, 12 <|endoftext|> übér x\x1fy İ 日本 é ."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "a b c " * 500), (None, " \n"), (5, "ΟΔΟΣ " * 15), (6, "x" * 3000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length long")
    got = packing.pack(docs, PATH, capacity=16).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for p, k in enumerate(range(0, len(ids), 16)):
            want[i, p, k, len(ids[k : k + 16]), zlib.crc32(np.array(ids[k : k + 16], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= 16
    assert Counter(16 - sum(n for _, n in p) for p in by.values()) == one_by_one([r.length for r in got], 16)


def test_words_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rng = random.Random(9)
    alphabet = list("abcdeinorstABC") + ["é", "É", "ß", "ÿ", "Þ", "÷", "×", "ñ", "'s", "'", "'ll", "12", "!?", ".", "e\u0301", "ﬁ", "Σ", "ς", "İ", "日", "\x1f", "\xa0", "~", "µ", "ª"]
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    text = " ".join(words)
    got = np.frombuffer(packing.encode(text, packing._words(PATH), b""), "<u4").tolist()
    assert got == t.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
