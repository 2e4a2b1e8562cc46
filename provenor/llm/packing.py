"""Best-fit-decreasing packing of token sequences.

Texts are encoded once, to pieces of at most ``capacity`` tokens. Best-fit decreasing
depends on the pieces' lengths alone, so it is planned on their histogram: lengths go
from the longest to the shortest; each piece goes to the open sequence with the least
room that still holds it, found in a segment tree over remaining capacities, or else
opens a new one. Pieces of one length are placed together: as many of them as the
tightest class holds, then the next class. The plan is that of packing all
pieces one by one, and its size depends on ``capacity`` only, not on the corpus.

The pieces of each length are numbered in two steps (counts by length and salt, then
places within each), so a length that a third of all rows share is spread out.

Edge cases: null text counts as empty; an empty text is one piece, the end token. Repeated
rows are packed each. A text of a multiple of ``capacity`` tokens has no empty piece.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.llm.common import Memo, materialise, tidy

SALTS = 256
#: A run of letters that is its own normal form but for case, and what follows it: the run is a pre-token.
RUN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)((?:[\x21-\x60\x7b-\x7e].*)?)", re.S)
END_OF_WORD = b"\xff"

_TOKENIZERS: dict[str, Memo] = {}


def _byte_letters() -> dict[str, int]:
    """The usual letters for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merger(path: str):
    """Ids of one pre-token's bytes by the file's merges, or None if the file is of another kind.

    The end of a word is written as a byte that no text has. Each letter merges with it
    first of all, as the file has it, and then in the file's order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    names = [c + "</w>" for c in letters] + list(letters) + [x + y for x, y in pairs]
    ranks: dict[bytes, int] = {}
    ids = []
    for name in names:
        word = name.endswith("</w>")
        raw = bytes(letters[c] for c in (name[:-4] if word else name)) + END_OF_WORD * word
        if raw not in ranks:
            ranks[raw] = len(ids)
            ids.append(vocab[name])
    import tiktoken

    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    table = [i.to_bytes(4, "little") for i in ids]
    return lambda raw: b"".join([table[r] for r in merge(raw + END_OF_WORD)])


def _words(path: str) -> Memo:
    """Token ids of a word, ASCII-lower-cased, as little-endian 32-bit bytes; remembered for each Python worker.

    The vocabulary's normaliser and pre-tokeniser drop white space and never look across
    it, so a text's ids are those of its words in order. A leading run of letters is a
    pre-token of its own and is merged directly; everything else goes through the tokenizer.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        merge = _merger(path)

        def ids(word: bytes) -> bytes:
            m = RUN.fullmatch(word) if merge else None
            if m is None:
                return np.array(t.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            run, rest = m.groups()
            if rest:
                return memo[run] + memo[rest]
            return merge(run if run.isascii() else run.decode().lower().encode())

        _TOKENIZERS[path] = memo = Memo(ids, 200_000)
    return _TOKENIZERS[path]


def encode(text: str | None, words: Memo, end: bytes) -> bytes:
    return b"".join(map(words.__getitem__, (text or "").encode().lower().split())) + end


class Tightest:
    """A segment tree over remaining capacities: which is the least that is open and at least so large."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = np.zeros(2 * self.size, bool)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def find(self, room: int) -> int | None:
        i = room + self.size
        if self.any[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, how many, first sequence, offset): pieces numbered from the
    first number on, of this length, go to as many sequences from the first one on, at the offset.
    """
    tree, rooms, out, opened = Tightest(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.find(length)
            # a sequence that has taken a piece is the tightest until it holds no more of them
            each = min((capacity if room is None else room) // length, left)
            if room is None:
                first, n = opened, left // each
                opened += n
            else:
                first, n = rooms[room].pop()
                if (k := min(n, left // each)) < n:
                    rooms[room].append((first + k, n - k))
                    n = k
                if not rooms[room]:
                    del rooms[room]
                    tree.set(room, False)
            filled = capacity if room is None else room
            for i in range(each):
                out.append((length, number, n, first, capacity - filled + i * length))
                number += n
            left -= n * each
            if rest := filled - each * length:
                rooms.setdefault(rest, []).append((first, n))
                tree.set(rest, True)
    return np.array(out, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with ``ids`` also the ids."""
    end = np.array([end_id], "<u4").tobytes()
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        words, step = _words(tokenizer_path), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, of = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    raw = encode(text, words, end)
                    for n, k in enumerate(range(0, len(raw), step)):
                        cut = raw[k : k + step]
                        rows.append((n, k // 4, len(cut) // 4, zlib.crc32(cut), cut if ids else None))
                        of.append(i)
                n, start, length, crc, raw = zip(*rows, strict=True)
                out = {"doc_id": part.column("doc_id").take(pa.array(of)), "piece": pa.array(n, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    out["ids"] = pa.array([np.frombuffer(r, "<i4") for r in raw], pa.list_(pa.int32()))
                yield pa.record_batch(out)
        words.clear()

    return given.mapInArrow(tidy(run), schema)


def place(table: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    spark = table.sparkSession
    salted = table.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "__salt", "__first")
    # at most ``capacity`` lengths
    rows = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    begin = {int(k): i for i, k in reversed(list(enumerate(rows[:, 0])))}
    ends = {int(k): i + 1 for i, k in enumerate(rows[:, 0])}
    shared = spark.sparkContext.broadcast((rows[:, 1:], begin, ends))
    own = W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("__n", F.row_number().over(own) - 1).join(starts, ["length", "__salt"]).withColumn("__n", F.col("__n") + F.col("__first")).drop("__first", "__salt").select(*table.columns, "__n")
    names = table.columns

    def run(batches):
        rows, begin, ends = shared.value
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("__n").to_numpy()
            at = np.empty(len(length), np.int64)
            for v in np.unique(length):
                own, (x, y) = length == v, (begin[int(v)], ends[int(v)])
                at[own] = x + np.searchsorted(rows[x:y, 0], number[own], "right") - 1
            got = rows[at] if len(at) else np.zeros((0, 4), np.int64)
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(got[:, 2] + number - got[:, 0]), pa.array(got[:, 3])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece; with ``ids`` also its token ids."""
    return place(materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, ids), "packing-pieces"), capacity)
