"""Byte-level BPE encoding and decoding of whole texts.

A text longer than a chunk is cut into overlapping chunks, which are rows of their own
and pre-tokenised wherever they land. Neighbours are stitched where their pre-token
boundaries resynchronise within the overlap: from a boundary that both have found, both
go on alike. Each overlap reaches past a change from a visible character to white
space; no match of the pattern spans such a change, so every tokenisation has a boundary there
and neighbours always meet. Each pre-token is encoded by itself; decoding
concatenates the tokens' bytes. Texts within a chunk are encoded where they are read and
never shuffled.

The pattern must split the text completely, and no match may hold a visible character
followed by white space.

Edge cases: null text counts as empty and has no tokens. Repeated rows and rows that share an
identifier are encoded each. Other columns are ignored; an empty table gives an
empty result. A long text without white space (as in scripts that write none) is one chunk.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import Memo, partitions

MEETING = regex.compile(r"\S(?=\s)")


class Codec:
    """The ranks of a vocabulary file and its pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str, memo: int = 150_000):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token_bytes[i] = b
        self.digits = [str(i) for i in range(len(self.token_bytes))]
        self.pattern = regex.compile(pattern)
        whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # surrogates can't stand in a column of UTF-8 strings, so a piece always has UTF-8 bytes
        self.pieces = Memo(lambda piece: tuple(whole._encode_single_piece(piece.encode())), memo)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    if (key := (ranks_path, pattern)) not in _CODECS:
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def cut(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start, end and meeting place of each chunk.

    The meeting place lies ``overlap`` characters at least beyond the next chunk's start; a
    chunk sees one character more. Boundaries up to it are sure. The last chunk's is its end.
    """
    out, start, n = [], 0, len(text)
    while True:
        nominal = start + size
        met = MEETING.search(text, nominal + overlap) if nominal + overlap < n else None
        if met is None:
            return [*out, (start, n, n)]
        out.append((start, met.end() + 1, met.end()))
        start = nominal


def spans(text: str, pattern) -> list[int]:
    """Where the matches start, and where the last ends."""
    at = [m.start() for m in pattern.finditer(text)]
    return [*at, len(text)]


def stitch(chunks: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """From (boundaries counted from the text's start, meeting place) of chunks in order, the
    range of boundaries that each one gives: from where it has met the chunk before it.
    """
    out, begin = [], chunks[0][0][0]
    for (mine, sure), (others, _) in zip(chunks, chunks[1:], strict=False):
        theirs = set(others)
        meet = next((b for b in mine if begin <= b <= sure and b in theirs), None)
        if meet is None:
            raise ValueError("chunks do not resynchronise: the pattern spans a change to white space")
        out.append((begin, meet))
        begin = meet
    out.append((begin, chunks[-1][0][-1]))
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 65_536, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary), a row for each input row.

    With ``digests`` their lengths and SHA-256 only: doc_id, n_tokens, ids_sha256 (of
    the decimal ids joined by a space), decoded_sha256.
    """
    given = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def batch(doc_ids, encoded, bpe):
        if not digests:
            return pa.record_batch({"doc_id": doc_ids, "ids": pa.array(encoded, pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(i) for i in encoded], pa.binary())})
        digits = bpe.digits
        return pa.record_batch({
            "doc_id": doc_ids, "n_tokens": pa.array([len(i) for i in encoded], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(" ".join(map(digits.__getitem__, i)).encode()).hexdigest() for i in encoded], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in encoded], pa.string()),
        })

    def whole(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield batch(part.column("doc_id"), [bpe.encode(t) for t in part.column("text").to_pylist()], bpe)

    def chunked(batches):
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                key, places = hashlib.sha256(text.encode()).hexdigest(), cut(text, chunk_chars, overlap)
                for i, (start, end, sure) in enumerate(places):
                    yield pa.record_batch({"doc_id": pa.array([doc_id], b.column("doc_id").type), "key": [key], "chunk": pa.array([i], pa.int32()), "start": pa.array([start], pa.int64()), "sure": pa.array([sure], pa.int64()), "piece": [text[start:end]]})

    def pretokenised(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            for row in b.to_pylist():
                at = spans(row["piece"], bpe.pattern)
                ids = [bpe.pieces[row["piece"][x:y]] for x, y in zip(at, at[1:], strict=False)]
                yield pa.record_batch({
                    "doc_id": pa.array([row["doc_id"]], b.column("doc_id").type), "key": [row["key"]], "chunk": pa.array([row["chunk"]], pa.int32()), "sure": pa.array([row["sure"]], pa.int64()),
                    "bounds": pa.array([[row["start"] + x for x in at]], pa.list_(pa.int64())), "sizes": pa.array([[len(i) for i in ids]], pa.list_(pa.int32())), "ids": pa.array([list(chain.from_iterable(ids))], pa.list_(pa.int32())),
                })

    def stitched(batches):
        bpe = codec(ranks_path, pattern)
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                chunks = {c["chunk"]: c for c in part.column("chunks").to_pylist()[0]}
                times = part.column("times").to_pylist()[0]
                ordered = [chunks[i] for i in range(len(chunks))]
                taken, out = stitch([(c["bounds"], c["sure"]) for c in ordered]), []
                for c, (begin, end) in zip(ordered, taken, strict=True):
                    place = 0
                    for x, n in zip(c["bounds"], c["sizes"], strict=False):
                        if begin <= x < end:
                            out += c["ids"][place : place + n]
                        place += n
                for _ in range(times):
                    yield batch(part.column("doc_id"), [out], bpe)

    long = F.length("text") > chunk_chars + overlap
    p = partitions(docs.sparkSession)
    pieces = given.where(long).mapInArrow(chunked, f"doc_id {kind}, key string, chunk int, start long, sure long, piece string")
    pieces = pieces.repartition(p, "key", "chunk").mapInArrow(pretokenised, f"doc_id {kind}, key string, chunk int, sure long, bounds array<long>, sizes array<int>, ids array<int>")
    # a repeated row's chunks meet in one task: each is kept once, with how often it came
    once = pieces.groupBy("doc_id", "key", "chunk").agg(F.first(F.struct("chunk", "sure", "bounds", "sizes", "ids")).alias("c"), F.count("*").alias("times"))
    joined = once.groupBy("doc_id", "key").agg(F.collect_list("c").alias("chunks"), F.max("times").alias("times"))
    return given.where(~long).mapInArrow(whole, schema).unionByName(joined.mapInArrow(stitched, schema))
