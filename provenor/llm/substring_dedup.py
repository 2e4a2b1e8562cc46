"""Removal of repeated passages with prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; a word goes if a window over it
also starts earlier (in a smaller identifier, or in the same document before it). Repeats
of that length are the nodes at that depth of the corpus's suffix tree, which is read to that depth:
a suffix is its first ``window`` words, taken in ``LEVELS`` steps of equal length.

1. *Pruning.* In every window the ``gram`` consecutive words with the least hash are its
   anchor; equal windows have equal anchors at the same place, so a window whose
   anchor occurs once in the corpus is a leaf by itself and goes no further.
2. *Division by prefix.* All windows' prefixes of each level are counted. A suffix is divided off by the
   shortest prefix whose group is no larger than a task's share of all windows; groups are counted in
   buckets, so a count is never too small.
3. *Subtrees.* A division's suffixes are sorted by their steps: the leaves of its subtree in order. The
   common prefix of neighbours gives the internal nodes; the leaves under one at the depth of the window
   are one repeat, and all but the earliest are marked. Marks that follow each other are one run.

Leaves of one node, and anchors, that meet in a block of texts are settled there: of a node only its earliest
leaf in a block goes on, of an anchor one occurrence. So a passage in a third of all documents
is a leaf for each block, not for each document.

Equal texts are one to begin with; only the first is read on, and of the others every word in
a window goes. Texts are equal by SHA-256; suffixes are compared by hashes, of 64 bits for
the whole window and as many for the steps before it. Each row is dealt out once, its text compressed, and its marks come to it there.

Edge cases: null text has no words; a text shorter than a window loses nothing and stays as it is. Rows
with one identifier and the same text are the same document and get the same result; with other
texts they are different documents, in the order of the first 8 bytes of their digests. A null
identifier is before all others; identifiers that are not integers stand in the order of
their hashes. Other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenor.llm.common import Memo, order_key, partitions, release, tidy

LEVELS = 4
#: Bits of the hash of each prefix after the first, which has what is left of 64.
STEP_BITS = 16
#: What a row is: the text's first document, a later copy, shorter than a window, or the first once more.
FIRST, COPY, SHORT, TWIN = 0, 1, 2, 3
#: Multipliers of a sequence's words; the last one scatters the hash. Windows are shorter than they.
FACTORS = np.random.default_rng(3).integers(1, 2**64, 256, np.uint64) | np.uint64(1)


def scattered(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * FACTORS[255]


def sequence_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive words."""
    return next(prefix_hashes(h, length, [length]))


def levels(window: int) -> list[int]:
    """The lengths of a suffix's prefixes, the whole window last."""
    return [max(1, window * i // LEVELS) for i in range(1, LEVELS + 1)]


def prefix_hashes(h: np.ndarray, window: int, lengths: list[int]):
    """For each of ``lengths`` a hash of that many first words of each ``window`` consecutive ones."""
    n = len(h) - window + 1
    out, j = np.zeros(max(n, 0), np.uint64), 0
    for length in lengths:
        while j < length:
            if n > 0:
                out += h[j : j + n] * FACTORS[j]
            j += 1
        yield scattered(out)


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least hash of ``gram`` of its words and where it is, the first of equal ones."""
    best = sequence_hashes(h, gram)
    at, width, have = np.arange(len(best)), window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return best, at


def covered(starts: np.ndarray, counts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window; ``counts`` windows follow each other from each of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + window, n), -1)
    return edge.cumsum()[:n] > 0


def _memo() -> Memo:
    """Words and their hashes, as a task remembers them."""
    return Memo(xxhash.xxh3_64_intdigest, 150_000)


def _hashed(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of some texts' words in a row; where each text begins, and the end."""
    words = [t.split() for t in texts]
    at = np.cumsum([0] + [len(w) for w in words])
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(at[-1])), at


def _whole(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and which text it is."""
    count = np.maximum(np.diff(at) - window + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    return at[of] + np.arange(len(of)) - np.repeat(count.cumsum() - count, count), of


def _slices(batches, rows: int = 128):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _unpacked(values) -> list[bytes]:
    un = zstandard.ZstdDecompressor()
    return [un.decompress(z) for z in values.to_pylist()]


def _firsts(part):
    return part.filter(pa.array(part.column("state").to_numpy() == FIRST))


def _spread(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key that nothing else has, to deal out what needs no company."""
    return scattered(k.view(np.uint64) + start.astype(np.uint64) * FACTORS[254]).view(np.int64)


def _runs(key: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive starts of one key begin, and how long they are; rows are sorted by key and start."""
    new = np.ones(len(start), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in key], axis=0) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(start)))


class Blocks:
    """Arrays held back until there are ``size`` rows of them."""

    def __init__(self, size: int):
        self.size, self.held, self.n = size, [], 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.held.append(arrays)
        self.n += len(arrays[0])
        return self.n >= self.size

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        return out


def dealt(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` (columns c0, c1, ...) with k, digest, id, state, n and z, dealt out by k.

    z is the text compressed, null for null texts and for copies that are known where they are read; n is then their words.
    """
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    carry = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c != text_col}
    given = docs.select(order_key(docs, id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256)).alias("digest"), *[c.alias(n) for n, c in carry.items()])
    fields = [f for f in given.schema.fields if f.name in carry]

    def run(batches):
        pack, least, rows = zstandard.ZstdCompressor(level=1), Memo(lambda _: None, 500_000), 0
        for part in _slices(batches):
            ids, digests = part.column("id").to_pylist(), part.column("digest").to_pylist()
            state, n, z = [], [], []
            for i, d, t in zip(ids, digests, part.column("text").to_pylist(), strict=True):
                if t is None or len(t.split(None, window - 1)) < window:
                    s = SHORT
                elif (had := least[d]) is not None and i > had:
                    s = COPY
                else:
                    s, least[d] = FIRST, i
                state.append(s)
                n.append(len(t.split()) if s == COPY else 0)
                z.append(None if t is None or s == COPY else pack.compress(t))
            state = np.array(state, np.int32)
            by_text = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            k = np.where(state == FIRST, by_text, _spread(by_text, np.arange(rows, rows + len(state))))
            rows += len(state)
            cols = {"k": pa.array(k), "digest": part.column("digest"), "id": part.column("id"), "state": pa.array(state), "n": pa.array(n, pa.int64()), "z": pa.array(z, pa.binary())}
            yield pa.record_batch(cols | {f.name: part.column(f.name) for f in fields})

    # k is never null: what reads the dealt rows must not filter them first, or they are dealt again
    schema = T.StructType(T.DataType.fromDDL("k long not null, digest binary, id long, state int, n long, z binary").fields + fields)
    rows = given.mapInArrow(tidy(run), schema).repartition(partitions(docs.sparkSession), "k")
    same = W.partitionBy("k", "digest", "state").orderBy("id")
    rows = rows.withColumns({"place": F.row_number().over(same), "rank": F.rank().over(same)})
    first = F.col("state") == FIRST
    return rows.withColumn("state", F.when(first & (F.col("rank") > 1), COPY).when(first & (F.col("place") > 1), TWIN).otherwise(F.col("state"))).drop("place", "rank")


def frequent_prefixes(docs: DataFrame, window: int, text_col: str, share: int | None = None) -> list[np.ndarray]:
    """For each level but the last, which buckets of prefixes hold more than a task's share of all windows.

    The buckets are four for each task (4,096 to 65,536); a bucket counts every window of every text.
    """
    bits = min(max(12, (4 * partitions(docs.sparkSession) - 1).bit_length()), 16)

    def run(batches):
        memo, total = _memo(), np.zeros((LEVELS - 1, 1 << bits), np.int64)
        for part in _slices(batches):
            h, at = _hashed([t for t in part.column("text").to_pylist() if t is not None], memo)
            start, _ = _whole(at, window)
            for i, x in enumerate(prefix_hashes(h, window, levels(window)[:-1])):
                total[i] += np.bincount((x[start] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 100_000):
            yield pa.record_batch({"at": pa.array(at[i : i + 100_000].astype(np.int32)), "n": pa.array(flat[at[i : i + 100_000]])})

    text = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    got = text.mapInArrow(tidy(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((LEVELS - 1) << bits, np.int64)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(LEVELS - 1, -1)
    return list(counts > (share or max(1 << 16, 4 * int(counts[0].sum()) >> bits)))


def division_levels(paths: list[np.ndarray], often: list[np.ndarray]) -> np.ndarray:
    """The level of the shortest prefix that is not too frequent, or of the whole window."""
    shift = np.uint64(64 - (len(often[0]) - 1).bit_length())
    out, left = np.zeros(len(paths[0]), np.int64), np.ones(len(paths[0]), bool)
    for i, hot in enumerate(often):
        left &= hot[(paths[i] >> shift).astype(np.int64)]
        out[left] = i + 1
    return out


def stepped(paths: list[np.ndarray]) -> np.ndarray:
    """The hashes of the prefixes, the shortest one's foremost and longest, in one number."""
    first = np.uint64(64 - STEP_BITS * (LEVELS - 2))
    out = paths[0] >> (np.uint64(64) - first)
    for x in paths[1:]:
        out = out << np.uint64(STEP_BITS) | x >> np.uint64(64 - STEP_BITS)
    return out


#: A run of windows is one number: where it starts, and in the last bits how many follow. A leaf is below zero:
#: its start and the level of the prefix that divides it off. So rows are short when they are dealt.
COUNT_BITS = 20


def _run(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << COUNT_BITS) | n


def _leaf(start: np.ndarray, level: np.ndarray) -> np.ndarray:
    return -(start.astype(np.int64) * LEVELS + level) - 1


def division():
    """What a leaf is dealt out by: the steps of its prefix, or the whole window. Marks pass by."""
    level = F.pmod(-F.col("run") - 1, F.lit(LEVELS))
    out = F.when(F.col("run") >= 0, F.col("k"))
    for i in range(LEVELS - 1):
        out = out.when(level == i, F.shiftrightunsigned("steps", STEP_BITS * (LEVELS - 2 - i)))
    return out.otherwise(F.col("whole"))


def repeats(texts: DataFrame, often: list[np.ndarray], window: int, gram: int, block: int) -> DataFrame:
    """(k, found: array of (id, run)): runs of windows of ``texts`` that also start earlier."""
    spark = texts.sparkSession
    p, shared = partitions(spark), spark.sparkContext.broadcast(often)

    def anchored(batches):
        memo, held = _memo(), Blocks(block)

        def out():
            anchor, k, start, n = held.take()
            _, first, which, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = times[which] > 1
            alone = known.copy()
            alone[first] = False
            d = np.where(alone, _spread(k, start), anchor.view(np.int64))
            return pa.record_batch({"d": pa.array(d), "k": pa.array(k), "run": pa.array(_run(start, n << 1 | known))})

        for part in _slices(batches):
            part = _firsts(part)
            h, at = _hashed(_unpacked(part.column("z")), memo)
            start, of = _whole(at, window)
            if not len(start):
                continue
            best, place = anchors(h, window, gram)
            best, place = best[start], place[start]
            new, n = _runs([of, place], np.arange(len(of)))
            if held.add(best[new], part.column("k").to_numpy()[of[new]], (start - at[of])[new], n):
                yield out()
        if held.n:
            yield out()

    runs = texts.mapInArrow(tidy(anchored), "d long, k long, run long").repartition(p, "d")
    again = runs.withColumn("times", F.count("*").over(W.partitionBy("d"))).where((F.col("times") > 1) | (F.col("run").bitwiseAND(F.lit(1)) == 1))
    listed = again.select("k", "run").repartition(p, "k").groupBy("k").agg(F.collect_list("run").alias("runs"))

    def suffixes(batches):
        often, memo, held = shared.value, _memo(), Blocks(block)

        def out():
            *paths, k, id, start = held.take()
            order = np.lexsort((start, k, id, paths[-1]))
            paths, k, id, start = [x[order] for x in paths], k[order], id[order], start[order]
            later = np.zeros(len(k), bool)
            later[1:] = paths[-1][1:] == paths[-1][:-1]
            heads = [x[~later] for x in paths]
            yield batch(stepped(heads[:-1]), heads[-1], k[~later], id[~later], _leaf(start[~later], division_levels(heads, often)))
            k, id, start = k[later], id[later], start[later]
            order = np.lexsort((start, id, k))
            k, id, start = k[order], id[order], start[order]
            if len(k):
                at, n = _runs([k, id], start)
                none = np.zeros(len(at), np.uint64)
                yield batch(none, none, k[at], id[at], _run(start[at], n))

        def batch(steps, whole, k, id, run):
            return pa.record_batch({"steps": pa.array(steps.view(np.int64)), "whole": pa.array(whole.view(np.int64)), "k": pa.array(k), "id": pa.array(id), "run": pa.array(run)})

        for part in _slices(batches):
            part = _firsts(part)
            h, at = _hashed(_unpacked(part.column("z")), memo)
            runs = part.column("runs")
            of = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy())
            run = runs.flatten().to_numpy()
            first, n = run >> COUNT_BITS, (run & ((1 << COUNT_BITS) - 1)) >> 1
            start, of = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n), np.repeat(of, n)
            # two texts may share a key; then one is given the other's runs too
            fits = start + window <= np.diff(at)[of]
            start, of = start[fits], of[fits]
            if len(start):
                paths = [x[at[of] + start] for x in prefix_hashes(h, window, levels(window))]
                if held.add(*paths, part.column("k").to_numpy()[of], part.column("id").to_numpy()[of], start):
                    yield from out()
        if held.n:
            yield from out()

    leaves = texts.join(listed, "k").mapInArrow(tidy(suffixes), "steps long, whole long, k long, id long, run long")

    def subtrees(batches):
        last = None
        for b in batches:
            edges = [b.column("steps").to_numpy() >> (STEP_BITS * i) for i in reversed(range(LEVELS - 1))] + [b.column("whole").to_numpy()]
            before = [np.concatenate([[x[0] - 1 if last is None else y], x[:-1]]) for x, y in zip(edges, last or edges, strict=True)]
            last = [x[-1] for x in edges]
            # how many steps a leaf has in common with its neighbour: the depth of the node above both
            common = np.cumprod([x == y for x, y in zip(edges, before, strict=True)], axis=0).sum(axis=0)
            run = b.column("run").to_numpy()
            marked = (run >= 0) | (common == LEVELS)
            run = run[marked]
            out = b.filter(pa.array(marked))
            yield pa.record_batch({"k": out.column("k"), "id": out.column("id"), "run": pa.array(np.where(run >= 0, run, _run((-run - 1) // LEVELS, 1)))})

    # a node's leaves have one level; the one that starts first has the largest number
    ordered = leaves.repartition(p, division()).sortWithinPartitions("steps", "whole", "id", "k", F.desc("run"))
    found = ordered.mapInArrow(subtrees, "k long, id long, run long")
    return found.select("k", F.struct("id", "run").alias("x")).repartition(p, "k").groupBy("k").agg(F.collect_list("x").alias("found"))


def _marked(docs: DataFrame, window: int, gram: int, block: int, share: int | None, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``dealt`` and found, the runs of windows in them that start earlier."""
    if not 0 < gram <= window < len(FACTORS) - 1 or not 0 < block < 1 << (COUNT_BITS - 1):
        raise ValueError("gram must be 1 to window, window less than 255, and block less than 2^19")
    release(docs.sparkSession)
    often = frequent_prefixes(docs, window, text_col, share)
    texts = dealt(docs, window, id_col, text_col)
    return texts.join(repeats(texts, often, window, gram, block), "k", "left")


def _kept(part, window: int):
    """For each row its words (None: not known), how many of them go, and what is left of them."""
    for state, own, n, z, found in zip(part.column("state").to_pylist(), part.column("id").to_pylist(), part.column("n").to_pylist(), part.column("z"), part.column("found"), strict=True):
        words = zstandard.ZstdDecompressor().decompress(z.as_py()).split() if z.is_valid else []
        if state == COPY:
            yield (len(words) or n), (len(words) or n), []
            continue
        if state != SHORT and found.is_valid:
            ids, run = (found.values.field(x).to_numpy() for x in ("id", "run"))
            starts, counts = run >> COUNT_BITS, run & ((1 << COUNT_BITS) - 1)
            mine = (ids == own) & (starts + counts - 1 + window <= len(words))
            if mine.any():
                gone = covered(starts[mine], counts[mine], len(words), window)
                yield len(words), int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                continue
        yield len(words), 0, words


def dedup(docs: DataFrame, window: int = 20, gram: int = 5, block: int = 500_000, share: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each input row.

    ``block``: how many anchors or leaves a task settles at a time; ``share``: how many windows a prefix may
    have (by default a task's share). Neither changes the result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = _marked(rows, window, gram, block, share, "doc_id", "text")

    def run(batches):
        for part in _slices(batches):
            n, gone, kept = zip(*_kept(part, window), strict=True)
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in kept]
            yield pa.record_batch({"doc_id": part.column("c0"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha)})

    return marked.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def rewritten(docs: DataFrame, window: int = 20, gram: int = 5, block: int = 500_000, share: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the texts: all columns, every row.

    A text that loses nothing stays as it is; of another the words that stay are joined by spaces.
    """
    marked = _marked(docs, window, gram, block, share, id_col, text_col)
    names = [c if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]

    def run(batches):
        un = zstandard.ZstdDecompressor()
        for part in _slices(batches):
            new = []
            for z, (_, gone, kept) in zip(part.column("z"), _kept(part, window), strict=True):
                new.append(b" ".join(kept) if gone else un.decompress(z.as_py()) if z.is_valid else None)
            text = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.record_batch([text if n == text_col else part.column(n) for n in names], [f"r{i}" for i in range(len(names))])

    kinds = [T.StringType() if c == text_col else docs.schema[c].dataType for c in docs.columns]
    return marked.mapInArrow(tidy(run), T.StructType([T.StructField(f"r{i}", t) for i, t in enumerate(kinds)])).toDF(*docs.columns)
