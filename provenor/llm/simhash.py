"""SimHash near-deduplication with pivot distance tables.

Every text gets a fingerprint: bit i is set if it is set in over half of the XXH64
hashes of the text's word shingles. Distinct fingerprints are linked at ``radius`` or
fewer differing bits, and links are followed to components.

The distances of a fingerprint to a fixed set of reference fingerprints (pivots) are
its coordinates. By the triangle inequality two fingerprints within the radius differ by
at most the radius in each coordinate, so a pair is discarded when any coordinate
differs by more; survivors are verified on their bits. At a small radius in 64 bits,
coordinates alone leave a constant share of all pairs, which would grow with
the square of the corpus. So the table is divided first, without loss: the bits are cut into
``radius + 2`` blocks, of which two at least are the same in a linked pair; for each two
blocks the fingerprints that agree there are a division. Within a division the
coordinates, sorted by the first, decide.

A division gives a forest of links, not its pairs. A division of more than ``dense``
fingerprints (possible where thousands of near copies differ in few bits) is not paired in
one place. At a radius of 2 each of its fingerprints is listed under every pattern made by
changing at most one of its bits, and linked to the least one listed there: what
shares a pattern differs in two bits at most, and what differs in two shares one. At other
radii the division is split in parts of ``dense`` and every two parts are paired in a task
of their own.

Components come from contracting edges, on distributed tables, until none is left. Equal
fingerprints are one row throughout.

Edge cases: null text counts as empty; texts without words have fingerprint zero and are
linked like any other; texts with fewer words than a shingle are one shingle.
Repeated rows and shared identifiers are rows of their own. Null identifiers are
never a component's identifier unless it has no other. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import materialise, partitions

BITS = 64
SEED = 42
#: Multipliers that make further hashes of a hash.
LANE_FACTORS = np.random.default_rng(7).integers(1, 2**64, 15, np.uint64) | np.uint64(1)


def pivots(n: int = 16, seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(h: np.ndarray, lanes: int) -> list[int]:
    """A fingerprint of ``lanes`` times 64 bits, as signed numbers; the first lane is that of the hashes themselves."""
    out = [majority(h)]
    for f in LANE_FACTORS[: lanes - 1]:
        x = (h ^ (h >> np.uint64(29))) * f
        out.append(majority((x ^ (x >> np.uint64(32))) * f))
    return [x - (1 << 64) if x >> 63 else x for x in out]


def fingerprint(text: bytes, words: int) -> int:
    w = text.lower().split()
    if not w:
        return 0
    n = len(w) - words + 1
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if n > 1 else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(n, 1)))


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits), digest (of the text), a row for each input row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    given = docs.select(docs[id_col].alias("doc_id"), text.cast("binary").alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64)), "digest": b.column("digest")})

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, fp long, digest string")


def masks(radius: int) -> list[int]:
    """For each two of radius + 2 blocks of bits, the mask of both, signed."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(blocks, 2))]


def linked(fp: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a forest over fingerprints within the radius."""
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    label, out = np.arange(len(fp)), []
    start = 0
    while start < len(fp):
        # rows of about a million pairs at a time
        stop = start + 1
        while stop < len(fp) and (ends[start : stop + 1] - np.arange(start, stop + 1)).sum() < 1_000_000 and stop - start < 4096:
            stop += 1
        sizes = ends[start:stop] - np.arange(start, stop) - 1
        i = np.repeat(np.arange(start, stop), sizes)
        j = i + 1 + np.arange(len(i)) - np.repeat(sizes.cumsum() - sizes, sizes)
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        sure = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[sure], j[sure]
        rows = np.unique(i)
        for x, lo, hi in zip(rows.tolist(), np.searchsorted(i, rows).tolist(), np.searchsorted(i, rows, "right").tolist(), strict=True):
            # a row's neighbours of other labels join it, one link for each label
            near = j[lo:hi]
            near = near[label[near] != label[x]]
            others, first = np.unique(label[near], return_index=True)
            if len(others):
                out += [(int(order[x]), int(order[y])) for y in near[first].tolist()]
                label[np.isin(label, others)] = label[x]
        start = stop
    return out


def _forest(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from divisions (t, key, fp) of bounded size."""
    refs = pivots()

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def links(t, key, fp):
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(t)]])
            a, b = [], []
            for x, y in zip(starts.tolist(), stops.tolist(), strict=True):
                if y - x > 1:
                    own = fp[x:y]
                    for i, j in linked(own.view(np.uint64), radius, refs):
                        a.append(own[i])
                        b.append(own[j])
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            held = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, ("t", "key", "fp"), strict=True)]
            # the last division may go on in the next batch
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(last):
                done = int(last[-1]) + 1
                yield links(*(h[:done] for h in held))
                held = [h[done:] for h in held]
        if len(held[0]):
            yield links(*held)

    p = partitions(rows.sparkSession)
    return rows.repartition(p, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(run, "a long, b long")


def _through_patterns(rows: DataFrame) -> DataFrame:
    """Links (a, b) at radius 2 from divisions (t, key, fp) of any size."""
    flips = [0] + [x - (1 << 64) if x >> 63 else x for x in (1 << i for i in range(BITS))]
    listed = rows.select("t", "key", "fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("x")).select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("c"))
    least = listed.groupBy("t", "key", "c").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return listed.join(least, ["t", "key", "c"]).where("fp != a").select("a", F.col("fp").alias("b"))


def _in_parts(rows: DataFrame, dense: int) -> DataFrame:
    """Divisions (t, key, fp, n) again, as one division for every two parts of about ``dense``."""
    parts = F.ceil(F.col("n") / dense).cast("bigint")
    split = rows.withColumn("p", F.pmod(F.xxhash64("fp"), parts)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    # two divisions under one hashed key are only compared for nothing
    return split.select("t", F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "fp")


def links(fps: DataFrame, radius: int = 2, dense: int = 8192) -> DataFrame:
    """Links (a, b), a < b, that connect what is within the radius; ``fps``: distinct fp."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("d")).select("d.t", "d.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, ["t", "key"]), "simhash-divisions")
    out = _forest(shared.where(F.col("n") <= dense).drop("n"), radius)
    if not (big := shared.where(F.col("n") > dense)).isEmpty():
        out = out.unionByName(_through_patterns(big.drop("n")) if radius == 2 else _forest(_in_parts(big, dense), radius))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for each end of an edge: the least vertex that can be reached.

    In each round every vertex goes to the first among itself and its neighbours, in an order drawn anew, and the edges
    then run between the vertices gone to, each once and none from one to itself. A constant share of the vertices is left
    by every round, whatever the graph and its identifiers, so tables and joins shrink from round to round.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    steps = []
    for t in range(rounds):
        pairs = materialise(pairs, "components-edges")
        if steps and pairs.isEmpty():
            break
        place = lambda c, t=t: F.struct(F.xxhash64(c, F.lit(t)).alias("place"), F.col(c).alias("v"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first")).select(F.col("a").alias("v"), F.least("first", place("a"))["v"].alias("to"))
        steps.append(materialise(first, "components-steps"))
        side = lambda of, step=steps[-1]: step.select(F.col("v").alias(of), F.col("to").alias(f"{of}_to"))
        moved = pairs.where("a != b").join(side("a"), "a").join(side("b"), "b").where("a_to != b_to")
        pairs = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
    else:
        raise RuntimeError("components did not settle")
    found = steps.pop()
    for step in reversed(steps):
        after = found.select(F.col("v").alias("to"), F.col("to").alias("end"))
        found = step.join(after, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    found = materialise(found, "components-ends")
    least = found.groupBy("to").agg(F.min("v").alias("root"))
    return materialise(found.join(least, "to").select("v", "root"), "components-roots")


def classes(docs: DataFrame, words: int = 5, radius: int = 2, dense: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, digest, component_id (the least doc_id of the component), first (its doc_id and digest)."""
    table = materialise(fingerprints(docs, words, id_col, text_col), "simhash-fingerprints")
    fps = materialise(table.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("first")), "simhash-distinct")
    found = components(links(fps.select("fp"), radius, dense))
    rooted = fps.join(found, F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.drop("first").join(least, "root").select("fp", "first")
    return table.join(named, "fp").select("doc_id", "fp", "digest", F.col("first.doc_id").alias("component_id"), "first")


def drop_near_copies(docs: DataFrame, words: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of its component, with all their columns."""
    found = classes(docs, words, radius, id_col=id_col, text_col=text_col)
    lost = found.where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first.digest"))))
    lost = materialise(lost.select(F.col("doc_id").alias("__lost_id"), F.col("digest").alias("__lost_digest")).distinct(), "simhash-lost")
    marked = docs.withColumn("__digest", F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256))
    kept = marked.join(lost, (marked["__digest"] == lost["__lost_digest"]) & marked[id_col].eqNullSafe(lost["__lost_id"]), "left_anti")
    return kept.select(*docs.columns)
