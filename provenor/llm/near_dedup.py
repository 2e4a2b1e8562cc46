"""Near-deduplication of texts by shared shingles, SimHash and exact Jaccard similarity.

Two texts are linked if the sets of their five-word shingles (words ASCII-lower-cased, hashed to
64 bits by XXH64) have a Jaccard similarity of ``least`` or more; links are followed to components,
and the first text of each stays.

SimHash alone cannot find such pairs at scale: they lie up to half as far apart as unrelated texts, and a
division by equal bits that loses none of them leaves a constant share of all pairs. So:

1. *Signatures.* Shingles are put in one order, those that are common in a bounded sample last. Sets of
   similarity ``least`` share one of their first n - ceil(least * n) + 1 shingles (prefix filter), so no pair is
   lost and the number of keys grows with the corpus. Sizes and the place of the shared shingle discard
   further pairs. The order is a matter of speed only.
2. Texts that share such a shingle are a group. Groups of up to ``small`` are paired, and pairs counted: texts as
   similar as that share more of their first shingles than one, the more the closer their sizes are. In
   larger groups each text is first paired with its neighbour in size and with the least in size that may be similar.
3. *SimHash.* Pairs whose fingerprints differ in more than ``RADIUS`` of 512 bits are discarded. At a similarity of
   0.8 a bit differs with a chance of 0.152, so a pair is lost with a chance below 1e-8; sets of fewer than
   ``SURE`` shingles, for which that does not hold, are not discarded, nor is anything below a ``least`` of 0.8.
4. Survivors are verified on whole sets. Where texts of a large group are then still in different
   components, fingerprints travel with the group's rows and all its pairs are compared there: distances to pivots,
   which are fingerprints of the group itself, discard first, then the bits. A forest of what is near leaves the group.
   Its components are crowds; each text of a crowd travels there once with its whole set, and a forest of the similar
   pairs leaves it. So no row is made for a pair, and no pair of different components is left out.

What stays square is time, not rows: comparing bits, and then sets, of many texts that share a
shingle rare in the sample and are near but not similar. One task holds a crowd's sets.

Edge cases: null text counts as empty; texts without words are one class; texts with fewer words
than a shingle are one shingle. Equal texts are one node throughout. Null identifiers are never the
first of a component unless it has no other. Of repeated rows (one identifier, one text) all stay or go.
Other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.common import fresh, if_small, materialise, partitions, release, tidy
from provenor.llm.simhash import SEED, components, wide_fingerprint

#: Bits of the table that tells which sets are worth sending to verification.
WANTED = 24
SLACK = 1e-9
#: Fingerprints of so many times 64 bits, the distance within which pairs are verified, and sets too small to discard.
LANES, RADIUS, SURE = 8, 130, 32


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of a text's shingles, hashed and sorted; a text without words has one that no other has."""
    w = text.lower().split()
    n = max(len(w) - words + 1, 1)
    found = {b" ".join(w[i : i + words]) for i in range(n)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found)))


def prefix(h: np.ndarray, common: np.ndarray, times: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, in the order by commonness."""
    rank = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, times[at], 0)
    return h[np.lexsort((h, rank))][: len(h) - math.ceil(least * len(h) - SLACK) + 1]


def _binary(docs: DataFrame, text_col: str):
    return F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")


def commonness(docs: DataFrame, words: int, sample: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in three or more texts of a sample, and in how many.

    The sample is a sixteenth of the texts, but ``sample`` at least and eight times that at most.
    """
    total = docs.count()
    share = min(1.0, min(max(sample, total / 16), 8 * sample) / max(total, 1))
    text = _binary(docs, text_col)
    some = docs.select(_node(text).alias("node"), text.alias("text")).where(F.pmod("node", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).dropDuplicates(["node"]).select("text")

    def run(batches):
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.record_batch({"h": pa.array(shingles(t, words).view(np.int64))})

    got = some.mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").toArrow()
    h = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("n").to_numpy()[order]


def _groups(rows: DataFrame, run_group, columns: list[str], schema: str) -> DataFrame:
    """``run_group(columns) -> arrays`` over the rows of each h, which come sorted by h, size and node."""

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held = [np.zeros(0, np.int64)] * len(columns)

        def done(cols):
            edge = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(cols[0])]])
            many = stops - starts > 1
            out, n = [], 0
            for x, y in zip(starts[many].tolist(), stops[many].tolist(), strict=True):
                for got in run_group(*(c[x:y] for c in cols)):
                    out.append(got)
                    n += len(got[0])
                    if n > 100_000:
                        yield batch(out)
                        out, n = [], 0
            if out:
                yield batch(out)

        def batch(out):
            return pa.record_batch({k: pa.array(np.concatenate(v)) for k, v in zip(names, zip(*out, strict=True), strict=True)})

        for b in batches:
            held = [np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, columns, strict=True)]
            last = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(last):
                stop = int(last[-1]) + 1
                yield from done([h[:stop] for h in held])
                held = [h[stop:] for h in held]
        if len(held[0]):
            yield from done(held)

    p = partitions(rows.sparkSession)
    return rows.repartition(p, "h").sortWithinPartitions("h", F.shiftright("m", 32), "node").mapInArrow(tidy(run), schema)


def _may(i: np.ndarray, j: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and the places of a shared shingle allow the similarity; others may be shared before it."""
    n, p = m >> 32, m & 0xFFFFFFFF
    most = np.minimum((n - p)[i], (n - p)[j]) + np.minimum(p[i], p[j])
    return most + SLACK >= least * (n[i] + n[j] - most)


def shared_at_least(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """How many of their first shingles similar sets of sizes x <= y share: the overlap they need, less what may lie behind."""
    return np.maximum(np.ceil(least / (1 + least) * (x + y) - SLACK) - np.ceil(least * y - SLACK) + 1, 1).astype(np.int64)


def _all_pairs(m: np.ndarray, least: float, at_once: int = 250_000):
    """Index pairs that sizes and places allow; m is sorted by size."""
    n = m >> 32
    ends = np.searchsorted(n, np.floor(n / least + SLACK), "right")
    start = 0
    while start < len(m):
        sizes = np.maximum(ends[start:] - np.arange(start, len(m)) - 1, 0)
        stop = start + max(1, int(np.searchsorted(sizes.cumsum(), at_once, "right")))
        sizes = sizes[: stop - start]
        i = np.repeat(np.arange(start, stop), sizes)
        j = i + 1 + np.arange(len(i)) - np.repeat(sizes.cumsum() - sizes, sizes)
        ok = _may(i, j, m, least)
        yield i[ok], j[ok]
        start = stop


def _candidates(rows: DataFrame, least: float, small: int) -> DataFrame:
    """(a, b, h, m): pairs of nodes for each shingle they share, with m = - how many they must share; pairs of large
    groups with m = 0; and the rows (a, h, m) of large groups.
    """

    def group(h, a, m):
        _, first = np.unique(a, return_index=True)
        first.sort()
        h, a, m = h[first], a[first], m[first]
        if len(a) <= small:
            for i, j in _all_pairs(m, least):
                if len(i):
                    yield np.minimum(a[i], a[j]), np.maximum(a[i], a[j]), np.zeros(len(i), np.int64), -shared_at_least(m[i] >> 32, m[j] >> 32, least)
            return
        yield a, a, h, m
        j = np.arange(1, len(a))
        base = np.searchsorted(m >> 32, np.ceil(least * (m[j] >> 32) - SLACK))
        for i, j in ((j - 1, j), (np.minimum(base, j - 1), j)):
            ok = _may(i, j, m, least)
            i, j = i[ok], j[ok]
            if len(i):
                yield np.minimum(a[i], a[j]), np.maximum(a[i], a[j]), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)

    return _groups(rows, group, ["h", "node", "m"], "a long, b long, h long, m long")


def pivot_table(prints: np.ndarray, n: int = 4) -> np.ndarray:
    """The distances of a group's fingerprints (a row each) to some of its own, spread over its sizes."""
    refs = prints[np.linspace(0, len(prints) - 1, n).astype(np.int64)]
    return np.stack([np.bitwise_count(prints ^ r).sum(1, dtype=np.int16) for r in refs], 1)


def _near_pairs(m: np.ndarray, root: np.ndarray, prints: np.ndarray, least: float):
    """Index pairs of different components whose sizes, places and fingerprints allow the similarity.

    Fingerprints whose distances to a pivot differ by more than ``RADIUS`` lie further apart than that, so the
    table discards without loss; what it leaves is compared bit by bit.
    """
    table, sure = pivot_table(prints), (m >> 32) >= SURE
    for i, j in _all_pairs(m, least):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if least >= 0.8:
            for t in table.T:
                near = (np.abs(t[i] - t[j]) <= RADIUS) | ~sure[i]
                i, j = i[near], j[near]
            near = (np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int16) <= RADIUS) | ~sure[i]
            i, j = i[near], j[near]
        yield i, j


def forest(pairs, label: np.ndarray, alike=None) -> np.ndarray:
    """Of index pairs that are ``alike(x, others)`` some, which join all components ``label`` that any of them joins."""
    label, out = np.unique(label, return_inverse=True)[1], []
    for i, j in pairs:
        edge = np.flatnonzero(np.diff(i, prepend=-1))
        for x, others in zip(i[edge].tolist(), np.split(j, edge[1:]), strict=False):
            others = others[label[others] != label[x]]
            if alike and len(others):
                others = others[alike(x, others)]
            # one link for each component that joins
            joined, first = np.unique(label[others], return_index=True)
            if len(joined):
                out += [(x, y) for y in others[first].tolist()]
                label[np.isin(label, joined)] = label[x]
    return np.array(out, np.int64).reshape(-1, 2)


def similar(sets: list[np.ndarray], least: float):
    """``alike(x, others)`` of whole sets."""
    long = np.array([len(x) for x in sets])
    begin = long.cumsum() - long
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.zeros(int(flat.max()) + 1, np.int64)

    def alike(x, others):
        mine = flat[begin[x] : begin[x] + long[x]]
        own[mine] = 1
        size = long[others]
        starts = size.cumsum() - size
        both = np.add.reduceat(own[flat[np.arange(size.sum()) + np.repeat(begin[others] - starts, size)]], starts)
        own[mine] = 0
        return both + SLACK >= least * (long[x] + size - both)

    return alike


_LANES = [f"f{i}" for i in range(LANES)]


def _linked(a: np.ndarray, links: np.ndarray):
    if len(links):
        x, y = a[links[:, 0]], a[links[:, 1]]
        yield np.minimum(x, y), np.maximum(x, y)


def _across(rows: DataFrame, least: float) -> DataFrame:
    """A forest (a, b) of the near pairs of large groups (h, node, m, root, f0, ...) that are of different components."""

    def group(h, a, m, root, *f):
        yield from _linked(a, forest(_near_pairs(m, root, np.stack(f, 1).view(np.uint64), least), np.arange(len(a))))

    return _groups(rows, group, ["h", "node", "m", "root", *_LANES], "a long, b long")


def _links_across(rows: DataFrame, least: float) -> DataFrame:
    """A forest (a, b) of the similar pairs of crowds (h, node, m, root, f0, ..., hashes), on whole sets."""

    def group(h, a, m, root, *f):
        pairs = _near_pairs(m, root, np.stack(f[:-1], 1).astype(np.int64).view(np.uint64), least)
        yield from _linked(a, forest(pairs, root, similar([np.frombuffer(x, np.uint64) for x in f[-1]], least)))

    return _groups(rows, group, ["h", "node", "m", "root", *_LANES, "hashes"], "a long, b long")


def _node(text):
    return F.xxhash64(text)


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A table of ``WANTED`` bits of the nodes v; longs are combined by task and then by key, at most 2 MB."""
    v = nodes.select(F.col("v").bitwiseAND(F.lit((1 << WANTED) - 1)).alias("v"))
    one = F.expr("shiftleft(1L, cast(v & 63 as int))")
    got = v.select(F.shiftright("v", 6).cast("int").alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros((1 << WANTED) // 64, np.int64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return table


def _of(docs: DataFrame, nodes: DataFrame, words: int, text_col: str, columns: str, of) -> DataFrame:
    """(node, ...): ``of(sets) -> arrays`` of the texts that are among ``nodes``, and of some others; one row a node."""
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))

    def run(batches):
        wanted = shared.value
        for b in batches:
            x = b.column("node").to_numpy()
            low = x & ((1 << WANTED) - 1)
            some = b.filter(pa.array((wanted[low >> 6] >> (low & 63)) & 1 == 1))
            for at in range(0, some.num_rows, 128):
                part = some.slice(at, 128)
                yield pa.record_batch({"node": part.column("node")} | of([shingles(t, words) for t in part.column("text").to_pylist()]))

    text = _binary(docs, text_col)
    return docs.select(_node(text).alias("node"), text.alias("text")).mapInArrow(tidy(run), f"node long, {columns}").dropDuplicates(["node"])


def fingerprints(docs: DataFrame, nodes: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, n, f0, f1, ...): the wide fingerprints of ``nodes``."""

    def of(sets):
        lanes = np.array([wide_fingerprint(h, LANES) for h in sets], np.int64).reshape(-1, LANES)
        return {"n": pa.array([len(h) for h in sets], pa.int64())} | {f"f{i}": pa.array(lanes[:, i]) for i in range(LANES)}

    return materialise(_of(docs, nodes, words, text_col, "n long" + "".join(f", f{i} long" for i in range(LANES)), of), "near-fingerprints")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, hashes): the whole sets of ``nodes``."""
    return materialise(_of(docs, nodes, words, text_col, "hashes binary", lambda sets: {"hashes": pa.array([h.tobytes() for h in sets], pa.binary())}), "near-sets")


def _near(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near."""
    side = lambda of: prints.select(F.col("node").alias(of), *[F.col(c).alias(f"{of}_{c}") for c in prints.columns if c != "node"])
    apart = sum((F.bit_count(F.col(f"a_f{i}").bitwiseXOR(F.col(f"b_f{i}"))) for i in range(LANES)), F.lit(0))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    if least >= 0.8:
        near = near.where((apart <= RADIUS) | (F.least("a_n", "b_n") < SURE))
    return materialise(near.select("a", "b"), "near-survivors")


def _verified(near: DataFrame, docs: DataFrame, words: int, least: float, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def verify(batches):
        for b in batches:
            same = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both + SLACK >= least * (len(x) + len(y) - both))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    sets = _sets(docs, near.select(F.explode(F.array("a", "b")).alias("v")), words, text_col)
    full = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return materialise(full.select("a", "b", "x", "y").mapInArrow(tidy(verify), "a long, b long"), "near-links")


def classes(docs: DataFrame, words: int = 5, least: float = 0.8, small: int = 8, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), first (the component's least doc_id and its digest), a row for each input row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(commonness(docs, words, sample, text_col))
    text = _binary(docs, text_col)

    def run(batches):
        common, times = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                sets = [shingles(t, words) for t in b.column("text").to_pylist()]
                first = [prefix(h, common, times, least) for h in sets]
                long = np.array([len(x) for x in first])
                place = np.arange(long.sum()) - np.repeat(long.cumsum() - long, long)
                yield pa.record_batch({
                    "h": pa.array(np.concatenate(first).view(np.int64)), "node": pa.array(np.repeat(b.column("node").to_numpy(), long)),
                    "m": pa.array((np.repeat(np.array([len(h) for h in sets]), long) << 32) + place),
                })

    rows = docs.select(_node(text).alias("node"), text.alias("text")).mapInArrow(tidy(run), "h long, node long, m long")
    found = materialise(_candidates(rows, least, small), "near-candidates")
    release(spark)
    counted = found.where("m <= 0").groupBy("a", "b").agg(F.count_if(F.col("m") < 0).alias("shared"), F.max(-F.col("m")).alias("needed"), F.bool_or(F.col("m") == 0).alias("large"))
    pairs = materialise(counted.where("large or shared >= needed").select("a", "b"), "near-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("v")).unionByName(found.where("m > 0").select(F.col("a").alias("v")))
    prints = fingerprints(docs, nodes, words, text_col)
    links = _verified(_near(pairs, prints, least), docs, words, least, text_col)
    roots = components(links)
    release(spark)
    large = found.where("m > 0").select("h", F.col("a").alias("node"), "m").join(roots, F.col("node") == F.col("v"), "left").select("h", "node", "m", F.coalesce("root", "node").alias("root")).join(prints.drop("n"), "node")
    across = materialise(_across(large, least).distinct(), "near-across")
    if not across.isEmpty():
        crowds = components(across).select(F.col("v").alias("node"), F.col("root").alias("h"))
        sets = _sets(docs, crowds.select(F.col("node").alias("v")), words, text_col)
        own = roots.select(F.col("v").alias("node"), "root")
        whole = crowds.join(prints, "node").join(sets, "node").join(own, "node", "left")
        whole = whole.withColumn("m", F.shiftleft("n", 32)).withColumn("root", F.coalesce("root", "node")).drop("n")
        roots = components(links.unionByName(_links_across(whole, least)))
    table = docs.select(docs[id_col].alias("doc_id"), F.sha2(text, 256).alias("digest"), _node(text).alias("node"))
    named = table.join(roots, F.col("node") == F.col("v"), "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "near-roots")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("first"))
    return named.join(first, "root").select("doc_id", "digest", "first")


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of its component, with all their columns."""
    found = classes(docs, words, least, id_col=id_col, text_col=text_col)
    own, lost_id, lost_digest = fresh(docs, "digest"), fresh(docs, "lost_id"), fresh(docs, "lost_digest")
    lost = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))))
    lost = if_small(materialise(lost.select(F.col("doc_id").alias(lost_id), F.col("digest").alias(lost_digest)).distinct(), "near-lost"))
    marked = docs.withColumn(own, F.sha2(_binary(docs, text_col), 256))
    kept = marked.join(lost, (F.col(own) == F.col(lost_digest)) & marked[id_col].eqNullSafe(F.col(lost_id)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
