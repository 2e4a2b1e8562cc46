"""Exact deduplication with a log-structured merge index of text digests.

Rows arrive in the scan's tasks and fill *memtables*: the next ``memtable_rows`` rows of every task are one. A
memtable is flushed as a *run*, one row per digest, sorted by digest, with a Bloom filter beside it. Before it joins the
index its digests are looked up there: a run's filter is asked first and only what passes is searched
in the run's rows. A level that holds ``fanout`` runs is compacted into one run of the next level, which keeps
one identifier (and the sizes) for each digest. Digests met more than once (*hits*) are verified on the bytes of the
texts before anything is dropped. What is no hit is never looked up again.

Everything is DataFrame code. No step gathers the rows of one digest in one task: counts and extremes are combined
before the shuffle, and rows are joined to hits by broadcast where the hits are counted to be few; where they are
not, the digests that hold more than a 1,024th of all rows (so 1,024 at most) are, and only the others are dealt out.

Edge cases: null text counts as the empty text and empty texts form a group; a
null identifier never represents a group that has another one; of repeated rows
(same identifier, same text) exactly one is kept; an empty table gives an empty
result; other columns of the input may have any name and type, and so may identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.llm.common import fresh, if_small, materialise, scratch_path

#: Bits of a run's filter for each of its digests, at least.
FILTER_BITS = 16
#: The part of all rows that a digest must hold to be broadcast by itself.
HOT = 1024


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _place(words: int) -> dict[str, Column]:
    """Where a digest's bit is in a filter of so many words."""
    h = F.xxhash64("digest")
    return {"word": F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), "bit": F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))")}


class Run:
    """Sorted rows (digest, keep_id, size) in the shared folder, and their filter (word, bits)."""

    def __init__(self, rows: DataFrame, level: int):
        spark, path = rows.sparkSession, scratch_path(rows.sparkSession, f"lsm-run-l{level}")
        rows.sortWithinPartitions("digest").write.parquet(path)
        self.rows = spark.read.schema(rows.schema).parquet(path)
        self.words = 1 << max(0, (self.rows.count() * FILTER_BITS // 64).bit_length())
        placed = self.rows.select("digest").withColumns(_place(self.words))
        self.filter = materialise(placed.groupBy("word").agg(F.bit_or("bit").alias("bits")), "lsm-filter")

    def holds(self, digests: DataFrame) -> DataFrame:
        """Those of ``digests`` (distinct) that are in the run."""
        asked = digests.select("digest").withColumns(_place(self.words))
        passed = asked.join(self.filter, "word").where(F.col("bit").bitwiseAND(F.col("bits")) != 0).select("digest")
        return passed.join(self.rows.select("digest"), "digest", "left_semi")


class LsmDigestIndex:
    """Runs in the shared folder, merged level by level.

    ``keep`` names which identifier stands for a digest. ``fanout`` is how many
    runs a level may hold before they are merged into one run of the next.
    """

    def __init__(self, keep: str = "smallest", fanout: int = 4):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep must be 'smallest' or 'largest'")
        self.best = F.min if keep == "smallest" else F.max
        self.fanout = fanout
        self.levels: list[list[Run]] = []
        self.met: list[DataFrame] = []

    def combined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("size").alias("size"))

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def flush(self, memtable: DataFrame) -> None:
        """Write a memtable (digest, keep_id, size) as a run, noting which digests have been met before."""
        run = Run(self.combined(memtable), 0)
        self.met += [run.rows.where("size > 1").select("digest")] + [materialise(old.holds(run.rows), "lsm-met") for old in self.runs()]
        self._add(run, 0)

    def _add(self, run: Run, level: int) -> None:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int = 0) -> None:
        """Merge the runs of ``level`` into one run of the next."""
        runs, self.levels[level] = self.levels[level], []
        merged = runs[0].rows
        for run in runs[1:]:
            merged = merged.unionByName(run.rows)
        self._add(Run(self.combined(merged), level + 1), level + 1)

    def probe(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id, size) of those distinct digests of ``rows`` that the index holds."""
        asked, found = rows.select("digest").distinct(), None
        for run in self.runs():
            hit = run.rows.join(run.holds(asked), "digest", "left_semi")
            found = hit if found is None else found.unionByName(hit)
        if found is None:
            return asked.select("digest", F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("size")).limit(0)
        return self.combined(found)

    def hits(self) -> DataFrame | None:
        """(digest, keep_id, size) of the digests met more than once."""
        if not self.met:
            return None
        met = self.met[0]
        for more in self.met[1:]:
            met = met.unionByName(more)
        met = if_small(materialise(met.distinct(), "lsm-hits"))
        found = None
        for run in self.runs():
            own = run.rows.join(met, "digest", "left_semi")
            found = own if found is None else found.unionByName(own)
        return materialise(self.combined(found), "lsm-found")


class Hits:
    """The digests that occur more than once, joined to rows without gathering a digest's rows."""

    def __init__(self, table: DataFrame, total: int):
        self.table, small = table, if_small(table)
        hot = table.where(F.col("size") > total / HOT)
        self.parts = [(None, small)] if small is not table else [(None, F.broadcast(hot)), (F.broadcast(hot.select("digest")), table.where(F.col("size") <= total / HOT))]

    def join(self, rows: DataFrame) -> DataFrame:
        """The rows of the hits, with keep_id and size."""
        out = None
        for without, hits in self.parts:
            left = rows if without is None else rows.join(without, "digest", "left_anti")
            part = left.join(hits, "digest")
            out = part if out is None else out.unionByName(part)
        return out

    def without(self, rows: DataFrame) -> DataFrame:
        """The rows of no hit."""
        for _, hits in self.parts:
            rows = rows.join(hits, "digest", "left_anti")
        return rows


def _digested(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))


def _collisions(rows: DataFrame, hits: Hits) -> DataFrame:
    """Digests of ``hits`` whose texts are not all the same bytes.

    The smallest and the largest text of a digest are equal only if all are;
    a task finds its own first, so copies of one text are combined where they lie.
    """
    ends = hits.join(rows).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("digest", "part").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    ends = ends.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.where(F.col("lo") != F.col("hi")).select("digest")


def _classes(docs: DataFrame, keep: str, id_col: str, text_col: str, digest, normalise, memtable_rows: int, fanout: int) -> tuple[DataFrame, Hits]:
    """The rows' log (doc_id, digest) and the hits among them, after byte verification."""
    rows = _digested(docs, id_col, text_col, digest, normalise)
    arrival = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / memtable_rows).cast("int")
    log, hits = _indexed(rows.select("doc_id", "digest", arrival.alias("memtable")), keep, fanout)
    wrong = materialise(_collisions(rows, hits), "lsm-collisions")
    if not wrong.isEmpty():
        longer = F.when(F.col("w").isNotNull(), F.concat(F.col("digest"), F.lit("/"), F.sha2(F.col("text").cast("binary"), 512))).otherwise(F.col("digest"))
        rows = rows.join(wrong.withColumn("w", F.lit(1)), "digest", "left").withColumn("digest", longer)
        log, hits = _indexed(rows.select("doc_id", "digest", arrival.alias("memtable")), keep, fanout)
    return log, hits


def _indexed(log: DataFrame, keep: str, fanout: int) -> tuple[DataFrame, Hits]:
    log = materialise(log, "lsm-log", "memtable")
    total, last = log.agg(F.count("*"), F.max("memtable")).head()
    index = LsmDigestIndex(keep, fanout)
    one = log.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("size"), "memtable")
    for m in range((-1 if last is None else last) + 1):
        index.flush(one.where(F.col("memtable") == m).drop("memtable"))
    found = index.hits()
    return log.select("doc_id", "digest"), Hits(index.combined(one).limit(0) if found is None else found, total)


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, normalise: Callable[[Column], Column] | None = None, memtable_rows: int = 4096, fanout: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    log, hits = _classes(docs, keep, id_col, text_col, digest, normalise, memtable_rows, fanout)
    alone = hits.without(log).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")
    copies = hits.join(log).withColumn("best", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = F.row_number().over(W.partitionBy("digest").orderBy(F.lit(0))) == 1
    best = copies.where("best").withColumn("kept", first)
    others = copies.where("not best").withColumn("kept", F.lit(False))
    return alone.unionByName(best.unionByName(others).select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", "digest"))


def drop_exact_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 4096, fanout: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one per distinct text."""
    log, hits = _classes(docs, keep, id_col, text_col, sha256, None, memtable_rows, fanout)
    copies = hits.join(log).withColumn("best", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    own, lost_id, lost_digest = fresh(docs, "digest"), fresh(docs, "lost_id"), fresh(docs, "lost_digest")
    # what goes is looked up, not what stays: the texts themselves are not dealt out where the list is small
    lost = copies.where("not best").select(F.col("doc_id").alias(lost_id), F.col("digest").alias(lost_digest)).distinct()
    tied = materialise(copies.where("best").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias(own)), "lsm-ties")
    marked = docs.withColumn(own, sha256(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    lost = if_small(materialise(lost, "lsm-lost"))
    kept = marked.join(lost, (F.col(own) == F.col(lost_digest)) & marked[id_col].eqNullSafe(F.col(lost_id)), "left_anti")
    if not tied.isEmpty():
        once = kept.join(if_small(tied), own, "left_semi").dropDuplicates([own])
        kept = kept.join(if_small(tied), own, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
