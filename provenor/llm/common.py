"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.scratch import scratch_dir


#: Where a null identifier stands in the order of identifiers.
NULL_ID = -(2**63)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def if_small(table: DataFrame, rows: int = 250_000) -> DataFrame:
    """A written table, to be broadcast if it has been counted to have so few (short) rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def tidy(run):
    """The Arrow function ``run``, giving the memory that its worker no longer uses back when a task ends.

    Workers live on over stages; without it what they once used adds up on an executor.
    """

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return inner


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that are written by now: Spark removes them when the JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(col: str = "text") -> Column:
    """Null text counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def order_key(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Identifiers as numbers to be ordered by: null before all, other types than integers by their hash."""
    c, kind = F.col(f"`{id_col}`"), docs.schema[id_col].dataType.typeName()
    own = c.cast("bigint") if kind in ("byte", "short", "integer", "long") else F.xxhash64(c.cast("string"))
    return F.when(c.isNull(), F.lit(NULL_ID)).otherwise(own)


def bounded_sample(rows: DataFrame, stratum: str, cap: int, seed: int) -> DataFrame:
    """About ``cap`` rows of each value of ``stratum``, in a column ``place`` the order they may be sorted by.

    A row is taken if the hash of all its columns is small, rows that are the same count once; so
    the sample is the same in every run. The strata are counted first; the share that a stratum may keep
    is a literal, so no window or sort gathers a stratum. That a stratum has over twice ``cap`` rows has no
    chance to speak of. For fitting classifiers only.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).agg(F.count("*")).collect() if r[0] is not None}
    place = F.xxhash64(*rows.columns, F.lit(seed))
    if not counts:
        return rows.withColumn("place", place).limit(0)
    shares = F.create_map(*[F.lit(x) for v, n in sorted(counts.items(), key=str) for x in (v, min(1.0, cap / n))])
    share = F.coalesce(F.try_element_at(shares, F.col(stratum)), F.lit(0.0))
    chosen = rows.withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) / float(1 << 30) < share)
    return chosen.dropDuplicates(["place"])


class Memo(dict):
    """A dict that computes missing values and is emptied when it has grown to ``limit``.

    For what is a function of the word alone; it bounds a Python worker's memory.
    """

    def __init__(self, of, limit: int = 300_000):
        self.of, self.limit = of, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.of(key)
        return value
