"""Claims as they arrive: running holders and re-scoring of what they touch. An extension of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_holders(stream: DataFrame) -> DataFrame:
    """(key, holders) in update mode: a subject counts once for an object, however often it claims it."""
    own = F.max((F.col("subject_key") == F.col("object_key")).cast("bigint"))
    once = stream.where("object_kind is not null").dropDuplicates(["object_key", "subject_key"])
    return once.groupBy(F.col("object_key").alias("key")).agg((F.count("*") + 1 - own).alias("holders"))


def windowed_counts(stream: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Claims by predicate and window of retrieval; late ones count until the watermark has passed."""
    return stream.withWatermark("retrieved_at", lateness).groupBy(F.window("retrieved_at", width), "predicate").agg(F.count("*").alias("claims"))


def rescore(stream: DataFrame, history: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch: score again the claims of every object and subject that the batch touches."""

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.select("object_key").where("object_key is not null").distinct()
        near = history().join(touched, "object_key", "left_semi")
        write(score(near), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
