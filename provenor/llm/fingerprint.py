"""Homomorphic multiset fingerprints of documents.

A fingerprint is a vector of numbers modulo 2^60, the sum of one vector for each
paragraph of the text. Sums do not depend on order; adding or subtracting a
paragraph's vector inserts or deletes it without reading the rest.

* EXACT lanes add hashes of whole paragraphs (lines), each lane with a seed of its own. They decide equality.
* LIKENESS lanes add, for each piece of a paragraph (a line, split after sentence marks,
  commas, semicolons and bars; no piece spans lines), 60 bits of its hash, three 20-bit counters to a
  number. Twice a counter less the number of pieces is a sum of random signs, so
  the squared distance of two vectors estimates how many pieces differ.

Blank paragraphs add nothing: the empty text has the zero vector. Texts whose
paragraphs are the same multiset have equal fingerprints. Beyond 2^20 pieces
in one text counters carry into their neighbours: equality still holds, likeness
becomes rough.

All of it is SQL expressions. The only text that is shuffled is each document
once, and to its predecessor the head that replaces its tail.

Edge cases: null text counts as empty. Rows of one identifier (repeated rows) stand
at one place in the order; their successor is the next identifier's smallest
text. A null identifier stands before all others; identifiers that are not integers stand in the order of their hashes. A single document is its own
successor. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.llm.common import order_key, partitions

EXACT, LIKENESS = 4, 20
#: Counters of 20 bits, three in a number of 60 bits.
LANES = 3 * LIKENESS
MODULUS_MASK = (1 << 60) - 1
COUNTERS_MASK = 1 | 1 << 20 | 1 << 40
COUNTER_MASK = (1 << 20) - 1
#: Where a line is cut into pieces.
PIECE_END = r"(?<=[.!?,;|])\s+"
#: The order of identifiers is found in that many ranges at most, one task each.
RANGES = 64


def with_vectors(df: DataFrame, **texts: str) -> DataFrame:
    """Add, for each ``name=text column``, the text's vector: EXACT sums, LIKENESS sums, the number of pieces.

    The lines and the hashes are columns of projections of their own: they are used by all the
    sums, and only a column is sure to be computed once.
    """

    def total(values, of) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: (acc + of(x)).bitwiseAND(F.lit(MODULUS_MASK)))

    def filled(parts: Column) -> Column:
        return F.filter(parts, lambda p: p != "")

    lines = {f"__{n}_lines": filled(F.split(t, "\n")) for n, t in texts.items()}
    pieces = {f"__{n}_pieces": F.transform(filled(F.flatten(F.transform(f"__{n}_lines", lambda p: F.split(p, PIECE_END)))), lambda p: F.xxhash64(F.lit(EXACT), p)) for n in texts}
    sums = {}
    for n in texts:
        # a hash's first argument seeds that of the second
        exact = [total(f"__{n}_lines", lambda p, j=j: F.xxhash64(F.lit(j), p).bitwiseAND(F.lit(MODULUS_MASK))) for j in range(EXACT)]
        like = [total(f"__{n}_pieces", lambda h, j=j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(COUNTERS_MASK))) for j in range(LIKENESS)]
        sums[n] = F.array(*exact, *like, F.size(f"__{n}_pieces").cast("bigint"))
    return df.withColumns(lines).withColumns(pieces).withColumns(sums).drop(*lines, *pieces)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector after inserting (or with sign -1 deleting) the paragraphs of ``b``."""
    b = b if sign > 0 else F.transform(b, lambda y: -y)
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS_MASK)))


def as_text(v: Column) -> Column:
    return F.concat_ws("", F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 15, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the squared distance over the squared lengths; 1 for equal vectors."""

    def signs(v: Column) -> Column:
        n = F.element_at(v, EXACT + LIKENESS + 1)
        lanes = [F.shiftrightunsigned(v[EXACT + i // 3], 20 * (i % 3)).bitwiseAND(F.lit(COUNTER_MASK)) for i in range(LANES)]
        return F.transform(F.array(*lanes), lambda c: (c * 2 - n).cast("double"))

    def squares(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)

    sa, sb = signs(a), signs(b)
    apart, both = squares(F.zip_with(sa, sb, lambda x, y: x - y)), squares(sa) + squares(sb)
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / both))


def successors(ids: DataFrame, key: str = "k") -> DataFrame:
    """(k, next_k) for each distinct k; the largest is followed by the smallest.

    Ranges of keys are cut at approximate quantiles. Within a range the next key is
    a window's lead; the last key of a range is followed by the first of the next
    range, of which the driver holds RANGES at most.
    """
    spark = ids.sparkSession
    ids = ids.select(F.col(key).alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10_000)).head()[0] or []
    cuts = sorted({int(c) for c in cuts})
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    placed = ids.distinct().withColumn("r", place)
    firsts = {r: k for r, k in placed.groupBy("r").agg(F.min("k")).collect()}
    order = sorted(firsts)
    after = {r: firsts[order[(i + 1) % len(order)]] for i, r in enumerate(order)}
    table = spark.createDataFrame(list(after.items()), "r int, after bigint")
    led = placed.withColumn("n", F.lead("k").over(W.partitionBy("r").orderBy("k")))
    return led.join(F.broadcast(table), "r").select("k", F.coalesce("n", "after").alias("next_k"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text's fingerprint vector and its 360-digit text form."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    out = with_vectors(docs.select(docs[id_col].alias("doc_id"), text.alias("__text")), vector="__text").drop("__text")
    return out.withColumn("fingerprint", as_text(F.col("vector")))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text and the vectors of both and of its successor.

    The edited text has the last quarter of its code points (rounded down) replaced
    by as many from the start of the successor, or by all it has.
    """
    spark = docs.sparkSession
    base = docs.select(order_key(docs, id_col).alias("k"), docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # vectors before the exchange, which both uses share because both ask for all its columns
    dealt = with_vectors(base, vector="text").repartition(partitions(spark), "k")
    ids = base.select("k", F.length("text").alias("n"))
    wanted = ids.groupBy("k").agg(F.max("n").alias("n")).join(successors(ids), "k").select(F.col("k").alias("asker"), "next_k", F.floor(F.col("n") / 4).cast("int").alias("q"))
    firsts = dealt.groupBy("k").agg(F.min(F.struct("text", "vector", "doc_id")).alias("x"))
    heads = firsts.join(wanted, firsts["k"] == wanted["next_k"]).select("asker", F.substring(F.col("x.text"), F.lit(1), F.col("q")).alias("head"), F.col("x.vector").alias("next_vector"))
    both = dealt.join(heads, dealt["k"] == heads["asker"])
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("head"), F.lit(1), q))
    return with_vectors(both.select("doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "vector", "next_vector"), edited_vector="edited")
