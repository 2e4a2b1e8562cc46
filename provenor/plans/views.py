"""The provided tables as the model's inputs, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, AS_OF_LINES = "2024-02-01 00:00:00", "2002-01-01 00:00:00"
_PREDICATE = {"view": "shares_analytics_id", "click": "shares_favicon", "purchase": "seller_of", "signup": "registrant", "error": "contradicts"}
_COLLECTOR = {"view": "analytics_ids", "click": "favicon_hash", "purchase": "ads_txt_owner", "signup": "rdap", "error": "negative_check"}
_TIERS = (1.0, 0.85, 0.65, 0.4, 0.2)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(of: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(of == k, v) if out is None else out.when(of == k, v)
    return out


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def claims_events(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    user, thing = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("-d"), day)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("claim_pos"), (day if by_day else F.lit("all")).alias("case_ref"),
        F.lit("handle").alias("subject_kind"), user.alias("subject_value"), F.concat(F.lit("handle:"), user).alias("subject_key"),
        _case(F.col("event_type"), _PREDICATE).alias("predicate"),
        F.lit("service_id").alias("object_kind"), thing.alias("object_value"), F.concat(F.lit("service_id:"), thing).alias("object_key"),
        _case(F.col("event_type"), _COLLECTOR).alias("collector"), F.concat(F.lit("https://source.example/"), F.col("event_id").cast("string")).alias("source_url"),
        F.element_at(F.array(*[F.lit(t) for t in _TIERS]), (F.col("event_id") % 5 + 1).cast("int")).alias("reliability"),
        F.when(F.col("value") < 1, 0.0).otherwise(1.0).alias("weight"), ts.alias("observed_at"), ts.alias("retrieved_at"),
        F.concat("event_type", F.lit("|u"), F.col("user_id").cast("string")).alias("correlation_group"), F.lit("").alias("dependence_class"), F.lit(None).cast("string").alias("raw"),
    )


def _when(of: str, table: dict) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


SQL_CLAIMS = f"""claims AS (
  SELECT event_id AS claim_pos, strftime(ts, '%Y%m%d') AS day, 'handle:u' || user_id AS subject_key,
    'service_id:k' || json_extract_string(props, '$.k') || '-d' || strftime(ts, '%Y%m%d') AS object_key,
    {_when("event_type", _PREDICATE)} AS predicate, {_when("event_type", _COLLECTOR)} AS collector, event_type, user_id,
    event_type || '|u' || user_id AS gkey, (CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 WHEN 3 THEN 0.4 ELSE 0.2 END)::DOUBLE AS reliability,
    (CASE WHEN value < 1 THEN 0 ELSE 1 END)::DOUBLE AS weight, ts FROM events)"""
SQL_HOLDERS = "h AS (SELECT object_key, count(DISTINCT subject_key) + 1 AS holders FROM claims GROUP BY 1)"
SQL_EVIDENCE = f"""e AS (
  SELECT c.*, h.holders, CASE WHEN weight <= 0 THEN 0.0 WHEN predicate = 'contradicts' THEN -reliability * weight * 4.0
    ELSE reliability * weight * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 8.64e10 /
      CASE predicate WHEN 'shares_analytics_id' THEN 545 WHEN 'shares_favicon' THEN 365 WHEN 'seller_of' THEN 1095 ELSE 730 END)
      * ln(1.0 / greatest((holders - 1 + 0.5) / (1000000 + 0.5 * 2), 1e-6)) END AS llr
  FROM claims c JOIN h USING (object_key))"""


def sql_pairs(case: str = "'all'") -> str:
    """The chain from claims to assessments; ``case`` is the case's expression."""
    return f"""{SQL_CLAIMS}, {SQL_HOLDERS}, {SQL_EVIDENCE},
f AS (SELECT object_key, min(claim_pos) AS o FROM e GROUP BY 1), u AS (SELECT DISTINCT object_key, subject_key FROM e),
r AS (SELECT l.subject_key AS a, m.subject_key AS b, l.object_key FROM u l JOIN u m USING (object_key) WHERE l.subject_key < m.subject_key),
x AS (SELECT {case} AS case_ref, a, b, 1 AS arm, o, claim_pos AS pos, gkey, event_type, llr, predicate <> 'shares_favicon' AS sub FROM r JOIN e ON e.object_key = r.object_key AND (e.subject_key = a OR e.subject_key = b) JOIN f ON f.object_key = r.object_key
  UNION ALL SELECT {case}, least(subject_key, object_key), greatest(subject_key, object_key), 0, 0, claim_pos, gkey, event_type, llr, predicate <> 'shares_favicon' FROM e),
g AS (SELECT case_ref, a, b, gkey, CASE any_value(event_type) WHEN 'view' THEN 'site_setup' WHEN 'click' THEN 'site_setup' WHEN 'purchase' THEN 'monetization_setup' WHEN 'signup' THEN 'registration' ELSE 'unknown' END AS class,
  CASE WHEN count(*) FILTER (llr > 0) > 0 THEN least(max(llr) FILTER (llr > 0) + ln(count(*) FILTER (llr > 0)), 8.0) ELSE 0.0 END + coalesce(sum(llr) FILTER (llr < 0), 0.0) AS llr, bool_or(sub) AS sub, min({{'arm': arm, 'o': o, 'pos': pos}}) AS ord FROM x GROUP BY 1, 2, 3, 4),
k0 AS (SELECT case_ref, a, b, class, count(*) AS n, sum(llr) AS raw, first(llr ORDER BY abs(llr) DESC, ord) AS top, CASE WHEN bool_or(sub AND llr <> 0) THEN 1 ELSE 0 END AS lines, min(ord) AS ord FROM g GROUP BY 1, 2, 3, 4),
k AS (SELECT *, CASE WHEN n = 1 THEN raw ELSE top + (CASE class WHEN 'site_setup' THEN 0.25 WHEN 'monetization_setup' THEN 0.30 WHEN 'registration' THEN 0.15 ELSE 0.20 END) * (raw - top) END AS adjusted FROM k0),
p0 AS (SELECT case_ref, a, b, ln(1e-5) + sum(adjusted) AS log_odds, sum(lines)::BIGINT AS independent_groups, min(ord) AS ord FROM k GROUP BY 1, 2, 3),
p1 AS (SELECT *, 1 / (1 + exp(-log_odds)) AS probability FROM p0),
p AS (SELECT *, CASE WHEN probability >= 0.95 AND independent_groups >= 2 THEN 'STRONG_EVIDENCE' WHEN probability >= 0.8 AND independent_groups >= 2 THEN 'MODERATE_EVIDENCE' WHEN probability >= 0.55 AND independent_groups >= 2 THEN 'LIMITED_EVIDENCE' WHEN probability >= 0.2 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS band FROM p1)"""


def claims_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".example")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ts = F.col("l_shipdate").cast("timestamp")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_pos"), F.lit("all").alias("case_ref"), F.lit("domain").alias("subject_kind"), s.alias("subject_value"), F.concat(F.lit("domain:"), s).alias("subject_key"),
        F.lit("shares_analytics_id").alias("predicate"), F.lit("analytics_id").alias("object_kind"), p.alias("object_value"), F.concat(F.lit("analytics_id:"), p).alias("object_key"),
        F.lit("analytics_ids").alias("collector"), F.lit("").alias("source_url"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.65).otherwise(0.4).alias("reliability"), F.lit(1.0).alias("weight"),
        ts.alias("observed_at"), ts.alias("retrieved_at"), F.concat("l_linestatus", F.lit("|s"), F.col("l_suppkey").cast("string")).alias("correlation_group"), F.lit("").alias("dependence_class"), F.lit(None).cast("string").alias("raw"),
    )


def claims_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registrant and a legal name for each customer; the segments are held by very many."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    user = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    rows = F.array(
        F.struct(F.lit(0).alias("i"), F.lit("registrant").alias("predicate"), F.lit("org_name").alias("object_kind"), F.col("c_mktsegment").alias("object_value"), F.lit(0.65).alias("reliability")),
        F.struct(F.lit(1).alias("i"), F.lit("legal_name").alias("predicate"), F.lit(None).cast("string").alias("object_kind"), F.col("c_name").alias("object_value"), F.lit(1.0).alias("reliability")),
        F.struct(F.lit(2).alias("i"), F.lit("incorporated_in").alias("predicate"), F.lit(None).cast("string").alias("object_kind"), F.col("n_name").alias("object_value"), F.lit(0.85).alias("reliability")),
    )
    x = c.select("c_custkey", user.alias("user"), F.explode(rows).alias("x")).select("c_custkey", "user", "x.*")
    return x.select(
        (F.col("c_custkey") * 3 + F.col("i")).alias("claim_pos"), F.lit("all").alias("case_ref"), F.lit("handle").alias("subject_kind"), F.col("user").alias("subject_value"), F.concat(F.lit("handle:"), "user").alias("subject_key"),
        "predicate", "object_kind", "object_value", F.when(F.col("object_kind").isNotNull(), F.concat_ws(":", "object_kind", "object_value")).alias("object_key"),
        F.lit("rdap").alias("collector"), F.lit("").alias("source_url"), "reliability", F.lit(1.0).alias("weight"), as_of().alias("observed_at"), as_of().alias("retrieved_at"),
        F.concat(F.lit("rdap|"), "user").alias("correlation_group"), F.lit("").alias("dependence_class"), F.lit(None).cast("string").alias("raw"),
    )


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    p = (F.col("n_chars") % 1000) / 1000.0
    q = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return marks.join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("a"), F.lit("b").alias("b"), (F.col("quality") == 1).alias("label"), p.alias("predicted"), F.ln(q / (1 - q)).alias("log_odds"),
        F.lit("").alias("band"), F.col("lang").alias("label_source"), F.col("source").alias("case_ref"),
    )


SQL_LABELLED = """l AS (SELECT doc_id::VARCHAR AS a, quality = 1 AS label, (n_chars % 1000) / 1000.0::DOUBLE AS predicted, source AS case_ref FROM labels JOIN documents USING (doc_id))"""


def captures_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages: a hundred to a case."""
    m = F.col("page_id") % 10
    return read(spark, sf_dir, "pages").select(
        F.concat(F.lit("case"), F.floor(F.col("page_id") / 100).cast("string")).alias("case_ref"), (F.col("page_id") % 100 + 1).alias("sequence"), "url", F.lit("GET").alias("method"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("requested_at"),
        F.when(m == 7, 404).when(m == 8, 503).otherwise(200).alias("status"), F.when(m == 9, F.lit("")).otherwise(F.col("html")).cast("binary").alias("body"), F.lit("pages").alias("collector"), F.col("page_id"),
    )
