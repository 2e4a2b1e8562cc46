"""The library's queries over the provided tables, each with its SQL where SQL expresses it.

Doubles are rounded to six places on both sides: sums depend on their order in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import names as N
from provenor.functions import scoring as S
from provenor.functions import text as T
from provenor.operators import calibration as C
from provenor.operators import evidence as E
from provenor.operators import export as X
from provenor.operators import frontier as G
from provenor.operators import ingest as I
from provenor.operators import minimise as M
from provenor.operators import negative as A
from provenor.operators import provenance as P
from provenor.operators import resolution as R
from provenor.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


WITH = "WITH "
EV = WITH + V.SQL_CLAIMS


@query(f"{EV}, {V.SQL_HOLDERS} SELECT object_key AS key, holders::BIGINT AS holders FROM h")
def holders_exact(spark, sf):
    return E.holders(V.claims_events(spark, sf))


@query("WITH p AS (SELECT 'analytics_id:p' || l_partkey AS key, count(DISTINCT l_suppkey) + 1 AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), f AS (SELECT 'analytics_id:p' || l_partkey AS key, count(DISTINCT l_suppkey) + 1 AS n FROM lineitem GROUP BY 1) SELECT f.key, coalesce(p.n, f.n)::BIGINT AS holders FROM f LEFT JOIN p USING (key)")
def holders_composite(spark, sf):
    li = V.claims_lineitem(spark, sf)
    return E.composite_holders(E.holders(li.where("reliability = 1.0")), E.holders(li))


@query(f"{EV}, {V.SQL_HOLDERS}, {V.SQL_EVIDENCE} SELECT claim_pos, holders::BIGINT AS holders, round(llr, 6) AS llr FROM e")
def selectivity_llr(spark, sf):
    c = V.claims_events(spark, sf)
    return E.with_evidence(c, E.holders(c), V.as_of(), ascii_only=True).select("claim_pos", "holders", r6("llr"))


@query(f"SELECT l_orderkey * 8 + l_linenumber AS claim_pos, round(pow(0.5, greatest(epoch_us(TIMESTAMP '{V.AS_OF_LINES}') - epoch_us(l_shipdate), 0) / 8.64e10 / 545), 6) AS decay FROM lineitem")
def decay_by_predicate(spark, sf):
    c = V.claims_lineitem(spark, sf)
    return c.select("claim_pos", F.round(S.decay(F.col("predicate"), F.col("observed_at"), V.as_of(V.AS_OF_LINES)), 6).alias("decay"))


#: Days, written out here again so that a value that slips elsewhere is seen.
_HALF_LIVES = """h(predicate, days) AS (VALUES ('same_as', NULL), ('shares_analytics_id', 545), ('shares_gravatar', 1095), ('shares_cert', 365), ('shares_favicon', 365), ('co_hosted', 180),
  ('commit_email', 1095), ('key_binding', 1460), ('profile_binding', 730), ('registrant', 730), ('owner_domain', 1095), ('manager_domain', 730), ('seller_of', 1095), ('legal_name', NULL),
  ('incorporated_in', NULL), ('registered_address', 1460), ('officer_of', 1825), ('beneficial_owner_of', 1825), ('parent_of', 1825), ('employed_by', 730), ('operates', 730), ('timezone_hint', 365), ('contradicts', 730))"""


@query(f"WITH {_HALF_LIVES} SELECT n_nationkey, predicate, round(CASE WHEN days IS NULL THEN 1.0 ELSE pow(0.5, n_nationkey * 100.0 / days) END, 6) AS decay FROM nation, h")
def decay_every_predicate(spark, sf):
    n = V.read(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(x) for x in K.PREDICATES])).alias("predicate"))
    observed = V.as_of() - F.make_dt_interval(F.col("n_nationkey").cast("int") * 100)
    return n.select("n_nationkey", "predicate", F.round(S.decay(F.col("predicate"), observed, V.as_of()), 6).alias("decay"))


@query("SELECT event_id, lower(event_type) || '|u' || user_id AS gkey FROM events")
def canonical_group(spark, sf):
    noisy = F.concat(F.lit(" "), F.upper("event_type"), F.lit("|U"), F.col("user_id").cast("string"), F.lit("|"), (F.col("event_id") % 1000).cast("string"))
    return V.read(spark, sf, "events").select("event_id", S.canonical_group(noisy).alias("gkey"))


@query(f"{EV} SELECT DISTINCT event_type, CASE event_type WHEN 'view' THEN 'site_setup' WHEN 'click' THEN 'site_setup' WHEN 'purchase' THEN 'monetization_setup' WHEN 'signup' THEN 'registration' ELSE 'unknown' END AS class FROM claims")
def classify_group(spark, sf):
    c = V.claims_events(spark, sf)
    return c.select(F.split_part("correlation_group", F.lit("|"), F.lit(1)).alias("event_type"), S.classify_group(F.col("correlation_group"), F.col("collector")).alias("class")).distinct()


_CUSTOMER = """c AS (SELECT c_custkey * 3 + i AS claim_pos, 'handle:c' || c_custkey AS s, CASE i WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE n_name END AS v, i
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1), (2)) t(i))"""


@query(f"""WITH {_CUSTOMER}, n AS (SELECT claim_pos, i, CASE WHEN i = 0 THEN 1 + count(*) OVER (PARTITION BY v, i ORDER BY claim_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS holders_before FROM c)
SELECT claim_pos, CASE WHEN holders_before > 250 THEN 'demote' ELSE 'keep' END AS verdict, holders_before::BIGINT AS holders_before FROM n""")
def ingest_demote_running(spark, sf):
    return I.verdicts(V.claims_customer(spark, sf)).select("claim_pos", "verdict", F.col("holders_before").cast("bigint").alias("holders_before"))


@query("""WITH x AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+') AS f FROM documents), u AS (SELECT doc_id, unnest(f) AS m, unnest(range(len(f))) AS i FROM x),
c AS (SELECT 100 + doc_id * 1000000 + i AS claim_pos, lower(m) AS m FROM u)
SELECT claim_pos::BIGINT AS claim_pos, m AS address, CASE WHEN list_contains(['admin','administrator','abuse','postmaster','hostmaster','webmaster','noreply','no-reply','donotreply','support','info','contact','sales','billing','help','security','dns','root','office','mail','legal','privacy','dpo','gdpr','team','hello','service','notifications'], split_part(m, '@', 1)) OR starts_with(m, 'noreply') THEN 'drop' WHEN row_number() OVER (PARTITION BY m ORDER BY claim_pos) > 250 THEN 'demote' ELSE 'keep' END AS verdict FROM c""")
def ingest_verdict(spark, sf):
    """Every address of every document."""
    mails = F.regexp_extract_all("text", F.lit("[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+"), F.lit(0))
    found = V.read(spark, sf, "documents").select("doc_id", F.posexplode(mails).alias("i", "mail"))
    c = found.select((F.lit(100) + F.col("doc_id") * 1_000_000 + F.col("i")).alias("claim_pos"), F.lit("email").alias("object_kind"), F.lower("mail").alias("object_value"), F.lit("commit_email").alias("predicate"))
    c = c.withColumns({"case_ref": F.lit("all"), "subject_key": F.concat(F.lit("handle:"), F.col("claim_pos").cast("string")), "object_key": F.concat_ws(":", "object_kind", "object_value")})
    return I.verdicts(c).select("claim_pos", F.col("object_value").alias("address"), "verdict")


@query(f"{EV} SELECT DISTINCT least(subject_key, object_key) AS a, greatest(subject_key, object_key) AS b FROM claims")
def pairs_direct(spark, sf):
    return E.direct_pairs(V.claims_events(spark, sf)).select("a", "b")


@query("WITH u AS (SELECT DISTINCT l_partkey AS o, 'domain:s' || l_suppkey || '.example' AS s FROM lineitem) SELECT x.s AS a, y.s AS b, count(*)::BIGINT AS objects FROM u x JOIN u y USING (o) WHERE x.s < y.s GROUP BY 1, 2")
def pairs_coreference(spark, sf):
    return E.coreference_pairs(V.claims_lineitem(spark, sf)).select("a", "b", "objects")


def _cells(spark, sf, level, *columns, by_day=False, floor=None):
    """Pairs of the events at one level of aggregation; only what they are asked for leaves their cells."""
    c = V.claims_events(spark, sf, by_day)
    return E.in_cells(c, V.as_of(), ascii_only=True, level=level, columns=list(columns), floor=floor)


def _banded(spark, sf, *columns, **how):
    return E.banded(_cells(spark, sf, "pair", *columns, "log_odds", "independent_groups", "definitional", **how))


def _by_case(spark, sf, floor):
    return _banded(spark, sf, "case_ref", "a", "b", "pair_ord", by_day=True, floor=floor)


def _scored(spark, sf, by_day=False):
    """All pairs of the events with all their columns."""
    return E.assess_pairs(V.claims_events(spark, sf, by_day), V.as_of(), ascii_only=True)


PAIRS = WITH + V.sql_pairs()


@query(f"{PAIRS} SELECT a, b, gkey, class, round(llr, 6) AS llr FROM g")
def group_aggregate(spark, sf):
    return _cells(spark, sf, "group", "a", "b", "gkey", "class", "llr").select("a", "b", "gkey", "class", r6("llr"))


@query(f"{PAIRS} SELECT a, b, class, n::BIGINT AS n_groups, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted FROM k")
def class_aggregate(spark, sf):
    return _cells(spark, sf, "class", "a", "b", "class", "n_groups", "raw", "adjusted").select("a", "b", "class", "n_groups", r6("raw"), r6("adjusted"))


@query(f"{PAIRS} SELECT a, b, independent_groups FROM p")
def independent_groups(spark, sf):
    return _cells(spark, sf, "pair", "a", "b", "independent_groups")


@query(f"{PAIRS} SELECT a, b, round(log_odds, 6) AS log_odds, round(probability, 6) AS probability, independent_groups, band FROM p")
def assess_pairs(spark, sf):
    return _banded(spark, sf, "a", "b").select("a", "b", r6("log_odds"), r6("probability"), "independent_groups", "band")


@query(f"{PAIRS}, t AS (SELECT a, b, gkey, llr, row_number() OVER (PARTITION BY a, b ORDER BY abs(llr) DESC, ord) AS place FROM g) SELECT a, b, place::INTEGER AS place, gkey, round(llr, 6) AS llr FROM t WHERE place <= 5")
def top_evidence(spark, sf):
    return _cells(spark, sf, "shown", "a", "b", "place", "gkey", "llr").select("a", "b", "place", "gkey", r6("llr"))


@query(f"{PAIRS} SELECT band, count(*)::BIGINT AS n FROM p GROUP BY 1")
def band_distribution(spark, sf):
    return _banded(spark, sf).groupBy("band").agg(F.count("*").alias("n"))


@query(f"{PAIRS} SELECT count(*)::BIGINT AS pairs, count(*) FILTER (band = 'STRONG_EVIDENCE')::BIGINT AS strong, count(*) FILTER (band = 'MODERATE_EVIDENCE')::BIGINT AS moderate FROM p")
def headline_counts(spark, sf):
    return X.headline(_banded(spark, sf))


@query(f"{EV} SELECT DISTINCT day AS case_ref, least(subject_key, object_key) AS a, greatest(subject_key, object_key) AS b FROM claims WHERE predicate = 'contradicts'")
def must_not_link(spark, sf):
    return R.forbidden_pairs(V.claims_events(spark, sf, True))


@query(f"{WITH}{V.sql_pairs('day')} SELECT case_ref, a, b, round(log_odds, 6) AS log_odds FROM p WHERE log_odds >= 2.197")
def mergeable_pairs(spark, sf):
    return R.mergeable(_by_case(spark, sf, K.MERGE_LOG_ODDS)).select("case_ref", "a", "b", r6("log_odds"))


@query(f"""WITH RECURSIVE {V.sql_pairs('day')}, m AS (SELECT case_ref, a, b FROM p WHERE log_odds >= 2.197 UNION SELECT case_ref, b, a FROM p WHERE log_odds >= 2.197),
w AS (SELECT case_ref, a AS key, a AS seen FROM m UNION SELECT w.case_ref, w.key, m.b FROM w JOIN m ON m.case_ref = w.case_ref AND m.a = w.seen)
SELECT case_ref, key, min(seen) AS component FROM w GROUP BY 1, 2""")
def connected_components(spark, sf):
    return R.components(R.mergeable(_by_case(spark, sf, K.MERGE_LOG_ODDS)))


def _case_identifiers(claims):
    ends = claims.select("case_ref", F.col("subject_key").alias("key"), F.col("subject_kind").alias("kind"), F.col("subject_value").alias("value"), "claim_pos").unionByName(claims.where("object_kind is not null").select("case_ref", F.col("object_key").alias("key"), F.col("object_kind").alias("kind"), F.col("object_value").alias("value"), "claim_pos"))
    return ends.groupBy("case_ref", "key").agg(F.first("kind").alias("kind"), F.first("value").alias("value"), F.min("claim_pos").alias("first_pos"))


@query()
def resolve_entities(spark, sf):
    c = V.claims_events(spark, sf, True)
    ents, _ = R.resolve(c, _by_case(spark, sf, R.INSIDE_LOG_ODDS), _case_identifiers(c))
    return ents.select("case_ref", "entity_id", "type", F.array_join("identifiers", " ").alias("identifiers"), r6("log_odds"))


@query()
def rejected_merges(spark, sf):
    c = V.claims_events(spark, sf, True)
    return R.rejected(R.merge(R.checkpointed(_by_case(spark, sf, K.MERGE_LOG_ODDS)), R.forbidden_pairs(c)))


@query("SELECT 'handle:c' || c_custkey AS cluster, c_name AS label, 2.0::DOUBLE AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entity_labels(spark, sf):
    c = V.claims_customer(spark, sf)
    members = _case_identifiers(c).where("kind = 'handle'").withColumn("cluster", F.col("key"))
    placed = c.withColumn("cluster", F.col("subject_key"))
    return R.entity_labels(members, placed).select("cluster", "label", "weight")


@query("SELECT 'handle:c' || c_custkey AS cluster, 'incorporated_in' AS predicate, n_name AS vals FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entity_attributes(spark, sf):
    c = V.claims_customer(spark, sf).withColumn("cluster", F.col("subject_key"))
    return R.entity_attributes(c).select("cluster", "predicate", F.array_join("vals", "|").alias("vals"))


_COVER = ", ".join(f"('{s}', {c})" for s, (c, _) in K.COVERAGE.items())
_ABSENCE = f"""WITH cov(source, c) AS (VALUES {_COVER}), kinds(kind, f) AS (VALUES ('not_checked', 0.0), ('checked_absent', 1.0), ('expected_absent', 1.5)),
y AS (SELECT source, kind, CASE WHEN kind = 'not_checked' OR c = 0 THEN 0.0 ELSE greatest(ln(greatest(1 - c::DOUBLE, 0.01)) * f::DOUBLE, -6.0) END AS llr FROM cov, kinds)"""


def _checks(spark):
    rows = [(s, k) for s in K.COVERAGE for k in ("not_checked", "checked_absent", "expected_absent")]
    return spark.createDataFrame(rows, "source string, kind string")


@query(f"{_ABSENCE} SELECT source, kind, round(llr, 6) AS llr FROM y")
def absence_llr(spark, sf):
    return A.with_absence(_checks(spark)).select("source", "kind", r6("llr"))


@query(f"{_ABSENCE} SELECT 'org_name:' || s_name AS subject_key, 'absent:' || source AS object_value, kind, round(least(abs(llr) / 4, 1.0), 6) AS weight, 'absence|' || source || '|org_name:' || s_name AS correlation_group FROM y, supplier")
def absence_claims(spark, sf):
    s = V.read(spark, sf, "supplier")
    x = s.join(F.broadcast(_checks(spark)), F.lit(True)).select(F.col("s_suppkey").alias("claim_pos"), F.lit("all").alias("case_ref"), F.lit("org_name").alias("subject_kind"), F.col("s_name").alias("subject_value"), F.concat(F.lit("org_name:"), "s_name").alias("subject_key"), "source", "kind", F.lit("").alias("query_url"), F.lit("").alias("sought"), V.as_of().alias("observed_at"))
    return A.absence_claims(x).select("subject_key", "object_value", F.get_json_object("raw", "$.absence_kind").alias("kind"), r6("weight"), "correlation_group")


_SATISFIED = "CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"


@query(f"{_ABSENCE}, x(source) AS (VALUES ('rdap'), ('rdap'), ('crtsh'), ('sellers_json'), ('wayback')) SELECT s_suppkey, x.source, round(llr, 6) AS llr FROM supplier, x JOIN y ON y.source = x.source AND kind = 'expected_absent' WHERE ({_SATISFIED}) = false")
def failed_expectations(spark, sf):
    s = V.read(spark, sf, "supplier").withColumns({"a": F.col("s_name"), "b": F.lit("other")})
    listed = A.expectations(s).join(s.select("a", "s_suppkey"), "a").withColumn("satisfied", F.expr(_SATISFIED))
    return A.failed_expectations(listed).select("s_suppkey", "source", r6("llr"))


L = WITH + V.SQL_LABELLED


@query(f"{L} SELECT round(avg(label::INT), 6) AS prevalence, count(*)::BIGINT AS n FROM l")
def prevalence(spark, sf):
    return C.prevalence(V.labelled_pairs(spark, sf)).select(r6("prevalence"), "n")


_BIN = "b AS (SELECT *, least(floor(predicted * 10 + 1e-9), 9)::INT AS bin FROM l)"
_DIAGRAM = f"{L}, {_BIN}, d AS (SELECT bin, count(*) AS n, avg(predicted) AS p, avg(label::INT) AS o FROM b GROUP BY 1)"


@query(f"{_DIAGRAM} SELECT bin, n::BIGINT AS n, round(p, 6) AS mean_predicted, round(o, 6) AS observed FROM d")
def reliability_diagram(spark, sf):
    return C.reliability_diagram(V.labelled_pairs(spark, sf)).select("bin", "n", r6("mean_predicted"), r6("observed"))


@query(f"{_DIAGRAM} SELECT round(sum(n * abs(o - p)) / sum(n), 6) AS ece, round(max(abs(o - p)), 6) AS mce FROM d")
def ece_mce(spark, sf):
    return C.calibration_error(C.reliability_diagram(V.labelled_pairs(spark, sf))).select(r6("ece"), r6("mce"))


@query(f"{_DIAGRAM}, t AS (SELECT count(*) AS total, avg(label::INT) AS base, avg((predicted - label::INT) ^ 2) AS score FROM l) SELECT round(any_value(score), 6) AS score, round(sum(n / total * (p - o) ^ 2), 6) AS reliability, round(sum(n / total * (o - base) ^ 2), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM d, t")
def brier(spark, sf):
    return C.brier(V.labelled_pairs(spark, sf)).select(r6("score"), r6("reliability"), r6("resolution"), r6("uncertainty"))


@query(f"""{L}, b AS (SELECT CASE WHEN predicted >= 0.95 THEN 'STRONG_EVIDENCE' WHEN predicted >= 0.8 THEN 'MODERATE_EVIDENCE' WHEN predicted >= 0.55 THEN 'LIMITED_EVIDENCE' WHEN predicted >= 0.2 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS band, label FROM l),
t AS (SELECT count(*) FILTER (label) AS hits, avg(label::INT) AS s FROM l), g AS (SELECT band, count(*) AS n, count(*) FILTER (label) AS tp, count(*) FILTER (label) / count(*) AS prec FROM b GROUP BY 1),
q AS (SELECT *, greatest(least(prec, 1 - 1e-12), 1e-12) AS c FROM g, t), o AS (SELECT *, c / (1 - c) * (1e-5 / (1 - 1e-5)) / (s / (1 - s)) AS odds FROM q)
SELECT band, n::BIGINT AS n, tp::BIGINT AS true_positives, round(prec, 6) AS precision_sample, round(odds / (1 + odds), 6) AS precision_operational, round(tp / hits, 6) AS recall FROM o""")
def band_performance(spark, sf):
    return C.band_performance(V.labelled_pairs(spark, sf)).select("band", "n", "true_positives", r6("precision_sample"), r6("precision_operational"), r6("recall"))


@query(f"{L}, q AS (SELECT a, greatest(least(predicted, 1 - 1e-12), 1e-12) AS c FROM l), o AS (SELECT a, c / (1 - c) * (0.01 / 0.99) / (0.5 / 0.5) AS odds FROM q) SELECT a, round(odds / (1 + odds), 6) AS corrected FROM o")
def prevalence_correction(spark, sf):
    return V.labelled_pairs(spark, sf).select("a", F.round(S.correct_for_prevalence(F.col("predicted"), F.lit(0.5), F.lit(0.01)), 6).alias("corrected"))


@query()
def platt_fit(spark, sf):
    pairs = V.labelled_pairs(spark, sf)
    fit = C.fit_platt(pairs)
    return pairs.select("a", F.round(fit.column(F.col("log_odds")), 6).alias("recalibrated"))


@query()
def isotonic_fit(spark, sf):
    pairs = V.labelled_pairs(spark, sf)
    fit = C.fit_isotonic(pairs)
    return pairs.select("a", F.round(fit.column(F.col("log_odds")), 6).alias("recalibrated"))


@query()
def split_by_case(spark, sf):
    train, test = C.split_by_case(V.labelled_pairs(spark, sf), seed=7)
    return train.select("a", "case_ref", F.lit("train").alias("part")).unionByName(test.select("a", "case_ref", F.lit("test").alias("part")))


_DISGUISES = {"bidi_control": K.BIDI, "control_char": "", "homoglyph": K.HOMOGLYPHS_FROM, "zero_width": K.ZERO_WIDTH}
_CLASS = {name: "".join(rf"\x{{{ord(c):x}}}" for c in chars) or r"\x00-\x08\x0b-\x1f\x7f-\x{9f}" for name, chars in _DISGUISES.items()}
_SCAN = ", ".join(f"CASE WHEN regexp_matches(text, '[{chars}]') THEN '{name}' END" for name, chars in _CLASS.items())
_CLASS_HIDDEN = _CLASS["zero_width"] + _CLASS["bidi_control"]
_quoted = lambda x: x.replace("'", "''")
_TRANSLATED = f"translate(translate(regexp_replace(regexp_replace(text, '[{_CLASS_HIDDEN}]', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '{K.HOMOGLYPHS_FROM}', '{K.HOMOGLYPHS_TO}'), '{K.PUNCTUATION_FROM}', '{_quoted(K.PUNCTUATION_TO)}')"


@query(f"SELECT doc_id, md5(lower(trim(regexp_replace(nfc_normalize({_TRANSLATED}), '\\s+', ' ', 'g')))) AS normal FROM documents")
def normalize_documents(spark, sf):
    """Every document in its normal form. The SQL has NFC where the library has NFKC: the tables hold no compatibility characters."""
    return V.read(spark, sf, "documents").select("doc_id", F.md5(T.normalise(F.col("text"), True)).alias("normal"))


@query(f"SELECT doc_id, concat_ws(',', {_SCAN}) AS findings FROM documents")
def scan_text(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.coalesce(F.array_join(F.array_sort(T.scan(F.col("text"))), ","), F.lit("")).alias("findings"))


@query("SELECT CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]') THEN 'control_char' ELSE 'none' END AS finding, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def obfuscation_counts(spark, sf):
    found = T.scan(F.col("text"))
    d = V.read(spark, sf, "documents").select(F.explode(F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)).alias("finding"))
    return d.groupBy("finding").agg(F.count("*").alias("n"))


@query()
def identifier_normalise(spark, sf):
    """Addresses of pages, their hosts, and names of customers, as they were met and in their normal form."""
    pages, customers = V.read(spark, sf, "pages"), V.read(spark, sf, "customer")
    met = pages.select(F.lit("url").alias("kind"), F.col("url").alias("raw")).unionByName(pages.select(F.lit("domain").alias("kind"), F.concat(F.upper(F.parse_url("url", F.lit("HOST"))), F.lit(".")).alias("raw")))
    met = met.unionByName(customers.select(F.lit("handle").alias("kind"), F.col("c_name").alias("raw"))).where("raw is not null").distinct()
    x = met.withColumn("x", T.observed(F.col("kind"), F.col("raw")))
    return x.select("kind", "raw", "x.value", "x.key", "x.was_obfuscated", F.array_join("x.findings", ",").alias("findings"))


@query()
def masked_identifiers(spark, sf):
    c = V.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("handle:"), "c_name").alias("key"))
    return c.select("c_custkey", T.masked(F.col("key"), b"salt").alias("masked"), T.minimised(F.col("key"), b"salt").alias("minimised"), T.audit_digest(F.col("key"), b"salt").alias("audit"))


@query()
def scrubbed_text(spark, sf):
    pages = V.read(spark, sf, "pages").select("page_id", "html")
    return M.scrub(pages, "html", ["example.com", "Jane Doe", "page"], b"salt")


@query()
def name_variants(spark, sf):
    names = V.read(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(V.read(spark, sf, "supplier").select(F.col("s_name").alias("name"))).distinct()
    return N.expand(names, "name").select("name", "variant", F.array_join("chain", ">").alias("chain"), "depth")


@query()
def name_match(spark, sf):
    """Names of nations and the words of part names that may be spellings of each other."""
    words = V.read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name")).where("name <> ''")
    names = V.read(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(words).distinct()
    found = N.match_names(names, names)
    return found.select("a", "b", "form", F.array_join("chain_a", ">").alias("chain_a"), F.array_join("chain_b", ">").alias("chain_b"), "transforms")


@query()
def lookup_variants(spark, sf):
    return V.read(spark, sf, "nation").select("n_name", F.array_join(N.lookup_column("n_name"), "|").alias("forms"))


@query("SELECT DISTINCT sha256(CASE WHEN page_id % 10 = 9 THEN '' ELSE html END) AS body_sha256 FROM pages")
def capture_dedupe(spark, sf):
    return P.bodies(V.captures_pages(spark, sf)).select("body_sha256")


@query("SELECT CASE WHEN page_id % 10 IN (7, 8) THEN 'error' WHEN page_id % 10 = 9 OR html = '' THEN 'empty' ELSE 'success' END AS outcome, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def outcome_counts(spark, sf):
    return P.outcome_counts(P.with_digests(V.captures_pages(spark, sf)))


@query("SELECT 'case' || page_id // 100 AS case_ref, (page_id % 100 + 1)::BIGINT AS sequence, 'entry hash mismatch' AS problem FROM pages WHERE page_id % 50 = 13")
def chain_verify(spark, sf):
    entries = P.chain(P.with_digests(V.captures_pages(spark, sf)))
    tampered = entries.withColumn("note", F.when((F.col("sequence") - 1) % 50 == 13, "changed").otherwise(F.col("note")))
    return P.verify(tampered)


@query("WITH s AS (SELECT 'all' AS c, 'conv://' || conv_id AS url, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY 2) SELECT row_number() OVER (ORDER BY pos)::BIGINT AS number, url FROM s")
def trail_citations(spark, sf):
    c = V.read(spark, sf, "conversations").select(F.lit("all").alias("case_ref"), F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("url"), F.lit("").alias("body_sha256"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return P.citations(c).select("number", "url")


@query("SELECT CASE role WHEN 'user' THEN 'query' ELSE 'observation' END AS kind, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def step_counts(spark, sf):
    kind = F.when(F.col("role") == "user", "query").otherwise("observation")
    c = V.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("case_ref"), kind.alias("kind"), F.col("turn").alias("pos"))
    return P.step_counts(P.steps(c))


_HOST = "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"


@query(f"WITH d AS (SELECT length({_HOST}) % 4 AS m, url LIKE '%page=2%' AS two FROM pages) SELECT count(*)::BIGINT AS urls_evaluated, count(*) FILTER (m = 0 AND two)::BIGINT AS disallowed, count(*) FILTER (m = 0 AND two)::BIGINT AS fetched_despite_disallow, 0::BIGINT AS skipped FROM d")
def fetch_policy_summary(spark, sf):
    urls = V.read(spark, sf, "pages").select("url")
    hosts = urls.select(F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host")).distinct()
    m = F.length("host") % 4
    robots = hosts.select("scheme", "host", F.when(m == 0, 200).when(m == 1, 404).when(m == 2, 503).cast("int").alias("status"), F.when(m == 0, "User-agent: *\nDisallow: /*page=2").alias("text"), F.when(m == 3, "connection refused").alias("error"))
    # the standard parser has no wildcards inside a path: what the rules forbid is told by whole prefixes
    paths = urls.where("url like '%page=2%'").select(F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path")).groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Disallow: "), "path"))), "\n").alias("rules"))
    robots = robots.join(paths, "host", "left").withColumn("text", F.when(F.col("text").isNotNull(), F.concat(F.lit("User-agent: *\n"), F.coalesce("rules", F.lit("Disallow:"))))).drop("rules")
    return P.fetch_summary(P.fetch_decisions(urls, robots, "record"))


@query(f"""{EV}, n AS (SELECT subject_key AS key, claim_pos, collector, weight, ts FROM claims UNION ALL SELECT object_key, claim_pos, collector, weight, ts FROM claims)
SELECT key, count(*)::BIGINT AS claims, array_to_string(list_sort(list(DISTINCT collector))[1:3], ',') AS collectors, bool_and(weight <= 0) AS all_demoted FROM n GROUP BY 1""")
def ioc_table(spark, sf):
    c = V.claims_events(spark, sf)
    return X.indicators(c, E.identifiers(c)).select("key", "claims", F.array_join("collectors", ",").alias("collectors"), "all_demoted")


@query(f"{EV} SELECT DISTINCT collector AS source, CASE collector WHEN 'rdap' THEN 'RDAP (IANA bootstrap)' WHEN 'ads_txt_owner' THEN 'IAB Tech Lab ads.txt' ELSE 'Terms not declared' END AS name FROM claims")
def source_attribution(spark, sf):
    return X.source_attribution(V.claims_events(spark, sf))


@query("SELECT 'seller_id:m' || c_mktsegment AS key, array_to_string(list_sort(list(DISTINCT CASE c_custkey % 2 WHEN 0 THEN 'DIRECT' ELSE 'RESELLER' END)), ',') AS relationships FROM customer GROUP BY 1")
def reseller_labels(spark, sf):
    c = V.read(spark, sf, "customer").select(F.lit("seller_id").alias("object_kind"), F.concat(F.lit("seller_id:m"), "c_mktsegment").alias("object_key"), F.concat(F.lit("domain:"), "c_name").alias("subject_key"), F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, "direct").otherwise("reseller").alias("relationship"))).alias("raw"))
    return X.seller_relationships(c).select("key", F.array_join("relationships", ",").alias("relationships"))


@query()
def ftm_entities(spark, sf):
    c = V.claims_customer(spark, sf)
    members = _case_identifiers(c).withColumn("cluster", F.col("key"))
    ents = R.entities(members, spark.createDataFrame([], "case_ref string, a string, b string, log_odds double"), c)
    return X.ftm_entities(ents, members).select("id", "schema", F.to_json("properties").alias("properties"))


@query(f"{PAIRS} SELECT a, b, round(log_odds, 6) AS log_odds, band FROM p WHERE band <> 'UNSUPPORTED' ORDER BY p.log_odds DESC, a, b LIMIT 40")
def map_edges(spark, sf):
    return X.map_edges(_banded(spark, sf, "a", "b", floor=S.WEAK_LOG_ODDS)).select("a", "b", r6("log_odds"), "band")


@query(f"""WITH RECURSIVE {V.SQL_CLAIMS}, g AS (SELECT DISTINCT subject_key AS a, regexp_replace(object_key, '-d.*', '') AS b FROM claims),
m AS (SELECT a, replace(b, 'service_id:', 'handle:s') AS b FROM g UNION SELECT replace(b, 'service_id:', 'handle:s'), a FROM g),
w AS (SELECT 'handle:u1' AS key, 0 AS depth UNION SELECT m.b, w.depth + 1 FROM w JOIN m ON m.a = w.key WHERE w.depth < 2) SELECT key, min(depth) AS depth FROM w GROUP BY 1""")
def frontier_bfs(spark, sf):
    """Two steps from one seed over all claims, with room for every node."""
    c = V.claims_events(spark, sf)
    thing = F.concat(F.lit("s"), F.regexp_replace("object_value", "-d.*", ""))
    c = c.withColumns({"object_kind": F.lit("handle"), "object_value": thing, "object_key": F.concat(F.lit("handle:"), thing)})
    seeds = spark.createDataFrame([("handle:u1", "handle", "u1")], "key string, kind string, value string")
    found = G.expand(seeds, [G.over_claims(c)], radius=2, max_nodes=1 << 62)
    if found.nodes_truncated:
        raise RuntimeError("the search was cut")
    return found.seen.select("key", "depth")


@query()
def cypher_lines(spark, sf):
    c = V.claims_customer(spark, sf)
    members = _case_identifiers(c).withColumn("cluster", F.col("key"))
    ents = R.entities(members, spark.createDataFrame([], "case_ref string, a string, b string, log_odds double"), c)
    return X.cypher(c, E.identifiers(c), ents, lambda k: T.minimised(k, b"salt"))
