import math

import pytest
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import scoring as S
from provenor.functions import text as T
from provenor.operators import evidence as E
from provenor.operators import ingest as I
from provenor.operators import resolution as R

AS_OF = "2024-01-01 00:00:00"
SCHEMA = "claim_pos long, case_ref string, subject_kind string, subject_value string, subject_key string, predicate string, object_kind string, object_value string, object_key string, collector string, source_url string, reliability double, weight double, observed_at timestamp, retrieved_at timestamp, correlation_group string, dependence_class string, raw string"


def claims(spark, rows):
    """rows: subject, predicate, object, then collector, group and changes to the rest."""
    out = []
    for i, (subject, predicate, obj, collector, group, more) in enumerate(rows):
        c = {"reliability": 1.0, "weight": 1.0, "dependence_class": ""} | more
        literal = ":" not in obj or obj.startswith("absent:")
        when = __import__("datetime").datetime(2024, 1, 1)
        out.append((i, "case", subject.split(":")[0], subject.split(":", 1)[1], subject, predicate, None if literal else obj.split(":")[0], obj if literal else obj.split(":", 1)[1], None if literal else obj, collector, "", c["reliability"], c["weight"], when, when, group, c["dependence_class"], None))
    return spark.createDataFrame(out, SCHEMA)


def score(spark, rows):
    return {(r.a, r.b): r for r in E.assess_pairs(claims(spark, rows), F.lit(AS_OF).cast("timestamp")).collect()}


def test_selectivity_vectors(spark):
    given = [1, 2, 3, 10, 100, 250, 1000, 400_000]
    want = [13.815511, 13.410046, 12.899221, 11.564220, 9.215354, 8.296053, 6.908256, 0.916293]
    df = spark.createDataFrame([(h,) for h in given], "h long")
    got = [r[0] for r in df.select(F.ln(1 / S.selectivity(F.col("h")))).collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_absence_vectors(spark):
    want = {"companies_house_uk": (-3.9120, -5.8680), "sec_edgar": (-2.9957, -4.4936), "gleif": (-4.6052, -6), "icij_offshore_leaks": (-1.8971, -2.8457), "crtsh": (-3.5066, -5.2598), "sellers_json": (-2.3026, -3.4539), "opencorporates": (-1.3863, -2.0794), "wayback": (-0.5108, -0.7662), "business_directory": (0, 0), "unheard_of": (0, 0)}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    for r in df.select("s", S.absence_llr(F.col("s"), F.lit("checked_absent")).alias("c"), S.absence_llr(F.col("s"), F.lit("expected_absent")).alias("e"), S.absence_llr(F.col("s"), F.lit("not_checked")).alias("n")).collect():
        assert (r.c, r.e) == pytest.approx(want[r.s], abs=1e-4) and r.n == 0


def test_one_group_never_saturates(spark):
    assert K.GROUP_CAP < abs(math.log(K.PRIOR_ODDS))
    got = score(spark, [("handle:a", "commit_email", "email:x@y.example", "git", "repo|1", {})] * 400)
    r = got["email:x@y.example", "handle:a"]
    assert r.independent_groups == 1 and r.band in ("WEAK", "UNSUPPORTED")
    # the strongest claim and the logarithm of how many, at most the cap
    assert r.log_odds == pytest.approx(math.log(1e-5) + 8)


def shared(obj, group, collector, a="domain:a.example", b="domain:b.example"):
    return [(a, "shares_analytics_id" if "analytics" in obj else "seller_of", obj, collector, f"{group}|a", {}), (b, "shares_analytics_id" if "analytics" in obj else "seller_of", obj, collector, f"{group}|b", {})]


def test_two_shared_identifiers_merge_and_one_does_not(spark):
    both = shared("analytics_id:ua-1", "analytics", "artifacts") + shared("seller_id:s-1", "sellers_json", "sellers_json")
    r = score(spark, both)["domain:a.example", "domain:b.example"]
    assert r.log_odds == pytest.approx(-11.512925 + 10 + 10.4, abs=1e-5) and r.independent_groups == 2 and r.band == "STRONG_EVIDENCE"
    one = score(spark, shared("analytics_id:ua-1", "analytics", "artifacts"))["domain:a.example", "domain:b.example"]
    assert one.log_odds == pytest.approx(-1.512925, abs=1e-5) and one.independent_groups == 1


def test_registry_assertion_is_definitional(spark):
    registry = [("org_name:acme", "same_as", "lei:5493", "gleif", "gleif|1", {})]
    r = score(spark, registry)["lei:5493", "org_name:acme"]
    assert (r.log_odds, r.probability) == pytest.approx((1.897121, 0.869565), abs=1e-6) and r.definitional and r.band == "MODERATE_EVIDENCE"
    hostile = score(spark, [("org_name:acme", "same_as", "lei:5493", "subject_html:gleif", "page|1", {})])["lei:5493", "org_name:acme"]
    assert not hostile.definitional and hostile.band in ("WEAK", "UNSUPPORTED")


def test_contradiction_lowers_and_absence_makes_no_pair(spark):
    base = shared("analytics_id:ua-1", "analytics", "artifacts")
    against = [*base, ("domain:a.example", "contradicts", "domain:b.example", "negative", "neg|1", {})]
    pair = ("domain:a.example", "domain:b.example")
    assert score(spark, against)[pair].log_odds < score(spark, base)[pair].log_odds
    assert score(spark, [("domain:a.example", "contradicts", "absent:rdap", "rdap:negative", "absence|rdap", {})]) == {}


def test_spellings_of_a_group_are_one_group(spark):
    rows = [("domain:a.example", "shares_analytics_id", "analytics_id:x", "artifacts", g, {}) for g in ("page|ga4", "PAGE|ga4", "pa​ge|ga4", "‎page|ga4|1", "page|ga4|2")]
    r = score(spark, rows)["analytics_id:x", "domain:a.example"]
    assert r.independent_groups == 1 and len(r.top_evidence) == 1


def test_declared_class_wins_and_conflicts_fail(spark):
    rows = [("domain:a.example", "seller_of", "seller_id:s", "x", "sellers_json|1", {"dependence_class": "independent"}), ("domain:a.example", "seller_of", "seller_id:s", "x", "sellers_json|abc", {"dependence_class": "independent"})]
    assert score(spark, rows)["domain:a.example", "seller_id:s"].independent_groups == 2
    rows[1] = (*rows[1][:4], "sellers_json|1", {"dependence_class": "registration"})
    with pytest.raises(Exception, match="conflicting"):
        E.assess_pairs(claims(spark, rows), F.lit(AS_OF).cast("timestamp"), strict=True).collect()


def test_strongest_of_a_class_is_whole(spark):
    df = spark.createDataFrame([([-6.0, 2.0],), ([8.0, 8.0, 8.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(E.sub_additive(F.col("v"), 0.25)).collect()] == pytest.approx([-5.5, 12.0, 0.0])


def resolved(spark, rows, allowed=K.TYPE_RANK):
    c = claims(spark, rows)
    idents = E.identifiers(c).withColumn("case_ref", F.lit("case"))
    ents, rejected = R.resolve(c, E.assess_pairs(c, F.lit(AS_OF).cast("timestamp")), idents, allowed)
    return ents.collect(), rejected.collect()


def test_constraints_hold_across_clusters(spark):
    def link(a, b, n):
        return shared(f"analytics_id:u{n}", f"analytics{n}", "artifacts", a, b) + shared(f"seller_id:s{n}", f"sellers_json{n}", "sellers_json", a, b)

    a, b, c = ("domain:%s.example" % x for x in "abc")
    ents, rejected = resolved(spark, link(a, b, 1) + link(b, c, 2) + [(a, "contradicts", c, "negative", "neg|1", {})])
    clusters = [set(e.identifiers) for e in ents]
    assert any({a, b} <= x for x in clusters) and not any({a, c} <= x for x in clusters)
    assert [(r.a, r.b, r.reason) for r in rejected if {r.a, r.b} == {b, c}] == [(b, c, R.MUST_NOT_LINK)]


def test_person_and_company_stay_apart(spark):
    rows = [("person_name:jane doe", "same_as", "handle:jd", "gleif", "gleif|1", {}), ("handle:jd", "same_as", "company_number:1", "companies_house_uk", "ch|1", {})]
    ents, rejected = resolved(spark, rows)
    assert R.TYPE_CONFLICT in {r.reason for r in rejected}
    assert {"person_name:jane doe", "handle:jd"} in [set(e.identifiers) for e in ents]


def test_identifier_normal_forms(spark):
    rows = [("domain", "Exаmple.com.", "example.com"), ("email", "A​@B.example", "a@b.example"), ("org_name", "Acme  Ltd", "Acme Ltd"), ("person_name", "Jane DOE", "Jane DOE"), ("lei", "abc1", "ABC1"), ("cik", "320193", "0000320193"), ("cik", "000123456789012", "123456789012"), ("org_name", "Ａcme", "Acme"), ("handle", None, None)]
    df = spark.createDataFrame(rows, "k string, v string, want string").withColumn("got", T.identifier_value(F.col("k"), F.col("v")))
    assert df.where("not (got <=> want)").collect() == []
    assert df.where("not (got <=> want)").isEmpty()
    again = df.withColumn("again", T.identifier_value(F.col("k"), F.col("got")))
    assert again.where("not (again <=> got)").isEmpty()


def test_filters(spark):
    rows = [("email", "info@x.example", "commit_email", "drop"), ("email", "noreply12@x.example", "commit_email", "drop"), ("org_name", "Domains By Proxy", "registrant", "drop"), ("org_name", "CSC", "legal_name", "demote"), ("org_name", "ab", "legal_name", "drop"), ("domain", "cdn.example", "co_hosted", "demote"), ("org_name", "Amazon Data", "registrant", "demote"), ("org_name", "Amazon Data", "legal_name", "keep")]
    df = spark.createDataFrame([(i, "c", f"handle:{i}", k, v, f"{k}:{v}", p, w) for i, (k, v, p, w) in enumerate(rows)], "claim_pos long, case_ref string, subject_key string, object_kind string, object_value string, object_key string, predicate string, want string")
    lines = spark.createDataFrame([(" CDN.example # shared",), ("#",), ("",)], "value string")
    assert I.verdicts(df, I.blacklist(lines)).where("verdict <> want").collect() == []


def test_running_holders_demote_from_then_on(spark):
    df = spark.createDataFrame([(i, "c", f"handle:{i % 6}", "domain", "d", "domain:d", "operates") for i in range(12)], "claim_pos long, case_ref string, subject_key string, object_kind string, object_value string, object_key string, predicate string")
    got = I.verdicts(df, max_holders=3).orderBy("claim_pos").collect()
    assert [r.holders_before for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7]
    assert [r.verdict for r in got] == ["keep"] * 3 + ["demote"] * 9
