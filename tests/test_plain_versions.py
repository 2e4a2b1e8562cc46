"""Queries that SQL does not express, against plain Python over the same tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import names as N
from provenor.operators import calibration as C
from provenor.operators import resolution as R
from provenor.plans import queries as Q
from provenor.plans import views as V

SF = "/root/testdata/sf0.001"


def plain_merge(pairs, barred):
    """All pairs of a case from the strongest down; an entity is a set of keys."""
    entity, rejected = {}, set()
    for p in sorted(pairs, key=lambda p: (-p.log_odds, p.pair_ord.arm, p.pair_ord.object_first, p.pair_ord.pos, p.a, p.b)):
        if not (p.log_odds >= K.MERGE_LOG_ODDS or (p.definitional and p.band in ("STRONG_EVIDENCE", "MODERATE_EVIDENCE"))):
            continue
        x, y = entity.setdefault(p.a, {p.a}), entity.setdefault(p.b, {p.b})
        types = {K.ENTITY_TYPES.get(k.split(":")[0]) for k in x | y}
        if any({c, d} <= x | y and (({c, d} & x and {c, d} & y) or x is y) for c, d in barred):
            rejected.add((p.a, p.b, R.MUST_NOT_LINK))
        elif p.band in ("WEAK", "UNSUPPORTED") and not p.definitional:
            rejected.add((p.a, p.b, R.TOO_FEW_GROUPS))
        elif {"Person", "Company"} <= types:
            rejected.add((p.a, p.b, R.TYPE_CONFLICT))
        elif x is not y:
            x |= y
            for k in y:
                entity[k] = x
    return {frozenset(e) for e in entity.values()}, rejected


def test_entities_and_rejections(spark):
    claims = V.claims_events(spark, SF, True)
    scored = Q._scored(spark, SF, True).collect()
    barred = {}
    for r in R.forbidden_pairs(claims).collect():
        barred.setdefault(r.case_ref, []).append((r.a, r.b))
    whole, rejected = set(), set()
    for case in {p.case_ref for p in scored}:
        merged, no = plain_merge([p for p in scored if p.case_ref == case], barred.get(case, []))
        whole |= {(case, e) for e in merged if len(e) > 1}
        rejected |= {(case, *x) for x in no}
    got = {(r.case_ref, frozenset(r.identifiers.split(" "))) for r in Q.QUERIES["resolve_entities"](spark, SF).collect()}
    assert {e for e in got if len(e[1]) > 1} == whole and whole
    assert {tuple(r) for r in Q.QUERIES["rejected_merges"](spark, SF).select("case_ref", "a", "b", "reason").collect()} == rejected and rejected


def test_platt_and_isotonic_queries(spark):
    pairs = [(r.a, r.log_odds, float(r.label)) for r in V.labelled_pairs(spark, SF).collect()]
    scale = max(1.0, max(abs(x) for _, x, _ in pairs))
    a, b = 1.0, 0.0
    for _ in range(400):
        errors = [(1 / (1 + math.exp(-(a * x / scale + b))) - y, x / scale) for _, x, y in pairs]
        a, b = a - 0.05 * sum(e * u for e, u in errors) / len(pairs), b - 0.05 * sum(e for e, _ in errors) / len(pairs)
    got = {r.a: r.recalibrated for r in Q.QUERIES["platt_fit"](spark, SF).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, a / scale * x + b)))), abs=2e-6) for i, x, _ in pairs)
    # the least squares rise: the largest over all starts of the least mean over all ends
    ys = [y for _, _, y in sorted(pairs, key=lambda p: (p[1], p[2]))]
    xs = sorted(x for _, x, _ in pairs)
    sums = [0.0]
    for y in ys:
        sums.append(sums[-1] + y)
    rise = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, len(ys) + 1)) for i in range(k + 1)) for k in range(len(ys))]
    got = {r.a: r.recalibrated for r in Q.QUERIES["isotonic_fit"](spark, SF).collect()}
    by_score = {}
    for x, r in zip(xs, rise, strict=True):
        by_score.setdefault(x, set()).add(round(r, 6))
    once = [(i, x) for i, x, _ in pairs if len(by_score[x]) == 1 and xs.count(x) == 1]
    assert len(once) > 20 and all(min(rise) - 1e-6 <= got[i] <= max(rise) + 1e-6 for i, _ in once)
    ordered = [got[i] for i, x in sorted(once, key=lambda p: p[1])]
    assert ordered == sorted(ordered)
    fit = C.fit_isotonic(V.labelled_pairs(spark, SF))
    assert fit.ys[0] == pytest.approx(rise[0]) and fit.ys[-1] == pytest.approx(rise[-1])
    assert sorted({round(y, 9) for y in fit.ys}) == sorted({round(y, 9) for y in rise})


def test_split_keeps_cases_whole(spark):
    rows = Q.QUERIES["split_by_case"](spark, SF).collect()
    cases = sorted({r.case_ref for r in rows})
    random.Random(7).shuffle(cases)
    test = set(cases[: max(1, int(len(cases) * 0.3))])
    assert len(rows) == V.labelled_pairs(spark, SF).count()
    assert all((r.part == "test") == (r.case_ref in test) for r in rows)


def test_identifiers_in_their_normal_form(spark):
    rows = Q.QUERIES["identifier_normalise"](spark, SF).collect()
    assert {r.kind for r in rows} == {"url", "domain", "handle"} and len(rows) > 100
    for r in rows:
        # the tables' values are plain ASCII without anything hidden
        value = " ".join(r.raw.split()).lower()
        value = value.rstrip(".") if r.kind in ("domain", "handle") else value
        assert (r.value, r.key, r.was_obfuscated) == (value, f"{r.kind}:{value}", False)


def test_digests_of_identifiers(spark):
    for r in Q.QUERIES["masked_identifiers"](spark, SF).join(V.read(spark, SF, "customer").select("c_custkey", "c_name"), "c_custkey").limit(20).collect():
        key = f"handle:{r.c_name}".encode()
        assert r.masked == hashlib.blake2b(b"salt" + key, digest_size=16).hexdigest()
        assert r.minimised == "min:" + hashlib.blake2b(b"salt" + key, digest_size=12).hexdigest()
        assert r.audit == "min:" + hashlib.sha256(b"salt" + key).hexdigest()[:24]


def test_scrubbed_pages(spark):
    from provenor.operators.minimise import scrubber

    run = scrubber(["example.com", "Jane Doe", "page"], b"salt")
    pages = {r.page_id: r.html for r in V.read(spark, SF, "pages").collect()}
    got = {r.page_id: r.html for r in Q.QUERIES["scrubbed_text"](spark, SF).collect()}
    assert got == {i: None if t is None else run(t) for i, t in pages.items()}


def test_names_are_matched_as_pair_by_pair(spark):
    got = {(r.a, r.b): r.form for r in Q.QUERIES["name_match"](spark, SF).collect()}
    names = sorted({x for pair in got for x in pair})
    assert len(names) > 25 and all((n, n) in got or (n.lower(), n) in got or any(n in p for p in got) for n in names)
    some = random.Random(2).sample(names, min(len(names), 40))
    for i, a in enumerate(some):
        for b in some[i:]:
            pair = (a, b) if a.lower() <= b.lower() else (b, a)
            assert bool(N.match(a, b)["matched"]) == (pair in got or pair[::-1] in got), pair


def test_spellings_and_lookups(spark):
    spellings = {}
    for r in Q.QUERIES["name_variants"](spark, SF).collect():
        spellings.setdefault(r.name, {})[r.variant] = (r.chain, r.depth)
    nations = [r[0] for r in V.read(spark, SF, "nation").select("n_name").collect()]
    assert set(nations) <= set(spellings)
    for n in nations:
        assert spellings[n] == {v: (">".join(c), len(c)) for v, c in N.variants(n).items()}
    got = {r.n_name: r.forms for r in Q.QUERIES["lookup_variants"](spark, SF).collect()}
    assert got == {n: "|".join(N.lookup_variants(n)) for n in nations}


def test_exports_over_a_table(spark):
    customers = V.read(spark, SF, "customer").count()
    ftm = Q.QUERIES["ftm_entities"](spark, SF).collect()
    assert len(ftm) >= customers and all(r.id.startswith("ent-") and r.schema in ("Company", "Person", "LegalEntity") for r in ftm)
    lines = Q.QUERIES["cypher_lines"](spark, SF)
    assert lines.where("line like '%c_custkey%' or line like '%handle:c%'").count() == 0 and lines.where(F.col("line").contains("min:")).count() >= customers


def test_components_raise_when_they_do_not_settle(spark):
    line = spark.createDataFrame([("c", f"k{i:03d}", f"k{i + 1:03d}") for i in range(60)], "case_ref string, a string, b string")
    assert {r.component for r in R.components(line).collect()} == {"k000"}
    with pytest.raises(RuntimeError):
        R.components(line, rounds=2)
