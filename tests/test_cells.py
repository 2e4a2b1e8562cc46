import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from provenor.operators import cells
from provenor.operators import evidence as E
from provenor.operators import resolution as R
from provenor.plans import queries as Q
from provenor.plans import views as V
from tests.test_evidence import AS_OF, claims

KEYS = ["case_ref", "a", "b"]


def plain_levels(c, as_of, ascii_only=False):
    """Every pair's rows dealt by pair, and the three aggregates as DataFrames."""
    found = E.with_evidence(c, E.holders(c), as_of, ascii_only=ascii_only)
    groups = E.group_aggregate(E.pair_legs(E.legs(found)))
    return {"group": groups, "class": E.class_aggregate(groups), "pair": E.assessments(E.class_aggregate(groups))}


def same(got, want, columns, keys):
    def rows(df):
        out = {}
        for r in df.select(*columns).collect():
            k = tuple(r[c] for c in keys)
            assert k not in out
            out[k] = r
        return out

    got, want = rows(got), rows(want)
    assert set(got) == set(want) and len(got) > 20
    for k, r in got.items():
        for c in columns:
            x, y = r[c], want[k][c]
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y, (k, c, x, y)


def odd_claims(spark):
    """Shared groups, repeated legs, chains of subjects that are objects, one that holds itself, declared classes, contradictions."""
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        subject = f"handle:u{rng.randrange(14)}"
        obj = rng.choice([f"service_id:k{rng.randrange(9)}", f"handle:u{rng.randrange(14)}", "lei:1"])
        predicate = rng.choice(["shares_favicon", "same_as", "seller_of", "contradicts", "commit_email"])
        more = {"reliability": rng.choice([1.0, 0.4]), "weight": rng.choice([0.0, 1.0, 1.0]), "dependence_class": rng.choice(["", "", "", "independent", "dns_hosting"])}
        rows.append((subject, predicate, obj, rng.choice(["gleif", "git", "rdap"]), rng.choice(["git|x", f"rdap|{subject}", "favicon|1", "lone"]), more))
    return claims(spark, rows)


@pytest.mark.parametrize("which", ["odd", "events"])
def test_levels_match_the_plain_aggregates(spark, monkeypatch, which):
    c, as_of = (odd_claims(spark), F.lit(AS_OF).cast("timestamp")) if which == "odd" else (V.claims_events(spark, "/root/testdata/sf0.001", True), V.as_of())
    want = plain_levels(c, as_of)
    n = 3
    monkeypatch.setattr(cells, "blocks", lambda *_: n)
    for level, keys in (("group", [*KEYS, "gkey"]), ("class", [*KEYS, "class"])):
        same(E.in_cells(c, as_of, level=level, at_once=150), want[level], list(cells.LEVELS[level]), keys)
    whole = E.assess_pairs(c, as_of)
    assert set(whole.columns) == set(want["pair"].columns)
    same(whole, want["pair"], [x for x in whole.columns if x != "top_evidence"], KEYS)
    shown = want["pair"].select(*KEYS, F.posexplode("top_evidence").alias("i", "e")).select(*KEYS, (F.col("i") + 1).alias("place"), F.col("e.group").alias("gkey"), F.col("e.llr").alias("llr"))
    same(E.in_cells(c, as_of, level="shown"), shown, list(cells.LEVELS["shown"]), [*KEYS, "place"])
    listed = whole.select(*KEYS, F.posexplode("top_evidence").alias("i", "e")).select(*KEYS, (F.col("i") + 1).alias("place"), F.col("e.group").alias("gkey"), F.col("e.llr").alias("llr"))
    same(listed, shown, list(cells.LEVELS["shown"]), [*KEYS, "place"])


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["assess_pairs", "group_aggregate", "independent_groups", "band_distribution", "headline_counts", "class_aggregate", "map_edges", "mergeable_pairs", "top_evidence"])
def test_no_pair_is_shuffled(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "mapinarrow" in plan.lower()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and ", a#" in line]


def test_what_is_merged_needs_no_other_pairs(spark):
    c = V.claims_events(spark, "/root/testdata/sf0.01", True)
    scored = plain_levels(c, V.as_of(), True)["pair"]
    merged = R.checkpointed(R.merge(R.checkpointed(scored), R.forbidden_pairs(c)))
    want = sorted(tuple(r) for r in R.rejected(merged).collect())
    assert want and sorted(tuple(r) for r in Q.QUERIES["rejected_merges"](spark, "/root/testdata/sf0.01").collect()) == want
    ents = R.entities(R.membership(merged, Q._case_identifiers(c)), scored, c)
    want = {(r.case_ref, r.entity_id): (" ".join(r.identifiers), r.type, pytest.approx(r.log_odds, abs=1e-5)) for r in ents.collect()}
    got = {(r.case_ref, r.entity_id): (r.identifiers, r.type, r.log_odds) for r in Q.QUERIES["resolve_entities"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) > 100 and got == want


def test_sums_against_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    rows, against = [], {}
    for i in range(40):
        for k in range(3, 9):
            for who in (f"handle:x{i}", f"handle:y{i}"):
                reliability = rng.choice([1.0, 0.85, 0.65, 0.4, 0.2])
                against.setdefault(who, []).append(-reliability * 4.0)
                rows.append((who, "contradicts", f"service_id:k{i}-{k}", "negative_check", f"error|{who}", {"reliability": reliability, "weight": 1.0}))
    rng.shuffle(rows)
    want = {who: math.fsum(x) for who, x in against.items()}
    as_of = F.lit(AS_OF).cast("timestamp")
    c = claims(spark, rows)
    for groups in (E.in_cells(c, as_of, level="group"), plain_levels(c, as_of)["group"]):
        shared = groups.where("a like 'handle:x%' and b like 'handle:y%'").collect()
        assert len(shared) == 80 and all(r.llr == want[r.gkey.split("|")[1]] for r in shared)


def test_blocks_travel_by_bands_and_lose_no_pair(spark, monkeypatch):
    assert cells.bands(12, 8) == 6 and cells.bands(3, 8) == 3 and cells.bands(1, 8) == 1
    # however many blocks there are, one travels as often as there are bands, and a band has so many blocks at most
    assert cells.bands(24, 4) == 4 and cells.bands(600, 8) == math.ceil(600 / cells.BAND)
    c, as_of = odd_claims(spark), F.lit(AS_OF).cast("timestamp")
    want = plain_levels(c, as_of)
    monkeypatch.setattr(cells, "blocks", lambda *_: 7)
    monkeypatch.setattr(cells, "bands", lambda *_: 3)
    for level, keys in (("group", [*KEYS, "gkey"]), ("class", [*KEYS, "class"])):
        same(E.in_cells(c, as_of, level=level), want[level], list(cells.LEVELS[level]), keys)
    whole = E.assess_pairs(c, as_of)
    same(whole, want["pair"], [x for x in whole.columns if x != "top_evidence"], KEYS)


def test_legs_are_packed_close_and_whole():
    rng = random.Random(1)
    legs = [{"sb": i % 2, "gkey": f"view|u{rng.randrange(1500)}", "object_key": f"service_id:k{rng.randrange(90)}-d20240101", "pos": i} for i in range(60_000)]
    t = pa.Table.from_pylist(legs, pa.schema([("sb", pa.int32()), ("gkey", pa.string()), ("object_key", pa.string()), ("pos", pa.int64())]))
    got, size, plain = [], 0, 0
    for b in cells._packed(t.to_batches(max_chunksize=7000)):
        for i, blob in zip(b["i"].to_pylist(), b["blob"].to_pylist(), strict=True):
            got += [x | {"sb": i} for x in pa.ipc.open_stream(blob).read_all().to_pylist()]
            size += len(blob)
    assert sorted(got, key=lambda x: x["pos"]) == legs
    for i in (0, 1):
        own = t.filter(pc.equal(t["sb"], i)).drop_columns("sb").combine_chunks()
        own = pa.table({c: own[c].combine_chunks().dictionary_encode() if pa.types.is_string(own[c].type) else own[c] for c in own.column_names})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(own)
        plain += sink.getvalue().size
    assert size < 0.85 * plain, size / plain


def test_claims_are_dealt_out_by_object_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.QUERIES["class_aggregate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    # holders by object and subject and then by object, claims by object, legs by block, blocks by task
    assert len(dealt) <= 5 and not any("gkey#" in line for line in dealt), dealt
