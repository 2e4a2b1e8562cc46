import json
import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from provenor.functions import text as T
from provenor.operators import frontier as G
from provenor.operators import provenance as P
from provenor.operators import record as R
from provenor.sources import case, files

AT = "2024-05-01T00:00:00+00:00"


def rows():
    return [
        R.capture("c", 1, "https://a.example/", 200, "hello", collector="web", at=AT, got={"B": "2", "A": "1"}),
        R.negative("c", 2, "https://register.example/?q=x", "register", "no such company", at=AT),
        R.refusal("c", 3, "breach list", "none", "denied class", at=AT),
        R.capture("c", 4, "https://b.example/", 503, None, collector="web", at=AT),
        R.capture("c", 5, "https://c.example/", 200, "hello", collector="web", at=AT),
    ]


def test_outcomes_of_what_was_not_found_and_not_asked(spark):
    entries = P.chain(P.with_digests(R.captures(spark, rows())))
    assert {r.outcome: r.n for r in P.outcome_counts(entries).collect()} == {"success": 2, "empty": 1, "refused": 1, "error": 1}
    assert P.verify(entries).collect() == []


def test_package_has_all_parts_and_verifies_by_itself(spark, tmp_path):
    root = str(tmp_path / "package")
    shots = R.Shots()
    shots.add("https://a.example/", b"image", "shots/1.png", captured_at=AT)
    files.write_package(R.captures(spark, rows()), root, shots, case_ref="c", authorization="order 7")
    names = {p.name for p in pathlib.Path(root).iterdir() if not p.name.startswith(".")}
    assert {"evidence_manifest.json", "TIMESTAMP.md", "DECLARATION_DRAFT.md", "verify.py", "screenshots.json", "SCREENSHOTS.txt", "bodies"} <= names
    doc = json.loads(pathlib.Path(root, "evidence_manifest.json").read_text())
    assert doc["outcomes"] == {"success": 2, "empty": 1, "error": 1, "refused": 1} and doc["manifest_hash"] in pathlib.Path(root, "TIMESTAMP.md").read_text()
    assert "order 7" in pathlib.Path(root, "DECLARATION_DRAFT.md").read_text()
    assert os.stat(f"{root}/evidence_manifest.json").st_mode & 0o777 == 0o600 and os.stat(root).st_mode & 0o777 == 0o700
    assert files.verify_package(spark, root).collect() == []
    check = lambda: subprocess.run([sys.executable, "-I", f"{root}/verify.py"], capture_output=True, text=True)
    assert check().returncode == 0 and "verified" in check().stdout
    body = next(p for p in pathlib.Path(root, "bodies").iterdir() if p.stat().st_size == 5 and not p.name.startswith("."))
    body.write_bytes(b"hallo")
    assert check().returncode == 1 and "body hash mismatch" in check().stdout
    body.write_bytes(b"hello")
    doc["authorization"] = "none"
    pathlib.Path(root, "evidence_manifest.json").write_text(json.dumps(doc))
    assert "envelope digest mismatch" in check().stdout


def test_screenshots_are_checked(tmp_path):
    (tmp_path / "shots").mkdir()
    shots = R.Shots()
    for i in range(4):
        (tmp_path / "shots" / f"{i}.png").write_bytes(f"image {i}".encode())
        shots.add(f"https://a.example/{i}", f"image {i}".encode(), f"shots/{i}.png", captured_at=AT)
    shots.add("https://a.example/none", None, status="failed", captured_at=AT)
    assert shots.problems(str(tmp_path)) == [] and shots.text().count("\n") == 5 and len(json.loads(shots.json())["shots"]) == 5
    (tmp_path / "shots" / "1.png").write_bytes(b"other")
    (tmp_path / "shots" / "2.png").unlink()
    shots.rows[3]["url"] = "https://changed.example/"
    assert shots.problems(str(tmp_path)) == [(2, "image hash mismatch"), (3, "image missing"), (4, "entry hash mismatch")]
    shots.rows[0]["image_path"] = "../outside.png"
    assert shots.problems(str(tmp_path))[0] == (1, "image_path escapes the package")


def test_trail(spark, tmp_path):
    t = R.Trail("c", "order 7", started_at=AT)
    t.seed("a.example")
    n = t.fetch("https://a.example/", body_sha256="ab", title="Home")["citations"][0]
    t.extract("a registrant", "Jane", n)
    t.pivot("a.example", "b.example", "same registrant", depth=1)
    t.empty("https://register.example/", "companies", "register")
    t.filtered("info@a.example", "role account")
    t.refused("a broker", "denied class")
    t.imported("Maltego", "/x.csv", 3)
    t.infer("One owner", "shared registrant", (n,))
    t.resolved("a.example and b.example are one")
    assert t.cite("https://a.example/", "ab") == n and t.cite("https://a.example/", "cd") == 4 == len(t.sources)
    assert t.counts() == dict.fromkeys(R.STEP_KINDS, 1)
    with pytest.raises(ValueError):
        t.add("guess", "x")
    t.write(str(tmp_path / "out"))
    md = (tmp_path / "out" / "trail.md").read_text()
    assert "10 steps, 2 of them conclusions; 4 sources" in md and "[1] Home" in md and "same registrant" in md
    assert json.loads((tmp_path / "out" / "trail.json").read_text())["step_counts"]["seed"] == 1
    steps, sources = t.tables(spark)
    assert steps.count() == 10 and sources.count() == 4 and {r.kind: r.n for r in P.step_counts(steps).collect()} == t.counts()


def make(tmp_path, **more):
    return case.parse({"case_ref": "c", "authorization": "a", "seeds": ["jane@a.example"], "audit_path": str(tmp_path / "audit.jsonl"), "salt": "pepper", **more})


def test_audit_is_private_and_minimised(tmp_path):
    c = make(tmp_path)
    R.audit(c, "asked", url="https://x.example/jane@a.example", email="bob@b.example", detail={"names": ["bob"], "n": 3})
    R.audit(c, "done")
    lines = (tmp_path / "audit.jsonl").read_text().splitlines()
    assert len(lines) == 2 and "jane@a" not in lines[0] and "bob@b" not in lines[0] and json.loads(lines[0])["detail"]["n"] == 3
    assert os.stat(tmp_path / "audit.jsonl").st_mode & 0o777 == 0o600
    open_case = make(tmp_path, minimize=False)
    assert R.audit(open_case, "asked", email="bob@b.example")["email"] == "bob@b.example"


def test_gates_and_budgets(spark, tmp_path):
    rows = [(i, "domain", s, f"domain:{s}", "domain", o, f"domain:{o}") for i, s, o in [(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]]
    claims = spark.createDataFrame(rows, "claim_pos long, subject_kind string, subject_value string, subject_key string, object_kind string, object_value string, object_key string")
    seeds = spark.createDataFrame([("domain:a", "domain", "a")], "key string, kind string, value string")
    persons = G.Collector("people", ("domain",), lambda asked: claims.limit(0), person_scoped=True)
    table = G.over_claims(claims)
    found = G.expand(seeds, [table, persons], case=make(tmp_path, pivot_radius=2))
    assert found.gated == (("people", "collector people is not named"),) and found.requests == 3 and not found.stopped
    assert {r.key: r.depth for r in found.seen.collect()} == {"domain:a": 0, "domain:b": 1, "domain:c": 2}
    allowed = G.expand(seeds, [table, persons], case=make(tmp_path, pivot_radius=1, persona_collectors=["people"]))
    assert allowed.gated == () and allowed.requests == 4
    cut = G.expand(seeds, [table], case=make(tmp_path, max_requests=1))
    assert cut.stopped == "max_requests" and cut.requests == 1
    events = [json.loads(x)["event"] for x in (tmp_path / "audit.jsonl").read_text().splitlines()]
    assert events.count("collector_gated") == 1 and events.count("budget_stop") == 1
    with pytest.raises(case.PolicyError):
        G.expand(seeds, [G.Collector("x", ("domain",), lambda asked: claims, source_class="breach_corpus")])


def test_identifiers_as_they_were_met(spark):
    df = spark.createDataFrame([("domain", "pаypal.example"), ("domain", "Example.COM"), ("handle", "jane")], "kind string, raw string")
    got = [r.x for r in df.select(T.observed(F.col("kind"), F.col("raw")).alias("x")).collect()]
    assert [(x.key, x.observed_as, x.was_obfuscated) for x in got] == [("domain:paypal.example", "pаypal.example", True), ("domain:example.com", "Example.COM", False), ("handle:jane", None, False)]


def test_forbidden_addresses_are_listed_in_words(spark):
    d = spark.createDataFrame([("https://a/1", False, "record", "disallow"), ("https://a/2", True, "record", "allow"), ("https://a/3", False, "respect", "disallow")], "url string, allowed boolean, policy string, directive string")
    assert [(r.url, r.fetched) for r in P.disallowed(d).collect()] == [("https://a/1", True), ("https://a/3", False)]
    assert "2 addresses, of which 1" in P.fetch_statement("record", 2, 1) and "not read" in P.fetch_statement("ignore", 0, 0) and "not fetched" in P.fetch_statement("respect", 2, 0)
    assert "takes 40% off" in R.adjustment({"discounted_groups": 2, "reduction": 0.4, "classes": {"site_setup": 3}}) and "none" in R.adjustment({"discounted_groups": 0})
