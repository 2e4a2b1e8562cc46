import datetime as dt
import pathlib

import pytest

from provenor.operators import export as X
from provenor.operators import resolution as R

AT = dt.datetime(2024, 5, 1)
#: Subject, predicate, kind of the object (None: a literal), object.
SAID = [
    ("person_name:Jane Doe", "officer_of", "org_name", "Hidden Holdings"),
    ("org_name:Hidden Holdings", "legal_name", None, "Hidden Holdings Ltd"),
    ("org_name:Hidden Holdings", "registered_address", None, "1 Secret Lane"),
    ("domain:covert.example", "registrant", "email", "jane.doe@private.example"),
    ("domain:other.example", "registrant", "email", "jane.doe@private.example"),
]
SECRETS = ("jane", "doe", "hidden", "secret", "covert", "other.example", "private", "portal")


@pytest.fixture
def case(spark):
    rows = [(i, "case-7", s.split(":")[0], s.split(":", 1)[1], s, p, k, o, f"{k}:{o}" if k else None, "rdap", f"https://portal.example/{s}", 0.85, 1.0, AT, AT, f"rdap|{o}", "", f'{{"seen": "{o}"}}') for i, (s, p, k, o) in enumerate(SAID)]
    claims = spark.createDataFrame(rows, "claim_pos long, case_ref string, subject_kind string, subject_value string, subject_key string, predicate string, object_kind string, object_value string, object_key string, collector string, source_url string, reliability double, weight double, observed_at timestamp, retrieved_at timestamp, correlation_group string, dependence_class string, raw string")
    keys = sorted({s for s, *_ in SAID} | {f"{k}:{o}" for _, _, k, o in SAID if k})
    idents = spark.createDataFrame([("case-7", k, k.split(":")[0], k.split(":", 1)[1], i) for i, k in enumerate(keys)], "case_ref string, key string, kind string, value string, first_pos long")
    scored = spark.createDataFrame([("case-7", "domain:covert.example", "domain:other.example", 4.0, "STRONG_EVIDENCE")], "case_ref string, a string, b string, log_odds double, band string")
    rejected = spark.createDataFrame([("org_name:Hidden Holdings", "person_name:Jane Doe", R.MUST_NOT_LINK)], "a string, b string, reason string")
    own = spark.createDataFrame([("case-7", "member", "domain:other.example", "domain:covert.example", "")], "case_ref string, what string, a string, b string, reason string")
    members = R.membership(own, idents)
    return claims, idents, R.entities(members, scored, claims), members, scored, rejected


def written(folder):
    return {d.name: "".join(p.read_text() for p in sorted(d.glob("part-*"))) for d in pathlib.Path(folder).iterdir()}


def test_no_file_of_a_minimised_export_tells_a_raw_value(case, tmp_path):
    X.write_all(str(tmp_path / "out"), *case, salt=b"salt")
    texts = [p.read_text(errors="replace") for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert len(texts) > 6
    for secret in SECRETS:
        assert not any(secret in t.lower() for t in texts), secret
    whole = "".join(texts)
    assert whole.count("min:") > 20 and "officer_of" in whole and "case-7" in whole


def test_one_digest_for_nodes_and_edges(case, tmp_path):
    from provenor.operators.minimise import digest

    X.write_all(str(tmp_path / "out"), *case, salt=b"salt")
    files = written(tmp_path / "out")
    code = digest("domain:covert.example", b"salt")
    assert all(code in files[name] for name in ("graph.jsonl", "cypher", "indicators.jsonl", "report.md", "report.html", "map.mmd"))


def test_plain_export_has_all_parts(case, tmp_path):
    X.write_all(str(tmp_path / "out"), *case)
    files = [p.read_text() for p in (tmp_path / "out").rglob("part-*")]
    whole = "".join(files)
    assert "Jane Doe" in whole and '"what":"entity"' in whole and '"what":"identifier"' in whole and "Directorship" in whole
    md = next(t for t in files if t.startswith("## Summary"))
    assert all(f"## {x}" in md for x in ("Summary", "Pairs", "Entities", "Map", "Not merged", "Indicators", "Sources")) and "```mermaid" in md
