"""Making the record of a case: captures of what was found, not found and not asked; screenshots; the trail; the audit log.

Rows are made here and chained by ``provenance``. The trail, the screenshots and the audit of a case are written by
whoever runs it, one after the other; they are as long as a person's work, so they are kept on the driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.operators.minimise import minimise_audit
from provenor.operators.provenance import screenshot_hash

CAPTURE = "case_ref string, sequence long, url string, method string, requested_at string, status int, body binary, collector string, outcome string, note string, request_headers map<string,string>, response_headers map<string,string>, egress string"


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


# --- captures -------------------------------------------------------------


def capture(case_ref: str, sequence: int, url: str, status: int | None, body: bytes | str | None, method: str = "GET", collector: str = "", outcome: str | None = None, note: str = "", at: str | None = None, egress: str = "", sent: dict | None = None, got: dict | None = None) -> tuple:
    """A row of CAPTURE. Without an outcome, digesting tells it from the status and the body."""
    raw = body.encode() if isinstance(body, str) else body or b""
    return (case_ref, sequence, url, method, at or now(), status, bytearray(raw), collector, outcome, note, sent or {}, got or {}, egress)


def negative(case_ref: str, sequence: int, url: str, collector: str, note: str, status: int | None = 200, at: str | None = None) -> tuple:
    """A question that was asked and had no answer."""
    return capture(case_ref, sequence, url, status, b"", collector=collector, outcome="empty", note=note, at=at)


def refusal(case_ref: str, sequence: int, target: str, collector: str, reason: str, at: str | None = None) -> tuple:
    """A source that was not asked, and why."""
    return capture(case_ref, sequence, target, None, b"", collector=collector, outcome="refused", note=reason, at=at)


def captures(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CAPTURE)


# --- screenshots ----------------------------------------------------------


@dataclass
class Shots:
    """Renderings of pages, chained by themselves. Taking them is a browser's work; this is their log."""

    rows: list[dict] = field(default_factory=list)

    def add(self, url: str, image: bytes | None, image_path: str = "", parent_body_sha256: str = "", status: str = "captured", captured_at: str | None = None, note: str = "") -> dict:
        row = {
            "url": url, "captured_at": captured_at or now(), "status": status, "image_sha256": hashlib.sha256(image).hexdigest() if image else "", "image_bytes": len(image or b""), "image_path": image_path,
            "parent_body_sha256": parent_body_sha256, "sequence": len(self.rows) + 1, "prev_hash": self.rows[-1]["entry_hash"] if self.rows else "", "note": note,
        }
        row["entry_hash"] = screenshot_hash(row)
        self.rows.append(row)
        return row

    def problems(self, root: str) -> list[tuple[int, str]]:
        """What does not verify: images that are missing, changed or outside ``root``, broken links, changed rows."""
        out, before, base = [], "", os.path.realpath(root)
        for r in self.rows:
            if r["image_sha256"]:
                path = os.path.realpath(os.path.join(base, r["image_path"]))
                if os.path.commonpath([base, path]) != base:
                    out.append((r["sequence"], "image_path escapes the package"))
                    before = r["entry_hash"]
                    continue
                if not os.path.exists(path):
                    out.append((r["sequence"], "image missing"))
                else:
                    with open(path, "rb") as f:
                        if hashlib.sha256(f.read()).hexdigest() != r["image_sha256"]:
                            out.append((r["sequence"], "image hash mismatch"))
            if r["prev_hash"] != before:
                out.append((r["sequence"], "chain break"))
            if screenshot_hash(r) != r["entry_hash"]:
                out.append((r["sequence"], "entry hash mismatch"))
            before = r["entry_hash"]
        return out

    def text(self) -> str:
        return "".join(f"{r['sequence']:>4}  {r['captured_at']}  {r['status']:<9} {r['image_sha256'] or '-':<64}  {r['url']}\n" for r in self.rows)

    def json(self) -> str:
        return json.dumps({"schema": "screenshots/1", "chain_head": self.rows[-1]["entry_hash"] if self.rows else "", "shots": self.rows}, sort_keys=True)


# --- the trail ------------------------------------------------------------

#: Kinds of steps; all but the last two are things observed or done, not concluded.
STEP_KINDS = ("seed", "fetch", "extract", "pivot", "query_empty", "filter", "refusal", "import", "inference", "resolution")
ANALYTICAL = ("inference", "resolution")


@dataclass
class Trail:
    """What was done, in order, each step with its sources."""

    case_ref: str
    authorization: str = ""
    started_at: str = field(default_factory=now)
    steps: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)

    def cite(self, url: str, body_sha256: str = "", status: int | None = None, collector: str = "", title: str = "", at: str | None = None) -> int:
        """The number of a source: one for each address and body."""
        for s in self.sources:
            if (s["url"], s["body_sha256"]) == (url, body_sha256):
                return s["number"]
        self.sources.append({"number": len(self.sources) + 1, "url": url, "retrieved_at": at or now(), "body_sha256": body_sha256, "status": status, "collector": collector, "title": title})
        return len(self.sources)

    def add(self, kind: str, description: str, detail: str = "", citations: tuple[int, ...] = (), depth: int = 0, at: str | None = None) -> dict:
        if kind not in STEP_KINDS:
            raise ValueError(f"unknown kind of step: {kind}")
        self.steps.append({"number": len(self.steps) + 1, "kind": kind, "at": at or now(), "description": description, "detail": detail, "citations": list(citations), "depth": depth})
        return self.steps[-1]

    def seed(self, what: str) -> dict:
        return self.add("seed", f"Started from {what}")

    def fetch(self, url: str, depth: int = 0, **source) -> dict:
        return self.add("fetch", f"Fetched {source.get('title') or url}", citations=(self.cite(url, **source),), depth=depth)

    def extract(self, what: str, value: str, citation: int, depth: int = 0) -> dict:
        return self.add("extract", f"Found {what}: {value}", citations=(citation,), depth=depth)

    def pivot(self, a: str, b: str, why: str, depth: int = 0) -> dict:
        return self.add("pivot", f"Went on from {a} to {b}", why, depth=depth)

    def empty(self, url: str, what: str, collector: str = "", depth: int = 0) -> dict:
        return self.add("query_empty", f"Asked for {what}: nothing there", citations=(self.cite(url, status=200, collector=collector),), depth=depth)

    def filtered(self, what: str, reason: str, depth: int = 0) -> dict:
        return self.add("filter", f"Left out {what}", reason, depth=depth)

    def refused(self, what: str, reason: str, depth: int = 0) -> dict:
        return self.add("refusal", f"Did not ask {what}", reason, depth=depth)

    def imported(self, system: str, path: str, count: int) -> dict:
        return self.add("import", f"Took over {count} claims of {system}", path, (self.cite(path, title=system, collector=system.lower()),))

    def infer(self, conclusion: str, basis: str = "", citations: tuple[int, ...] = (), depth: int = 0) -> dict:
        return self.add("inference", conclusion, basis, citations, depth)

    def resolved(self, conclusion: str, basis: str = "", citations: tuple[int, ...] = ()) -> dict:
        return self.add("resolution", conclusion, basis, citations)

    def counts(self) -> dict[str, int]:
        return {k: n for k in STEP_KINDS if (n := sum(s["kind"] == k for s in self.steps))}

    def markdown(self) -> str:
        thought = sum(s["kind"] in ANALYTICAL for s in self.steps)
        out = [f"# Trail of {self.case_ref}", "", f"{len(self.steps)} steps, {thought} of them conclusions; {len(self.sources)} sources. Started {self.started_at}." + (f" By authority of {self.authorization}." if self.authorization else ""), "", "## Steps", ""]
        for s in self.steps:
            cited = "".join(f" [{n}]" for n in s["citations"])
            out.append(f"{s['number']}. {'  ' * s['depth']}{s['at']} {s['kind']}: {s['description']}{cited}" + (f" ({s['detail']})" if s["detail"] else ""))
        out += ["", "## Sources", ""] + [f"[{s['number']}] {s['title'] or s['url']}, {s['url']}, {s['retrieved_at']}" + (f", SHA-256 {s['body_sha256']}" if s["body_sha256"] else "") for s in self.sources]
        return "\n".join(out)

    def json(self) -> str:
        return json.dumps({"case_ref": self.case_ref, "authorization": self.authorization, "started_at": self.started_at, "step_counts": self.counts(), "steps": self.steps, "sources": self.sources}, sort_keys=True)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Steps and sources as tables, to be joined with those of other cases."""
        step = "number long, kind string, at string, description string, detail string, citations array<long>, depth int"
        source = "number long, url string, retrieved_at string, body_sha256 string, status int, collector string, title string"
        case = F.lit(self.case_ref).alias("case_ref")
        return spark.createDataFrame(self.steps, step).select(case, "*"), spark.createDataFrame(self.sources, source).select(case, "*")

    def write(self, folder: str) -> None:
        private_file(os.path.join(folder, "trail.md"), self.markdown())
        private_file(os.path.join(folder, "trail.json"), self.json())


# --- files of one's own -----------------------------------------------------


def private_file(path: str, data: str | bytes, append: bool = False) -> None:
    """Write a local file that only its owner may read (0600), in folders only they may enter (0700)."""
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | (os.O_APPEND if append else os.O_TRUNC), 0o600)
    with os.fdopen(handle, "wb") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(data.encode() if isinstance(data, str) else data)


def audit(case, event: str, values: set[str] = frozenset(), **fields) -> dict:
    """A line of the case's audit log, minimised where the case asks for that, appended where it names a file.

    ``values``: what is personal under any field's name: the seeds and what was found from them.
    """
    salt = case.store_salt()
    told = fields if salt is None else minimise_audit(fields, set(values) | set(case.seeds), salt)
    line = {"ts": now(), "case_ref": case.case_ref, "authorization": case.authorization, "event": event, **told}
    if case.audit_path:
        private_file(case.audit_path, json.dumps(line, default=str) + "\n", append=True)
    return line


# --- what goes with a package -------------------------------------------------

TIMESTAMP = """# When this was made

The chain shows that nothing in the package was changed since; it does not show when it was made, for
the clock is the maker's. A time-stamping authority (RFC 3161) can attest that:

    openssl ts -query -data evidence_manifest.json -sha256 -cert -out request.tsq
    curl -H "Content-Type: application/timestamp-query" --data-binary @request.tsq <authority> -o response.tsr
    openssl ts -verify -data evidence_manifest.json -in response.tsr -CAfile authority.pem

Manifest: {manifest_hash}
"""


def declaration(manifest: dict, problems: list, findings: str = "") -> str:
    """A draft for the person who ran the collection, to be gone over by a lawyer."""
    counts = ", ".join(f"{n} {o}" for o, n in (manifest.get("outcomes") or {}).items())
    facts = [
        "I ran the collection that this package records. My name and position: ____",
        f"It was done for case {manifest.get('case_ref')} by authority of {manifest.get('authorization') or '____'}.",
        f"It began at {manifest.get('opened_at') or '____'} and ended at {manifest.get('closed_at') or '____'}.",
        f"It made {manifest.get('capture_count', 0)} requests: {counts or 'none'}.",
        "Every answer is kept as it came, in a file named by its SHA-256. Each entry of the manifest holds the hash of the one before; the last one is " + (manifest.get("manifest_hash") or "empty") + ".",
        "When this was written the package " + ("verified." if not problems else f"did not verify: {'; '.join(map(str, problems))}."),
        "What was collected is one thing; conclusions from it are opinions reached by a documented method, and are marked as such.",
        findings or "Findings: ____",
    ]
    return "# Declaration (draft, not legal advice)\n\n" + "\n".join(f"{n}. {x}" for n, x in enumerate(facts, 1)) + "\n\nSigned: ____ Date: ____ Place: ____\n"


#: Checks a package with nothing but Python; it is written beside the manifest.
VERIFIER = '''"""Checks this package: python verify.py. Needs nothing but Python."""
import hashlib
import json
import os
import sys

FIELDS = {fields!r}
ENVELOPE = {envelope!r}
root = os.path.realpath(os.path.dirname(os.path.abspath(__file__)))
pack = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
doc, before, problems = json.load(open(os.path.join(root, "evidence_manifest.json"))), "", []
for c in doc["captures"]:
    body = {{k: {schema!r} if k == "schema" else dict(sorted((c.get(k) or {{}}).items())) if k.endswith("_headers") else c.get(k) for k in FIELDS}}
    if c["body_path"]:
        path = os.path.realpath(os.path.join(root, c["body_path"]))
        if os.path.commonpath([root, path]) != root:
            problems.append((c["sequence"], "body_path escapes the package"))
            before = c["entry_hash"]
            continue
        if not os.path.exists(path):
            problems.append((c["sequence"], "body missing"))
        elif hashlib.sha256(open(path, "rb").read()).hexdigest() != c["body_sha256"]:
            problems.append((c["sequence"], "body hash mismatch"))
    if c["prev_hash"] != before:
        problems.append((c["sequence"], "chain break"))
    if pack(body) != c["entry_hash"]:
        problems.append((c["sequence"], "entry hash mismatch"))
    before = c["entry_hash"]
if before != doc["manifest_hash"]:
    problems.append((None, "chain head mismatch"))
if len(doc["captures"]) != doc["capture_count"]:
    problems.append((None, "capture count mismatch"))
if pack({{k: doc.get(k) for k in ENVELOPE}}) != doc.get("envelope_digest"):
    problems.append((None, "envelope digest mismatch"))
for number, what in problems:
    print(number, what)
print("verified" if not problems else f"{{len(problems)}} problems")
sys.exit(bool(problems))
'''


def adjustment(pair: dict) -> str:
    """In words, how far evidence of one cause was discounted for a pair (a row of assessments)."""
    if not pair["discounted_groups"]:
        return "All groups of evidence have causes of their own; none is discounted."
    lines = [f"{pair['discounted_groups']} groups share a cause with a stronger one; that takes {pair['reduction']:.0%} off the evidence.", "", "| Cause | Groups |", "|---|---:|"]
    return "\n".join(lines + [f"| {k} | {n} |" for k, n in sorted(pair["classes"].items(), key=lambda x: (-x[1], x[0]))] + ["", "The discounts are reasoned, not fitted: read the figure as an order."])


def case_record(case) -> str:
    return json.dumps(asdict(case) | {"salt": "kept apart" if case.salt else ""}, sort_keys=True)
