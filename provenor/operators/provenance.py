"""Tamper-evident capture chains, trails of steps, and fetch decisions.

Captures have case_ref, sequence, url, method, requested_at, status, body, collector, note,
request_headers, response_headers, egress. A chain is one case in order of sequence; building
one is sequential by nature, so a case is one group.
"""

from __future__ import annotations

import hashlib
import json
import urllib.robotparser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an entry's hash covers. Names, order by name, compact JSON.
ENTRY_FIELDS = (
    "schema", "sequence", "url", "method", "requested_at", "status", "body_sha256", "body_bytes", "body_path", "collector", "outcome", "note",
    "request_headers", "response_headers", "egress", "prev_hash",
)
ENTRY_SCHEMA = "capture/2"
# Fields that the envelope's digest covers.
ENVELOPE_FIELDS = ("schema", "case_ref", "authorization", "opened_at", "closed_at", "capture_count", "manifest_hash", "environment", "fetch_policy", "outcomes", "notice", "retention_expiry")
# Words of errors that are the collecting machine's own.
LOCAL_FAILURES = (
    "name or service not known", "temporary failure in name resolution", "nodename nor servname", "does not resolve", "no address associated",
    "getaddrinfo", "proxy", "tunnel connection failed", "network is unreachable", "no route to host", "connection refused",
)


def entry_hash(entry: dict) -> str:
    body = {k: ENTRY_SCHEMA if k == "schema" else dict(sorted((entry.get(k) or {}).items())) if k.endswith("_headers") else entry.get(k) for k in ENTRY_FIELDS}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def envelope_digest(manifest: dict) -> str:
    return hashlib.sha256(json.dumps({k: manifest.get(k) for k in ENVELOPE_FIELDS}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def outcome(status: Column, size: Column, error: Column | None = None) -> Column:
    failed = status.isNull() | (status >= 400)
    return F.when(failed if error is None else failed | error.isNotNull(), "error").when(size == 0, "empty").otherwise("success")


def bodies(captures: DataFrame) -> DataFrame:
    """(body_sha256, body): each body once."""
    return captures.withColumn("body_sha256", F.sha2("body", 256)).groupBy("body_sha256").agg(F.first("body").alias("body"))


def with_digests(captures: DataFrame) -> DataFrame:
    size = F.octet_length("body")
    told = outcome(F.col("status"), size)
    if "outcome" in captures.columns:
        # what the recorder says: not there (empty), or not asked (refused)
        told = F.coalesce("outcome", told)
    return captures.withColumns({"body_sha256": F.sha2("body", 256), "body_bytes": size.cast("bigint"), "outcome": told}).withColumn("body_path", F.when(size > 0, F.concat(F.lit("bodies/"), "body_sha256")).otherwise("")).drop("body")


_ENTRY = "case_ref string, sequence long, url string, method string, requested_at string, status int, body_sha256 string, body_bytes long, body_path string, collector string, outcome string, note string, request_headers map<string,string>, response_headers map<string,string>, egress string, prev_hash string, entry_hash string"


def chain(captures: DataFrame) -> DataFrame:
    """Digested captures with prev_hash and entry_hash."""
    columns = [c.split(" ")[0] for c in _ENTRY.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prev, rows = "", []
        for row in pdf.sort_values("sequence").to_dict("records"):
            row = {k: None if not isinstance(v, (dict, list)) and pd.isna(v) else v for k, v in row.items()}
            row = {**row, "status": None if row["status"] is None else int(row["status"]), "prev_hash": prev}
            prev = row["entry_hash"] = entry_hash(row)
            rows.append(row)
        return pd.DataFrame(rows, columns=columns)

    have = captures.columns
    filled = captures.select(*[F.col(c) if c in have else F.lit("").alias(c) if kind == "string" else F.create_map().cast(kind).alias(c) for c, kind in (x.split(" ") for x in _ENTRY.split(", ")) if c not in ("prev_hash", "entry_hash")])
    return filled.groupBy("case_ref").applyInPandas(run, _ENTRY)


def heads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("case_ref").agg(F.max_by("entry_hash", "sequence").alias("chain_head"), F.count("*").alias("captures"))


def _rehash(rows: pd.DataFrame) -> pd.Series:
    out = []
    for r in rows.to_dict("records"):
        r["status"] = None if pd.isna(r["status"]) else int(r["status"])
        out.append(entry_hash(r))
    return pd.Series(out)


def _escapes(paths: pd.Series) -> pd.Series:
    """Whether a relative path leaves its root."""

    def leaves(p: str) -> bool:
        depth = 0
        for part in PurePosixPath(p or "").parts:
            depth += -1 if part == ".." else 0 if part == "." else 1
            if depth < 0 or part.startswith("/"):
                return True
        return False

    return paths.map(leaves)


def verify(entries: DataFrame, found_bodies: DataFrame | None = None) -> DataFrame:
    """(case_ref, sequence, problem): broken links, changed entries, paths that leave the package, wrong or missing bodies."""
    before = F.lag("entry_hash", 1, "").over(W.partitionBy("case_ref").orderBy("sequence"))
    fields = [c for c in ENTRY_FIELDS if c != "schema"]
    out = entries.withColumns({"link": before, "again": F.pandas_udf(_rehash, "string")(F.struct(*fields)), "leaves": F.pandas_udf(_escapes, "boolean")(F.col("body_path"))})
    if found_bodies is not None:
        digest = found_bodies.select("body_path", F.sha2("body", 256).alias("found"))
        out = out.join(digest, "body_path", "left")
    else:
        out = out.withColumn("found", F.col("body_sha256"))
    has = F.col("body_path") != ""
    problems = [
        (F.col("leaves"), "body_path escapes the package"),
        (has & ~F.col("leaves") & F.col("found").isNull(), "body missing"),
        (has & ~F.col("leaves") & (F.col("found") != F.col("body_sha256")), "body hash mismatch"),
        (~F.col("leaves") & (F.col("prev_hash") != F.col("link")), "chain break"),
        (~F.col("leaves") & (F.col("again") != F.col("entry_hash")), "entry hash mismatch"),
    ]
    listed = F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in problems]))
    return out.select("case_ref", "sequence", F.explode(listed).alias("problem"))


def verify_heads(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """Problems of (case_ref, chain_head, capture_count): truncated or lengthened chains. A case without captures has the head ''."""
    own = heads(entries).select("case_ref", F.col("chain_head").alias("own"), F.col("captures").alias("n"))
    both = declared.select("case_ref", "chain_head", "capture_count").join(own, "case_ref", "left")
    problems = [(F.coalesce("own", F.lit("")) != F.col("chain_head"), "chain head mismatch"), (F.coalesce("n", F.lit(0)) != F.col("capture_count"), "capture count mismatch")]
    return both.select("case_ref", F.lit(None).cast("bigint").alias("sequence"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in problems]))).alias("problem"))


def outcome_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("outcome").agg(F.count("*").alias("n"))


def screenshot_hash(row: dict) -> str:
    """The fields, and JSON with spaces, unlike captures."""
    fields = ("url", "captured_at", "status", "image_sha256", "image_bytes", "parent_body_sha256", "sequence", "prev_hash")
    return hashlib.sha256(json.dumps({k: row.get(k) for k in fields}, sort_keys=True).encode()).hexdigest()


def citations(sources: DataFrame) -> DataFrame:
    """(case_ref, number, url, body_sha256): sources numbered by first sight of (url, body)."""
    first = sources.groupBy("case_ref", "url", "body_sha256").agg(F.min("pos").alias("pos"))
    return first.select("case_ref", F.row_number().over(W.partitionBy("case_ref").orderBy("pos")).cast("bigint").alias("number"), "url", "body_sha256")


def steps(events: DataFrame) -> DataFrame:
    """Number the steps of each case in order of pos."""
    return events.withColumn("number", F.row_number().over(W.partitionBy("case_ref").orderBy("pos")).cast("bigint"))


def step_counts(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("kind").agg(F.count("*").alias("n"))


def trail_markdown(numbered: DataFrame, cited: DataFrame, case_ref: str) -> str:
    """One case's trail, read in order."""
    lines = [f"# Trail of {case_ref}", ""]
    lines += [f"{r.number}. {r.kind}: {r.description}" for r in numbered.where(F.col("case_ref") == case_ref).orderBy("number").toLocalIterator()]
    lines += ["", "## Sources", ""]
    return "\n".join(lines + [f"[{r.number}] {r.url}" for r in cited.where(F.col("case_ref") == case_ref).orderBy("number").toLocalIterator()])


def local_failure(error: Column) -> Column:
    return F.lower(error).rlike("|".join(LOCAL_FAILURES))


def _robots(text: pd.Series, url: pd.Series, agent: pd.Series) -> pd.DataFrame:
    parsed: dict[str, urllib.robotparser.RobotFileParser] = {}
    rows = []
    for t, u, a in zip(text, url, agent, strict=True):
        if t is None:
            rows.append((True, None))
            continue
        if t not in parsed:
            parsed[t] = urllib.robotparser.RobotFileParser()
            parsed[t].parse(t.splitlines())
        rows.append((parsed[t].can_fetch(a, u), parsed[t].crawl_delay(a)))
    return pd.DataFrame(rows, columns=["allowed", "crawl_delay"])


def fetch_decisions(urls: DataFrame, robots: DataFrame, policy: str = "record", agent: str = "*") -> DataFrame:
    """(url, allowed, policy, directive, crawl_delay) from urls (url) and answers (scheme, host, status, text, error).

    No file means no rules; an answer that failed on the site's side means none may be fetched;
    one that failed on this side says nothing about the site. Policy ``record`` fetches all the same.
    """
    scheme, host = F.coalesce(F.parse_url(F.col("url"), F.lit("PROTOCOL")), F.lit("https")), F.parse_url(F.col("url"), F.lit("HOST"))
    port = F.regexp_extract(F.col("url"), r"^[a-z]+://[^/]*?(:[0-9]+)(?:/|$)", 1)
    out = urls.withColumns({"scheme": scheme, "host": F.concat(host, port)})
    if policy == "ignore":
        return out.select("url", F.lit(True).alias("allowed"), F.lit(policy).alias("policy"), F.lit("not checked").alias("directive"), F.lit(None).cast("double").alias("crawl_delay"))
    out = out.join(robots.select("scheme", "host", "status", "text", "error", F.lit(True).alias("asked")), ["scheme", "host"], "left")
    rules = (F.col("status") == 200) & (F.coalesce("text", F.lit("")) != "")
    out = out.withColumn("r", F.pandas_udf(_robots, "struct<allowed:boolean,crawl_delay:double>")(F.when(rules, F.col("text")), F.col("url"), F.lit(agent)))
    directive = (
        F.when(F.col("host").isNull(), "n/a").when(rules, F.when(F.col("r.allowed"), "allow").otherwise("disallow"))
        .when(local_failure(F.coalesce("error", F.lit(""))), "unreachable_local").when(F.col("asked").isNull() | F.col("status").isNull() | (F.col("status") >= 500), "unreachable")
        .otherwise("unavailable")
    )
    out = out.withColumn("directive", directive)
    allowed = F.when(F.col("directive") == "unreachable", policy == "record").when(F.col("directive") == "disallow", F.lit(False)).otherwise(F.lit(True))
    return out.select("url", allowed.alias("allowed"), F.lit(policy).alias("policy"), "directive", F.when(rules, F.col("r.crawl_delay")).alias("crawl_delay"))


def disallowed(decisions: DataFrame, limit: int = 100) -> DataFrame:
    """(url, directive, fetched): the first that the rules forbid, for the manifest."""
    return decisions.where(~F.col("allowed")).select("url", "directive", should_fetch().alias("fetched")).orderBy("url").limit(limit)


def fetch_statement(policy: str, forbidden: int, fetched: int) -> str:
    """In words, what was done about the sites' rules."""
    if policy == "ignore":
        return "The sites' rules for robots were not read, so nothing is said of what they forbid."
    said = f"The rules of each site were read. They forbid {forbidden} addresses"
    return f"{said}, which were not fetched." if policy == "respect" else f"{said}, of which {fetched} were fetched and marked so."


def should_fetch() -> Column:
    return F.col("allowed") | (F.col("policy") != "respect")


def fetch_summary(decisions: DataFrame) -> DataFrame:
    no = ~F.col("allowed")
    return decisions.agg(F.count("*").alias("urls_evaluated"), F.count_if(no).alias("disallowed"), F.count_if(no & should_fetch()).alias("fetched_despite_disallow"), F.count_if(no & ~should_fetch()).alias("skipped"))
