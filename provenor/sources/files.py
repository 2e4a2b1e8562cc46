"""Reading what a case brings along: labelled pairs, blacklists, evidence packages, seeds; and writing."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.functions.text import identifier_value, key, seed
from provenor.operators import ingest, provenance, record

LABELLED = "a string, b string, label boolean, predicted double, log_odds double, band string, independent_groups int, label_source string, case_ref string, notes string"
MANIFEST = (
    "schema string, case_ref string, authorization string, opened_at string, closed_at string, capture_count long, manifest_hash string, envelope_digest string, captures array<struct<"
    "sequence:long,url:string,method:string,requested_at:string,status:int,body_sha256:string,body_bytes:long,body_path:string,collector:string,outcome:string,note:string,"
    "request_headers:map<string,string>,response_headers:map<string,string>,egress:string,prev_hash:string,entry_hash:string>>"
)


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array in one file, or a JSON object a line."""
    first = spark.read.text(path).where("trim(value) <> ''").head()
    return spark.read.schema(LABELLED).json(path, multiLine=bool(first and first.value.lstrip().startswith("[")))


def save_labelled_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return ingest.blacklist(spark.read.text(path))


def seeds(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, kind, value of seeds as typed."""
    kind, value = seed(F.trim(F.col(column)))
    out = lines.where(F.trim(F.col(column)) != "").select(kind.alias("kind"), value.alias("raw"))
    out = out.select("kind", identifier_value(F.col("kind"), F.col("raw")).alias("value"))
    return out.select(key(F.col("kind"), F.col("value")).alias("key"), "kind", "value").distinct()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/evidence_manifest.json", multiLine=True)


def package_entries(spark: SparkSession, root: str) -> DataFrame:
    return manifest(spark, root).select("case_ref", F.explode("captures").alias("c")).select("case_ref", "c.*")


def package_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(body_path, body) of the files in the package."""
    files = spark.read.format("binaryFile").load(f"{root}/bodies/*")
    return files.select(F.concat(F.lit("bodies/"), F.element_at(F.split("path", "/"), -1)).alias("body_path"), F.col("content").alias("body"))


def verify_package(spark: SparkSession, root: str) -> DataFrame:
    """All problems of an evidence package, read as data only."""
    entries = package_entries(spark, root)
    declared = manifest(spark, root).select("case_ref", F.col("manifest_hash").alias("chain_head"), "capture_count")
    problems = provenance.verify(entries, package_bodies(spark, root)).unionByName(provenance.verify_heads(entries, declared))
    raw = json.loads("".join(r.value for r in spark.read.text(f"{root}/evidence_manifest.json").collect()))
    if provenance.envelope_digest(raw) != raw.get("envelope_digest"):
        bad = spark.createDataFrame([(raw.get("case_ref"), None, "envelope digest mismatch")], "case_ref string, sequence long, problem string")
        problems = problems.unionByName(bad)
    return problems


def write_package(captures: DataFrame, root: str, shots: record.Shots | None = None, **envelope) -> None:
    """A case's chained captures, bodies and manifest, with a draft declaration, how to have it time-stamped and a verifier.

    The manifest is one file, as verifiers expect. Where the folder is a local one, only its owner may read it.
    """
    spark = captures.sparkSession
    entries = provenance.chain(provenance.with_digests(captures)).orderBy("sequence").collect()
    rows = [{k: v for k, v in e.asDict().items() if k != "case_ref"} for e in entries]
    doc = {"schema": "manifest/1", "case_ref": entries[0]["case_ref"] if entries else envelope.get("case_ref"), **envelope, "capture_count": len(rows), "manifest_hash": rows[-1]["entry_hash"] if rows else "", "captures": rows}
    doc["outcomes"] = {o: sum(r["outcome"] == o for r in rows) for o in ("success", "empty", "error", "refused")} | (envelope.get("outcomes") or {})
    doc["envelope_digest"] = provenance.envelope_digest(doc)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(name: str, data: bytes) -> None:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
        out.write(bytearray(data))
        out.close()

    for b in provenance.bodies(captures).toLocalIterator():
        put(f"bodies/{b.body_sha256}", bytes(b.body))
    put("evidence_manifest.json", json.dumps(doc, sort_keys=True).encode())
    put("TIMESTAMP.md", record.TIMESTAMP.format(manifest_hash=doc["manifest_hash"]).encode())
    problems = [f"{r.sequence}: {r.problem}" for r in verify_package(spark, root).collect()]
    put("DECLARATION_DRAFT.md", record.declaration(doc, problems).encode())
    put("verify.py", record.VERIFIER.format(fields=provenance.ENTRY_FIELDS, envelope=provenance.ENVELOPE_FIELDS, schema=provenance.ENTRY_SCHEMA).encode())
    if shots is not None:
        put("screenshots.json", shots.json().encode())
        put("SCREENSHOTS.txt", shots.text().encode())
    if not root.startswith(("hdfs:", "s3")) and os.path.isdir(local := root.removeprefix("file://")):
        for folder, _, names in os.walk(local):
            os.chmod(folder, 0o700)
            for name in names:
                os.chmod(os.path.join(folder, name), 0o600)
