import hashlib
import re
import unicodedata

import duckdb

from provenor.functions import constants as K
from provenor.plans import queries as Q
from provenor.plans import views as V

SF = "/root/testdata/sf0.001"


def test_frontier_reaches_through_all_claims(spark):
    near = {}
    for r in V.claims_events(spark, SF).select("subject_key", "object_value").collect():
        thing = "handle:s" + r.object_value.split("-d")[0]
        near.setdefault(r.subject_key, set()).add(thing)
        near.setdefault(thing, set()).add(r.subject_key)
    want = {"handle:u1": 0}
    for depth in (1, 2):
        for k in [k for k, d in want.items() if d == depth - 1]:
            for x in near.get(k, ()):
                want.setdefault(x, depth)
    got = {r.key: r.depth for r in Q.QUERIES["frontier_bfs"](spark, SF).collect()}
    assert got == want and len(got) > 10


def plain_normal(text):
    for chars in (K.ZERO_WIDTH, K.BIDI):
        text = re.sub(f"[{re.escape(chars)}]", "", text)
    text = re.sub(K.CONTROLS, "", text)
    for old, new in ((K.HOMOGLYPHS_FROM, K.HOMOGLYPHS_TO), (K.PUNCTUATION_FROM, K.PUNCTUATION_TO)):
        text = text.translate(str.maketrans(old, new))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip()).lower()


def test_every_document_is_normalised(spark, tmp_path):
    texts = ["Plain  Text ", "Été à Paris", "Ｆull ﬁve", "ex​ample", "pаypal", "‎bidi", "", None, "Straße ①"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.normal for r in Q.QUERIES["normalize_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(plain_normal(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_every_address_is_judged(spark, tmp_path):
    texts = ["Write jane@a.example or INFO@a.example.", "none", None, "noreply7@b.example, bob@b.example; bob@b.example"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.claim_pos: (r.address, r.verdict) for r in Q.QUERIES["ingest_verdict"](spark, str(tmp_path)).collect()}
    assert got == {
        100: ("jane@a.example", "keep"), 101: ("info@a.example.", "drop"),
        3000100: ("noreply7@b.example", "drop"), 3000101: ("bob@b.example", "keep"), 3000102: ("bob@b.example", "keep"),
    }


def test_addresses_match_their_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.sql(Q.ORACLE["ingest_verdict"]).fetchall())
    assert want and sorted(tuple(r) for r in Q.QUERIES["ingest_verdict"](spark, "/root/testdata/sf0.01").collect()) == want
