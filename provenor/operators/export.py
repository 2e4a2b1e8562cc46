"""What leaves a case: indicators, property-graph and relationship exports, maps and reports."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.functions import constants as K
from provenor.functions import text as T
from provenor.functions.text import lookup
from provenor.operators import minimise as M

# Sources with declared terms.
SOURCE_NAMES = {
    "gleif": "GLEIF Global LEI Index", "sec_edgar": "U.S. SEC EDGAR", "companies_house_uk": "UK Companies House", "opencorporates": "OpenCorporates",
    "opensanctions_yente": "OpenSanctions", "crtsh": "crt.sh / Certificate Transparency", "rdap": "RDAP (IANA bootstrap)",
    "sellers_json": "IAB Tech Lab sellers.json", "ads_txt_owner": "IAB Tech Lab ads.txt", "wayback": "Internet Archive Wayback Machine",
    "nyc_acris": "NYC ACRIS via NYC Open Data", "uk_overseas_property": "HM Land Registry", "uspto_trademark": "USPTO",
}


def ends(claims: DataFrame) -> DataFrame:
    """Each claim under the subject and, where it is an identifier, the object; once if they are one."""
    keys = F.array_distinct(F.array_compact(F.array("subject_key", F.when(F.col("object_kind").isNotNull(), F.col("object_key")))))
    return claims.withColumn("key", F.explode(keys))


def indicators(claims: DataFrame, idents: DataFrame) -> DataFrame:
    """(key, label, value, claims, collectors, first_seen, all_demoted, self_published)."""
    own = F.array_contains(F.array(*[F.lit(x) for x in K.SELF_PUBLISHED]), F.split_part("correlation_group", F.lit("|"), F.lit(1)))
    by = ends(claims).groupBy("key").agg(
        F.count("*").alias("claims"), F.slice(F.array_sort(F.collect_set("collector")), 1, 3).alias("collectors"), F.min("retrieved_at").alias("first_seen"),
        F.bool_and(F.col("weight") <= 0).alias("all_demoted"), F.bool_and(own).alias("self_published"),
    )
    named = idents.where(F.col("kind").isin(*K.INDICATOR_LABELS)).select("key", "kind", "value")
    return by.join(named, "key").select("key", lookup(K.INDICATOR_LABELS, F.col("kind")).alias("label"), "value", "claims", "collectors", "first_seen", "all_demoted", "self_published")


def source_attribution(claims: DataFrame) -> DataFrame:
    """(source, name): the sources used, and what is known of them."""
    used = claims.select(F.split_part("collector", F.lit(":"), F.lit(1)).alias("source")).distinct()
    return used.withColumn("name", lookup(SOURCE_NAMES, F.col("source"), "Terms not declared"))


def seller_relationships(claims: DataFrame) -> DataFrame:
    """(key, relationships): the labels that ``raw.relationship`` gives to each seller identifier."""
    said = F.upper(F.get_json_object("raw", "$.relationship"))
    return ends(claims.withColumn("said", said)).where("key like 'seller_id:%' and said is not null").groupBy("key").agg(F.array_sort(F.collect_set("said")).alias("relationships"))


def map_edges(scored: DataFrame, limit: int = K.MAP_EDGES) -> DataFrame:
    """The strongest supported pairs, at most ``limit``."""
    return scored.where(F.col("band") != K.LOWEST_BAND).orderBy(F.desc("log_odds"), "a", "b").limit(limit).select("a", "b", "log_odds", "band")


def mermaid(edges: DataFrame) -> str:
    rows = edges.collect()
    names = {k: f"n{i}" for i, k in enumerate(dict.fromkeys(x for r in rows for x in (r.a, r.b)))}
    label = lambda k: (k if len(k) <= 44 else k[:43] + "…").replace('"', "'")
    lines = ["graph LR", *(f'  {n}["{label(k)}"]' for k, n in names.items())]
    return "\n".join(lines + [f"  {names[r.a]} {'==>' if r.band == 'STRONG_EVIDENCE' else '-->'} {names[r.b]}" for r in rows])


def ftm_entities(ents: DataFrame, members: DataFrame) -> DataFrame:
    """(id, schema, properties, datasets): FollowTheMoney entities."""
    prop = lookup(K.FTM_PROPERTY, F.col("kind"))
    by = members.withColumn("property", prop).where("property is not null").groupBy("case_ref", "cluster", "property").agg(F.array_sort(F.collect_set("value")).alias("vals"))
    props = by.groupBy("case_ref", "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "vals")))).alias("properties"))
    out = ents.join(props, ["case_ref", "cluster"], "left")
    both = F.map_concat(F.coalesce("attributes", F.create_map().cast("map<string,array<string>>")), F.coalesce("properties", F.create_map().cast("map<string,array<string>>")))
    return out.select(F.concat(F.lit("ent-"), "entity_id").alias("id"), lookup(K.FTM_SCHEMA, F.col("type")).alias("schema"), both.alias("properties"), F.array("case_ref").alias("datasets"))


def ftm_relations(claims: DataFrame) -> DataFrame:
    """Directorships and ownerships in the same form."""
    some = claims.where(F.col("predicate").isin("officer_of", "beneficial_owner_of", "parent_of"))
    office = F.col("predicate") == "officer_of"
    properties = F.create_map(F.when(office, "director").otherwise("owner"), F.array("subject_key"), F.when(office, "organization").otherwise("asset"), F.array(F.coalesce("object_key", "object_value")), F.lit("sourceUrl"), F.array("source_url"), F.lit("startDate"), F.array(F.date_format("observed_at", "yyyy-MM-dd")))
    ident = F.sha2(F.concat_ws("|", "case_ref", F.col("claim_pos").cast("string")), 256)
    return some.select(F.concat(F.lit("rel-"), ident).alias("id"), F.when(office, "Directorship").otherwise("Ownership").alias("schema"), properties.alias("properties"), F.array("case_ref").alias("datasets"))


def _quoted(c: Column) -> Column:
    return F.substring(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


def cypher(claims: DataFrame, idents: DataFrame, ents: DataFrame, mask=None) -> DataFrame:
    """(part, line): Cypher statements. ``mask`` turns a key into what stands for it, in nodes and edges alike."""
    m = mask or (lambda c: c)
    head = idents.sparkSession.createDataFrame([(0, "CREATE CONSTRAINT ident IF NOT EXISTS FOR (i:Identifier) REQUIRE i.key IS UNIQUE;")], "part int, line string")
    node = idents.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (:Identifier {key: "), _quoted(m(F.col("key"))), F.lit(", kind: "), _quoted(F.col("kind")), F.lit("});")).alias("line"))
    ent = ents.select(F.lit(2).alias("part"), F.concat(F.lit("MERGE (e:Entity {id: "), _quoted(F.col("entity_id")), F.lit("}) SET e.type = "), _quoted(F.col("type")), F.lit(", e.log_odds = "), F.format_string("%.4f", "log_odds"), F.lit(";")).alias("line"))
    link = ents.select("entity_id", F.explode("identifiers").alias("key")).select(F.lit(3).alias("part"), F.concat(F.lit("MATCH (e:Entity {id: "), _quoted(F.col("entity_id")), F.lit("}), (i:Identifier {key: "), _quoted(m(F.col("key"))), F.lit("}) MERGE (e)-[:RESOLVES_TO]->(i);")).alias("line"))
    ends_known = claims.where(F.col("subject_kind").isin(*K.KINDS) & F.col("object_kind").isin(*K.KINDS)) if "subject_kind" in claims.columns else claims.where(F.col("object_kind").isin(*K.KINDS))
    edge = ends_known.select(F.lit(4).alias("part"), F.concat(F.lit("MATCH (a:Identifier {key: "), _quoted(m(F.col("subject_key"))), F.lit("}), (b:Identifier {key: "), _quoted(m(F.col("object_key"))), F.lit("}) MERGE (a)-[r:"), F.upper("predicate"), F.lit("]->(b) SET r.collector = "), _quoted(F.col("collector")), F.lit(", r.weight = "), F.col("weight").cast("string"), F.lit(";")).alias("line"))
    return head.unionByName(node).unionByName(ent).unionByName(link).unionByName(edge)


def graph_json(claims: DataFrame, idents: DataFrame | None = None, ents: DataFrame | None = None) -> DataFrame:
    """(json): a line for each identifier, claim and entity, which ``what`` tells apart."""
    out = claims.select(F.to_json(F.struct(F.lit("claim").alias("what"), *claims.columns)).alias("json"))
    for what, rows in (("identifier", idents), ("entity", ents)):
        if rows is not None:
            out = out.unionByName(rows.select(F.to_json(F.struct(F.lit(what).alias("what"), *rows.columns)).alias("json")))
    return out


def _digests(kind: str, change):
    """A column function for arrays or maps of texts."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(change, na_action="ignore")

    return run


def minimised(salt: bytes, claims: DataFrame, idents: DataFrame, ents: DataFrame, members: DataFrame, scored: DataFrame, rejected: DataFrame, found: DataFrame) -> tuple[DataFrame, ...]:
    """What the exports are written from, with every identifier, literal, address and label replaced by a salted digest.

    A key has one digest everywhere. Raw fields are left out; kinds, predicates, collectors, weights and times stay.
    """
    m = lambda c: T.minimised(F.col(c), salt)
    code = lambda x: M.digest(x, salt)
    some = lambda rows, *columns: rows.withColumns({c: m(c) for c in columns if c in rows.columns})
    value = F.when(F.col("object_kind").isNotNull(), m("object_key")).otherwise(m("object_value"))
    told = claims.drop("raw").withColumns({"subject_key": m("subject_key"), "subject_value": m("subject_key"), "object_key": m("object_key"), "object_value": value})
    told = some(told, "source_url", "correlation_group")
    own = idents.withColumns({"key": m("key"), "value": m("key")})
    listed = ents.withColumn("identifiers", _digests("array<string>", lambda xs: [code(x) for x in xs])(F.col("identifiers")))
    # Arrow gives maps as lists of pairs
    pairs = lambda xs: list(xs.items()) if isinstance(xs, dict) else list(xs)
    listed = listed.withColumns({
        "labels": _digests("map<string,double>", lambda xs: {code(k): v for k, v in pairs(xs)})(F.col("labels")),
        "attributes": _digests("map<string,array<string>>", lambda xs: {k: [code(x) for x in v] for k, v in pairs(xs)})(F.col("attributes")),
    })
    listed = some(listed, "entity_id", "cluster", "best_label")
    return told, own, listed, members.withColumns({"value": m("key"), "key": m("key"), "cluster": m("cluster")}), some(scored, "a", "b"), some(rejected, "a", "b"), found.withColumns({"value": m("key"), "key": m("key")})


def headline(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("pairs"), F.count_if(F.col("band") == "STRONG_EVIDENCE").alias("strong"), F.count_if(F.col("band") == "MODERATE_EVIDENCE").alias("moderate"))


def status(problems: int, truncated: bool, unchecked: int) -> str:
    """What a report must say first: invalid before incomplete before limited."""
    return "INVALID" if problems else "INCOMPLETE" if truncated else "LIMITED" if unchecked else "COMPLETE"


# What a state of the record means for its reader.
STATES = {
    "INVALID": "The evidence does not verify. Nothing below may be relied on until the record is repaired.",
    "INCOMPLETE": "The collection was cut by its budget. What is missing below may exist.",
    "LIMITED": "Some sources were not asked. Their silence says nothing.",
    "COMPLETE": "Every source that the case names was asked and the evidence verifies.",
}


def summary(scored: DataFrame, rejected: DataFrame, state: str = "COMPLETE") -> list[str]:
    """The lines that a reader in a hurry needs: the strongest findings, how strong, what speaks against them, what they do not say."""
    h = headline(scored).head()
    top = scored.where(F.col("band").isin("STRONG_EVIDENCE", "MODERATE_EVIDENCE")).orderBy(F.desc("log_odds"), "a", "b").limit(3).collect()
    against = rejected.count()
    out = [f"Status: {state}. {STATES[state]}", f"{h.pairs} pairs assessed, {h.strong} with strong and {h.moderate} with moderate evidence. Scores order evidence; they are not calibrated probabilities."]
    out += [f"{r.a} and {r.b}: {r.band.replace('_', ' ').lower()} (log-odds {r.log_odds:.3f})." for r in top] or ["No pair has more than limited evidence."]
    out.append(f"{against} pairs that score high enough were not merged; the table below says why." if against else "No pair that scores high enough was held back.")
    out.append("A link says that two identifiers are of one actor as far as the sources tell, not who the actor is. A single forged or shared source can carry a strong score; read the sources before acting.")
    return out


def report(scored: DataFrame, rejected: DataFrame, found: DataFrame, sources: DataFrame, state: str = "COMPLETE", markup: str = "md", ents: DataFrame | None = None, trail: DataFrame | None = None, disguised: DataFrame | None = None) -> str:
    """A report in Markdown or HTML; all tables are limited. ``trail``: number, url; ``disguised``: key, findings."""
    sections = [
        ("Summary", None, summary(scored, rejected, state)),
        ("Pairs", ("A", "B", "log-odds", "band"), [(r.a, r.b, f"{r.log_odds:.3f}", r.band) for r in scored.orderBy(F.desc("log_odds"), "a", "b").limit(K.PAIRS_SHOWN).collect()]),
        ("Map", "mermaid", [mermaid(map_edges(scored))]),
        ("Not merged", ("A", "B", "reason"), [(r.a, r.b, r.reason) for r in rejected.orderBy("a", "b").limit(K.REJECTED_SHOWN).collect()]),
        ("Indicators", ("type", "value", "claims"), [(r.label, r.value, str(r.claims)) for r in found.orderBy(F.desc("claims"), "key").limit(K.INDICATORS).collect()]),
        ("Sources", ("source", "terms"), [(r.source, r.name) for r in sources.orderBy("source").limit(K.INDICATORS).collect()]),
    ]
    if ents is not None:
        rows = ents.orderBy(F.desc("log_odds"), "entity_id").limit(K.PAIRS_SHOWN).collect()
        sections.insert(2, ("Entities", ("label", "type", "identifiers", "log-odds"), [(r.best_label, r.type, ", ".join(r.identifiers[:8]), f"{r.log_odds:.3f}") for r in rows]))
    if disguised is not None:
        sections.append(("Disguised identifiers", ("identifier", "how"), [(r.key, ", ".join(r.findings)) for r in disguised.orderBy("key").limit(K.INDICATORS).collect()]))
    if trail is not None:
        sections.append(("Citations", ("number", "address"), [(str(r.number), r.url) for r in trail.orderBy("number").limit(K.INDICATORS).collect()]))
    out = []
    for title, columns, rows in sections:
        if markup == "html":
            cell = lambda x, t="td": f"<{t}>{html.escape(x)}</{t}>"
            tag = "pre" if columns == "mermaid" else "p"
            body = "".join(f"<{tag}>{html.escape(r)}</{tag}>" for r in rows) if columns in (None, "mermaid") else "<table><tr>" + "".join(cell(c, "th") for c in columns) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"
            out.append(f"<h2>{title}</h2>{body}")
        else:
            plain = lambda x: x.replace("|", "\\|").replace("\n", " ")
            body = rows if columns is None else ["```mermaid", *rows, "```"] if columns == "mermaid" else [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *(f"| {' | '.join(map(plain, r))} |" for r in rows)]
            out += [f"## {title}", "", *body, ""]
    return "<!doctype html><meta charset=utf-8>" + "".join(out) if markup == "html" else "\n".join(out)


def write_all(path: str, claims: DataFrame, idents: DataFrame, ents: DataFrame, members: DataFrame, scored: DataFrame, rejected: DataFrame, salt: bytes | None = None, state: str = "COMPLETE") -> None:
    """Every export under one folder, as Spark writes them. With a salt no file holds a raw identifier, literal or address."""
    found, sources = indicators(claims, idents), source_attribution(claims)
    if salt is not None:
        claims, idents, ents, members, scored, rejected, found = minimised(salt, claims, idents, ents, members, scored, rejected, found)
    graph_json(claims, idents, ents).write.mode("overwrite").text(f"{path}/graph.jsonl")
    both = ftm_entities(ents, members).unionByName(ftm_relations(claims))
    both.write.mode("overwrite").json(f"{path}/ftm.jsonl")
    lines = cypher(claims, idents, ents)
    lines.repartitionByRange("part").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(f"{path}/cypher")
    found.write.mode("overwrite").json(f"{path}/indicators.jsonl")
    texts = [(f"report.{m}", report(scored, rejected, found, sources, state, m, ents)) for m in ("md", "html")] + [("map.mmd", mermaid(map_edges(scored)))]
    spark = claims.sparkSession
    for name, body in texts:
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def top_pairs(scored: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each case."""
    place = F.row_number().over(W.partitionBy("case_ref").orderBy(F.desc("log_odds"), "a", "b"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
