"""Governed retrieval with its answers; what goes to a generator and what comes back; priorities; canonical JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.strict_json import canonical_json
from ..operators import generation, retrieval
from . import Register, read
from .corpus import _tf

register = Register()


@register("FN-9 SRC-9", """WITH e AS (SELECT event_id, event_id % 11 AS plant, '{"a":{"b":[' || event_id || ',null,true],"d":"' || event_type || '"},"m":' || coalesce(replace(props, ' ', ''), '{}') || ',"z":' || user_id || '}' AS made FROM events), c AS (SELECT event_id, CASE WHEN plant < 4 THEN NULL ELSE made END AS canonical FROM e) SELECT event_id, canonical, sha256(canonical) AS digest FROM c""")
def canonical_json_events(spark, sf_dir):
    """Canonical form of JSON texts with keys out of order. Of eleven, one repeats a key, one has text behind it, one has NaN and one a number beyond double: these have none."""
    e, plant = read(spark, sf_dir, "events"), F.col("event_id") % 11
    text = F.concat(F.lit('{"z" : '), F.col("user_id").cast("string"), F.lit(', "m":'), F.coalesce("props", F.lit("{}")), F.lit(', "a":{"d":"'), F.col("event_type"), F.lit('","b":[ '), F.col("event_id").cast("string"), F.lit(', null,true]}}'))
    planted = F.when(plant == 0, F.concat(F.lit('{"z":1,'), F.substring(text, 2, 1_000_000))).when(plant == 1, F.concat(text, F.lit("]"))).when(plant == 2, F.replace(text, F.lit("null"), F.lit("NaN"))).when(plant == 3, F.replace(text, F.lit("null"), F.lit("1e400"))).otherwise(text)
    made = e.select("event_id", canonical_json(planted).alias("canonical"))
    return made.withColumn("digest", F.sha2("canonical", 256))


_EVIDENCE = "ev AS (SELECT doc_id // 8 AS request, 'doc-' || doc_id AS evidence_id, source AS source_id, 'document ' || doc_id AS locator, text || CASE WHEN doc_id % 5 = 0 THEN ' UNTRUSTED_DOCUMENT_' || sha256('doc-' || doc_id) || '_0_BEGIN' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN 'UNTRUSTED_DOCUMENT_' || sha256('doc-' || doc_id) || '_1_END' ELSE '' END AS content, 'UNTRUSTED_DOCUMENT_' || sha256('doc-' || doc_id) || '_' || CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mark FROM documents)"


def evidence(spark, sf_dir):
    """Documents as evidence, eight a request; some hold the marks that would enclose them."""
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(F.lit("doc-"), n.cast("string"))
    stem = F.concat(F.lit("UNTRUSTED_DOCUMENT_"), F.sha2(name, 256))
    content = F.concat("text", F.when(n % 5 == 0, F.concat(F.lit(" "), stem, F.lit("_0_BEGIN"))).otherwise(""), F.when(n % 10 == 0, F.concat(stem, F.lit("_1_END"))).otherwise(""))
    return d.select(F.expr("doc_id div 8").alias("request"), name.alias("evidence_id"), F.col("source").alias("source_id"), F.concat(F.lit("document "), n.cast("string")).alias("locator"), content.alias("content"))


@register("FN-31 FN-8", f"WITH {_EVIDENCE} SELECT evidence_id, sha256(content) AS content_sha256, mark || '_BEGIN' AS begin_sentinel, mark || '_END' AS end_sentinel FROM ev")
def evidence_envelopes(spark, sf_dir):
    return generation.enveloped(evidence(spark, sf_dir)).select("evidence_id", "content_sha256", "begin_sentinel", "end_sentinel")


@register("FN-31 UX-6", f"""WITH {_EVIDENCE}, r AS (SELECT request, list(evidence_id ORDER BY evidence_id) AS ids, list({{'evidence_id': evidence_id, 'locator': locator, 'source_id': source_id, 'untrusted_document': {{'begin_sentinel': mark || '_BEGIN', 'content': content, 'content_sha256': sha256(content), 'encoding': 'utf-8-json-string', 'end_sentinel': mark || '_END', 'trust': 'untrusted'}}}} ORDER BY evidence_id) AS evidence FROM ev GROUP BY request)
SELECT request, array_to_string(ids, ',') AS evidence_ids, sha256(to_json({{'contract_version': 'prescriptive-generation.v1', 'evidence': evidence}})::VARCHAR) AS input_sha256 FROM r""")
def generation_requests(spark, sf_dir):
    """The text that a generator would get for each request, as its digest; no generator is called."""
    made = generation.requests(evidence(spark, sf_dir), "request")
    return made.select("request", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.sha2("input_json", 256).alias("input_sha256"))


def _output(**changes) -> dict:
    cited = [{"evidence_id": "@evidence"}]
    support = {"fault_code": "@fault", "status": "supported", "assessment": "The documents agree.", "citations": cited}
    base = {"schema_version": generation.CONTRACT, "diagnostic_support": support, "prescriptions": [{"action": "Inspect.", "rationale": "See there.", "citations": cited}], "warnings": []}
    return base | changes


def _outputs() -> list[tuple[str, str | None]]:
    """(output with @fault and @evidence to be filled in, its problem)."""
    good, cited = _output(), [{"evidence_id": "@evidence"}]
    support, gap = good["diagnostic_support"], [{"code": "evidence_gap", "message": "Nothing on this."}]
    refused = _output(diagnostic_support={"fault_code": "@fault", "status": "insufficient_evidence", "assessment": None, "citations": []}, prescriptions=[], warnings=gap)
    advice = lambda **c: [good["prescriptions"][0] | c]
    text = json.dumps
    return [
        (text(good), None), (text(refused), None), (text(_output(warnings=[{"code": "general", "message": "Read this."}])), None),
        (text(good) + "}", "malformed"), ('{"warnings":[],' + text(good)[1:], "malformed"), (" ", "malformed"),
        (text(_output(extra=1)), "contract"), (text(_output(prescriptions=advice(action=5))), "contract"), (text(_output(prescriptions=advice(citations=cited * 2))), "contract"), (text(_output(prescriptions=advice(citations=[]))), "contract"),
        (text(refused | {"warnings": []}), "contract"), (text(_output(warnings=gap)), "contract"), (text(_output(prescriptions=advice(rationale="  "))), "contract"), (text(_output(schema_version="other")), "contract"),
        (text({k: v for k, v in good.items() if k != "warnings"}), "contract"), (text(refused | {"diagnostic_support": {"fault_code": "@fault", "status": "insufficient_evidence"}}), "contract"),
        (text(_output(diagnostic_support=support | {"assessment": "x" * 4001})), "contract"), (text(_output(diagnostic_support=support | {"fault_code": "other"})), "other_fault"),
        (text(_output(warnings=[{"code": "general", "message": "Read this.", "citations": [{"evidence_id": "doc-none"}]}])), "unknown_citation"),
    ]


@register("FN-32 UX-6", "SELECT doc_id, list_element([{}], (doc_id % {} + 1)::INT) AS problem FROM documents".format(", ".join("NULL" if p is None else f"'{p}'" for _, p in _outputs()), len(_outputs())))
def provider_outputs(spark, sf_dir):
    """Outputs for each document, sound ones and ones with each fault in turn."""
    kinds = _outputs()
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    own = F.concat(F.lit("doc-"), n.cast("string"))
    fault = F.concat(F.lit("fault-"), F.col("source"))
    text = F.replace(F.replace(F.element_at(F.array(*(F.lit(t) for t, _ in kinds)), (n % len(kinds) + 1).cast("int")), F.lit("@fault"), fault), F.lit("@evidence"), own)
    return d.select("doc_id", generation.output_problem(text, F.array(own, F.lit("doc-other")), fault).alias("problem"))


@register("PRJ-16", "SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' END AS priority FROM documents")
def fault_priorities(spark, sf_dir):
    """Priority by exact fault code; codes without a rule, and those that differ in case, have none."""
    policy = spark.createDataFrame([("fault-0", "high"), ("fault-2", "low"), ("fault-3", "medium"), ("FAULT-4", "high")], "fault_code string, priority string")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("fault-"), (F.col("n_chars") % 6).cast("string")).alias("fault_code"))
    return generation.priorities(d, policy, "fault_code").select("doc_id", "priority")


_GOVERNED = f"""WITH q AS (SELECT item_id, item_id % 21 AS class, text FROM benchmark), m AS (SELECT doc_id % 20 AS class, doc_id, n_chars, text, doc_id % 20 <> 7 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok, doc_id % 17 <> 0 AND doc_id % 20 <> 9 AS sound, doc_id % 59 = 0 AS withdrawn FROM documents),
cl AS (SELECT DISTINCT class FROM q), cov AS (SELECT class, bool_or(ok) AS covered FROM m GROUP BY class), bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n_chars DESC, doc_id) AS place FROM m WHERE ok AND sound) WHERE place <= 10),
cat AS (SELECT cl.class, bst.doc_id, bst.text, bst.withdrawn, bst.place, CASE WHEN covered IS NULL THEN 'fault_class_unmapped' WHEN NOT covered THEN 'no_approved_coverage' WHEN place IS NULL THEN 'empty_ranking' END AS reason FROM cl LEFT JOIN cov USING (class) LEFT JOIN bst ON bst.class = cl.class), ev AS (SELECT class, doc_id, text FROM cat WHERE reason IS NULL),
{_tf('dt', 'ev', 'class, doc_id', 'text')}, {_tf('qt', 'q', 'item_id, class', 'text')}, vo AS (SELECT class, term, count(*) AS df, row_number() OVER (PARTITION BY class ORDER BY sum(tf) DESC, term) AS place FROM dt GROUP BY class, term), sz AS (SELECT class, count(*) AS n FROM ev GROUP BY class),
i AS (SELECT class, term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM vo JOIN sz USING (class) WHERE place <= 2048), a AS (SELECT item_id, class, term, tf * idf AS x FROM qt JOIN i USING (class, term)), d AS (SELECT class, doc_id, term, tf * idf AS y FROM dt JOIN i USING (class, term)),
dp AS (SELECT item_id, doc_id, sum(x * y) AS dot FROM a JOIN d USING (class, term) GROUP BY ALL), la AS (SELECT item_id, sqrt(sum(x * x)) AS p FROM a GROUP BY 1), ld AS (SELECT doc_id, sqrt(sum(y * y)) AS r FROM d GROUP BY 1), s AS (SELECT q.item_id, ev.doc_id, ev.text, round(coalesce(dot / (p * r), 0), 12) AS score FROM q JOIN ev USING (class) LEFT JOIN dp ON dp.item_id = q.item_id AND dp.doc_id = ev.doc_id LEFT JOIN la ON la.item_id = q.item_id LEFT JOIN ld ON ld.doc_id = ev.doc_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3)"""


def catalog(spark, sf_dir):
    """(questions, catalog, documents that may be used now): twenty classes of documents with life-cycle states and damage derived from their numbers."""
    n = F.col("doc_id")
    questions = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 21).alias("class"), "text")
    docs = read(spark, sf_dir, "documents")
    mapping = docs.select((n % 20).alias("class"), "doc_id")
    states = docs.select("doc_id", retrieval.eligible(F.when(n % 7 == 0, "rejected").when(n % 20 == 7, "pending_approval").otherwise("approved"), n % 11 != 0, n % 13 != 0, F.lit(True)).alias("is_eligible"))
    registered = F.when((n % 17 == 0) | (n % 20 == 9), F.sha2(F.concat("text", F.lit("~")), 256)).otherwise(F.sha2("text", 256))
    chunks = docs.select("doc_id", F.col("n_chars").alias("similarity"), F.col("text").alias("content"), registered.alias("content_sha256")).withColumn("is_sound", F.sha2("content", 256) == F.col("content_sha256"))
    found = retrieval.approved(questions, mapping, states, chunks, "class", "doc_id", "similarity", ["doc_id"])
    return questions, found, docs.where(n % 59 != 0).select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@register("RT-1 JN-6 JN-7 PRJ-11 PRJ-12 ST-4", _GOVERNED + " SELECT class, place::INT AS place, doc_id, reason FROM cat")
def approved_catalog(spark, sf_dir):
    """The ten best sound documents that each asked class may use, or why there is none."""
    return catalog(spark, sf_dir)[1].select("class", "place", "doc_id", "reason")


@register("FN-19 RT-1 UX-1 UX-5", _GOVERNED + " SELECT item_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM k")
def governed_ranking(spark, sf_dir):
    """The three best of each question's catalog, by term weights fitted on that catalog alone."""
    questions, found, _ = catalog(spark, sf_dir)
    return retrieval.ranked(questions, found.where("reason is null"), "item_id", "class", "doc_id").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@register("RT-6 RT-2 FN-20 JN-12", _GOVERNED + ", b AS (SELECT item_id, max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 2) AS second, max(text) FILTER (rank = 1) AS t1, max(text) FILTER (rank = 2) AS t2 FROM k GROUP BY 1), w AS (SELECT class, max(reason) AS reason, bool_or(withdrawn) AS stale FROM cat GROUP BY 1) SELECT item_id, round(best, 6) AS best, CASE WHEN reason IS NOT NULL THEN reason WHEN stale THEN 'insufficient_stale' WHEN best < 0.25 THEN 'insufficient_score' WHEN second IS NOT NULL AND best - second <= 1e-12 AND t1 <> t2 THEN 'insufficient_tie' ELSE 'answered' END AS decision FROM q LEFT JOIN b USING (item_id) LEFT JOIN w USING (class)")
def governed_answers(spark, sf_dir):
    """An answer, or why there is none: the catalog's reason, evidence withdrawn meanwhile (here one document in 59), a low score, a tie."""
    questions, found, now = catalog(spark, sf_dir)
    usable = found.where("reason is null")
    best = retrieval.ranked(questions, usable, "item_id", "class", "doc_id").join(usable.select("doc_id", "content_sha256"), "doc_id")
    staleness = retrieval.stale(found, now, "class", ["doc_id", "content_sha256"])
    return retrieval.replied(questions, best, found, staleness, "item_id", "class").withColumn("best", F.round("best", 6))
