"""Texts: quality, cleaning, labels, chunks, retrieval; decisions; life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as doc
from ..operators import cosine, lifecycle, outcomes, retrieval
from . import Register, read

register = Register()
_S, _A, _W = "[\\t-\\r\\x1c- \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]", "[\\p{L}\\p{N}]", "[\\p{L}\\p{N}_]+"


@register(
    "FN-10",
    f"""WITH m AS (SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '{_S}', '', 'g')) AS solid, length(text) - length(regexp_replace(text, '{_A}', '', 'g')) AS alphanumeric, len(regexp_extract_all(text, '{_W}')) AS words, length(text) - length(replace(text, chr(65533), '')) AS replaced, length(translate(text, chr(10) || chr(9), '')) - length(regexp_replace(translate(text, chr(10) || chr(9), ''), '[\\p{{Cc}}\\p{{Cf}}]', '', 'g')) AS controls FROM documents), r AS (SELECT *, round(alphanumeric / nullif(solid, 0), 6) AS share FROM m)
    SELECT doc_id, characters::INT AS characters, solid::INT AS solid, alphanumeric::INT AS alphanumeric, words::INT AS words, share, concat_ws(',', CASE WHEN solid = 0 THEN 'text.empty' END, CASE WHEN solid > 0 AND alphanumeric < 12 THEN 'text.too_short' END, CASE WHEN share < 0.5 THEN 'text.low_alphanumeric_ratio' END, CASE WHEN replaced > 0 THEN 'text.replacement_characters' END, CASE WHEN controls > 0 THEN 'text.control_characters' END) AS signals FROM r""",
)
def text_quality_documents(spark, sf_dir):
    m = read(spark, sf_dir, "documents").select("doc_id", tx.measures(F.col("text")).alias("m"))
    return m.select("doc_id", "m.characters", "m.solid", "m.alphanumeric", "m.words", "m.share", F.array_join("m.signals", ",").alias("signals"))


@register("FN-10 UX-3 SRC-8", "WITH o AS (SELECT doc_id, [(doc_id % 11) / 10.0, (doc_id % 7) / 6.0, 1.0] AS c FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN round(list_sum(c) / 3, 6) < 0.8 THEN 'ocr.low_mean_confidence' END, CASE WHEN round(list_min(c), 6) < 0.6 THEN 'ocr.low_minimum_confidence' END) AS signals FROM o")
def recognised_text_quality(spark, sf_dir):
    """Signals of recognised text, with confidences that a recogniser would have given (here derived)."""
    c = F.array((F.col("doc_id") % 11) / 10.0, (F.col("doc_id") % 7) / 6.0, F.lit(1.0))
    m = read(spark, sf_dir, "documents").select("doc_id", tx.measures(F.col("text"), c).alias("m"))
    return m.select("doc_id", F.array_join(F.filter("m.signals", lambda s: s.startswith("ocr.")), ",").alias("signals"))


@register("FN-11", "SELECT page_id, length(trim(replace(html, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::INT AS normal_length, length(trim(regexp_replace(regexp_replace(html, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(10)))::INT AS clean_length FROM pages")
def clean_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.length(tx.normalize(F.col("html"))).alias("normal_length"), F.length(tx.clean_noise(F.col("html"))).alias("clean_length"))


@register("FN-5 FN-30", r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'C:/' || text WHEN 2 THEN 'ftp://user:word@' || text WHEN 3 THEN text || ' file:///x' ELSE text END AS text FROM documents) SELECT doc_id, regexp_matches(translate(text, chr(9) || chr(10) || chr(13), ''), '[\p{Cc}\p{Cf}]') AS is_unsafe, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(?:api[_-]?key|password|secret|token|bearer)\s*[:=]\s*\S+') THEN 'assignment' END, CASE WHEN regexp_matches(text, '(?i)\b(?:sk|ghp|github_pat)-?[A-Za-z0-9_]{8,}\b') THEN 'token' END, CASE WHEN regexp_matches(text, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/@:]+:[^/@]+@') THEN 'uri_credential' END, CASE WHEN substr(text, 2, 1) = ':' AND substr(text, 3, 1) IN ('/', chr(92)) AND upper(substr(text, 1, 1)) BETWEEN 'A' AND 'Z' OR substr(text, 1, 1) = '/' OR substr(text, 1, 2) IN ('~/', '~' || chr(92), chr(92) || chr(92)) OR contains(lower(text), 'file://') OR contains(lower(text), '/home/') OR contains(lower(text), '/users/') OR contains(lower(text), chr(92) || 'users' || chr(92)) THEN 'machine_path' END) AS found FROM t""")
def secret_scan_documents(spark, sf_dir):
    """Documents, some of them with a local path or a credential put before or behind the text."""
    text, kind = F.col("text"), F.col("doc_id") % 5
    planted = F.when(kind == 1, F.concat(F.lit("C:/"), text)).when(kind == 2, F.concat(F.lit("ftp://user:word@"), text)).when(kind == 3, F.concat(text, F.lit(" file:///x"))).otherwise(text)
    return read(spark, sf_dir, "documents").withColumn("text", planted).select("doc_id", tx.unsafe(F.col("text")).alias("is_unsafe"), F.array_join(tx.secrets(F.col("text")), ",").alias("found"))


@register("FN-4 FN-6 AG-18 AG-19 JN-2 JN-3", r"WITH n AS (SELECT p_type AS raw, count(*) AS n, trim(regexp_replace(lower(p_type), '[\s\-_/]+', ' ', 'g')) AS normalized FROM part GROUP BY p_type) SELECT raw, n, normalized, replace(normalized, ' ', '-') AS slug, count(*) OVER (PARTITION BY normalized) > 1 AS collides FROM n")
def label_inventory_part(spark, sf_dir):
    """Raw labels with frequency, normal form, slug, and whether another raw label has the same normal form."""
    n = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("normalized", tx.normalized_label("raw"))
    groups = n.groupBy("normalized").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return n.join(groups, "normalized").select("raw", "n", "normalized", tx.slug(F.col("normalized")).alias("slug"), "collides")


@register("AG-19 FN-4", "WITH v AS (SELECT p_brand AS raw FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT replace(p_brand, '#', ' #') FROM part UNION SELECT '  ' || upper(p_brand) || ' ' FROM part), n AS (SELECT raw, trim(regexp_replace(lower(raw), '[\\s\\-_/]+', ' ', 'g')) AS normalized FROM v) SELECT normalized, count(*) AS spellings, min(raw) AS first_spelling FROM n GROUP BY 1 HAVING count(*) > 1")
def label_collisions_part(spark, sf_dir):
    """Spellings that come to one label: case, blanks, separators."""
    b = read(spark, sf_dir, "part").select("p_brand")
    v = b.select(F.col("p_brand").alias("raw")).union(b.select(F.lower("p_brand"))).union(b.select(F.replace("p_brand", F.lit("#"), F.lit(" #")))).union(b.select(F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" ")))).distinct()
    return v.withColumn("normalized", tx.normalized_ascii_label(F.col("raw"))).groupBy("normalized").agg(F.count(F.lit(1)).alias("spellings"), F.min("raw").alias("first_spelling")).where("spellings > 1")


@register("FN-7 FN-27", "WITH v AS (SELECT DISTINCT event_type FROM events), s AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'Motor-Desligado' WHEN 'view' THEN 'NORMAL' WHEN 'purchase' THEN 'tésté' ELSE event_type END AS value FROM v) SELECT event_type, CASE event_type WHEN 'click' THEN 'motor_desligado' WHEN 'view' THEN 'normal' WHEN 'purchase' THEN 'teste' END AS state, 'doc_' || sha256(event_type || '.pdf') AS document_id FROM s")
def operating_states_events(spark, sf_dir):
    v = read(spark, sf_dir, "events").select("event_type").distinct()
    value = F.when(F.col("event_type") == "click", "Motor-Desligado").when(F.col("event_type") == "view", "NORMAL").when(F.col("event_type") == "purchase", "tésté").otherwise(F.col("event_type"))
    return v.select("event_type", tx.operating_state(value).alias("state"), tx.document_id(F.concat(F.upper("event_type"), F.lit(".PDF"))).alias("document_id"))


@register("FN-21", "SELECT item_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) BETWEEN 3 AND 500 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS question FROM benchmark")
def questions_benchmark(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tx.question("text").alias("question"))


@register("FN-13 FN-14 PL-10 SRC-12")
def chunk_documents(spark, sf_dir):
    """Chunks of all documents with identities; a sequential cursor, held against a plain version in the tests."""
    made = doc.identified(doc.chunks(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return made.select("doc_id", "section_index", "section_chunk_index", "ordinal", "character_start", "character_end", "content_sha256", "section_id", "chunk_id")


@register("PRJ-12 FN-8 AG-33", "SELECT doc_id, doc_id % 7 NOT IN (0, 2, 3, 5) AS all_sound, CASE WHEN doc_id % 7 IN (0, 2, 3, 5) THEN 'partial' WHEN doc_id % 7 = 1 THEN 'attention' ELSE 'completed' END AS status FROM documents WHERE length(trim(text)) > 0")
def chunk_integrity_documents(spark, sf_dir):
    """Chunks held against their identities, their vectors and the texts that they come from. In four documents of seven the first chunk is damaged: its content, its span, its vector, or its section."""
    docs = read(spark, sf_dir, "documents")
    made = doc.identified(doc.chunks(docs, "doc_id", "text"), "doc_id")
    ill = lambda k: (F.col("ordinal") == 1) & (F.col("doc_id") % 7 == k)
    vector = F.array(F.length("content").cast("double"), F.when(ill(3), float("nan")).otherwise(0.5))
    # A shifted span keeps its length: only the text itself can tell. Its identity is made anew, so that it agrees with the span.
    made = made.withColumn("content", F.when(ill(0), F.concat(F.lit("~"), F.col("content"))).otherwise(F.col("content"))).withColumn("section_index", F.when(ill(5), 99).otherwise(F.col("section_index")))
    moved = made.where(ill(2)).withColumn("character_start", F.col("character_start") + 1).withColumn("character_end", F.col("character_end") + 1)
    made = made.where(~ill(2)).unionByName(doc.identified(moved.drop("content_sha256", "section_id", "chunk_id"), "doc_id")).withColumn("vector", vector)
    sound = F.coalesce(doc.sound("doc_id") & doc.located(F.col("text")) & doc.finite(F.col("vector")), F.lit(False))
    held = made.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", sound.alias("sound"))
    return held.groupBy("doc_id").agg(F.bool_and("sound").alias("all_sound"), doc.status(F.count_if("sound") + F.lit(1), F.count_if(~F.col("sound")), F.max(F.when(F.col("doc_id") % 7 == 1, 1).otherwise(0))).alias("status"))


@register("FN-12")
def cleaned_spans_pages(spark, sf_dir):
    """Pages without technical noise, and where the first and the last character that is left stand in the source."""
    made = doc.cleaned(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return made.select("page_id", F.length("cleaned").alias("length"), F.element_at("starts", 1).alias("first"), F.element_at("ends", -1).alias("last"))


@register("FN-15 UX-2")
def hash_embedding_benchmark(spark, sf_dir):
    """Deterministic vectors from SHAKE-256, which SQL has not."""
    v = read(spark, sf_dir, "benchmark").select("item_id", tx.hash_embedding(16)("text").alias("v"))
    return v.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 9).alias("power"), F.round(F.element_at("v", 1), 9).alias("first"))


_AC, _PL = tx.ACCENTED, tx.PLAIN


def _tf(name: str, table: str, key: str, source: str) -> str:
    return f"{name}w AS (SELECT {key}, regexp_extract_all(translate(lower({source}), '{_AC}', '{_PL}'), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {table}), {name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {name}w UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}w) GROUP BY ALL)"


_TFIDF = f"""WITH {_tf('d', 'documents', 'doc_id', 'text')}, {_tf('q', 'benchmark', 'item_id', 'text')}, n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM d GROUP BY term),
dr AS (SELECT doc_id, term, tf * idf AS r FROM d JOIN i USING (term)), qr AS (SELECT item_id, term, tf * idf AS r FROM q JOIN i USING (term)), dn AS (SELECT doc_id, sqrt(sum(r * r)) AS l FROM dr GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(r * r)) AS l FROM qr GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(qr.r / qn.l * dr.r / dn.l) AS score FROM qr JOIN dr USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _ranked(spark, sf_dir, k):
    docs, questions = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    return cosine.best(questions.select("item_id", "text"), docs, "item_id", "doc_id", "text", k)


@register("ST-4 ST-5 UX-1", _TFIDF + " SELECT item_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 3")
def tfidf_topk(spark, sf_dir):
    """The three best documents of every question."""
    return _ranked(spark, sf_dir, 3).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@register("FN-20", _TFIDF + ", b AS (SELECT item_id, max(round(score, 9)) FILTER (rank = 1) AS best, max(round(score, 9)) FILTER (rank = 2) AS second, max(text) FILTER (rank = 1) AS first, max(text) FILTER (rank = 2) AS other FROM k JOIN documents USING (doc_id) WHERE rank <= 2 GROUP BY item_id) SELECT item_id, round(best, 6) AS best, CASE WHEN best < 0.25 THEN 'insufficient_score' WHEN second IS NOT NULL AND best - second <= 1e-12 AND first <> other THEN 'insufficient_tie' ELSE 'answered' END AS decision FROM b")
def answer_or_abstain(spark, sf_dir):
    # Two rows a question are broadcast, so that no text moves.
    ranked = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(_ranked(spark, sf_dir, 2)), "doc_id")
    return retrieval.answer(ranked, "item_id", "text").withColumn("best", F.round("best", 6))


@register("PRJ-13 WN-12 RT-3", "WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents WHERE n_chars >= 200), u AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY rank) AS used, NOT bool_or(n_chars > 4000) OVER (PARTITION BY source) AS fits FROM r) SELECT source, doc_id, rank::INT AS rank, used::BIGINT AS used, fits FROM u WHERE used <= 24000 AND rank <= 12")
def evidence_budget_prefix(spark, sf_dir):
    """Per source the shortest documents as evidence, within the budget of characters and items."""
    found = read(spark, sf_dir, "documents").where("n_chars >= 200").withColumn("score", -F.col("n_chars"))
    return retrieval.budget(found, "source", "n_chars", "score", ["doc_id"]).select("source", "doc_id", "rank", "used", "fits")


@register("JN-6 JN-7 JN-11", "WITH m AS (SELECT source, list(doc_id ORDER BY n_chars DESC, doc_id) AS documents FROM documents WHERE lang = 'en' GROUP BY source), c AS (SELECT DISTINCT source FROM documents UNION SELECT 'nowhere'), x AS (SELECT source, documents IS NOT NULL AS mapped, unnest(range(len(coalesce(documents, [])))) AS place, unnest(coalesce(documents, [])) AS document_id FROM c LEFT JOIN m USING (source)) SELECT source, mapped, place::INT AS place, document_id FROM x UNION ALL SELECT source, documents IS NOT NULL, NULL, NULL FROM c LEFT JOIN m USING (source) WHERE coalesce(len(documents), 0) = 0")
def class_document_bridge(spark, sf_dir):
    """Classes to ordered documents; a class without a mapping stays visible."""
    d = read(spark, sf_dir, "documents")
    m = d.where("lang = 'en'").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").alias("d")))), lambda s: s["d"]).alias("documents"))
    classes = d.select("source").distinct().union(spark.createDataFrame([("nowhere",)], "source string"))
    return retrieval.mapped(classes, m, "source")


@register("RT-2 JN-12", "SELECT l.doc_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars > 1000 WHERE d.doc_id IS NULL")
def stale_snapshots(spark, sf_dir):
    """References whose document is no longer eligible (here: too short)."""
    return retrieval.current(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").where("n_chars > 1000"), ["doc_id"])


@register("AG-32", "WITH p AS (SELECT source, CASE WHEN n_chars < 300 THEN 'failed' WHEN n_chars < 1000 THEN 'review' ELSE 'ready' END AS status FROM documents) SELECT source, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'review') THEN 'review' ELSE 'ready' END AS worst, count(*) AS pages, count(*) FILTER (status = 'failed') AS failed FROM p GROUP BY source")
def page_status_rollup(spark, sf_dir):
    status = F.when(F.col("n_chars") < 300, "failed").when(F.col("n_chars") < 1000, "review").otherwise("ready")
    p = read(spark, sf_dir, "documents").select("source", status.alias("status"))
    return p.groupBy("source").agg(doc.worst(F.col("status"), ("failed", "review", "ready")).alias("worst"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"))


@register("SRC-9", "SELECT event_id, json_valid(props) AS valid, len(json_keys(props))::INT AS fields, sha256(props) AS digest FROM events WHERE props IS NOT NULL")
def json_props_events(spark, sf_dir):
    keys = F.expr("json_object_keys(props)")
    return read(spark, sf_dir, "events").where("props is not null").select("event_id", keys.isNotNull().alias("valid"), F.size(keys).alias("fields"), F.sha2("props", 256).alias("digest"))


_CASES = "c AS (SELECT d.doc_id, n_chars % 97 <> 0 AS prediction_ok, (d.doc_id % 12)::INT AS top_k, CASE d.doc_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'out_of_distribution' ELSE 'fault' END AS disposition, CASE WHEN d.doc_id % 7 <> 0 THEN source END AS retrieval_key, CASE d.doc_id % 13 WHEN 0 THEN 'no_evidence' WHEN 1 THEN 'unmapped_fault' WHEN 2 THEN 'retrieval_unavailable' ELSE 'evidence' END AS retrieval_status, CASE d.doc_id % 17 WHEN 0 THEN 'timed_out' WHEN 1 THEN 'busy' WHEN 2 THEN 'disabled' WHEN 3 THEN 'failed' WHEN 4 THEN 'invalid_response' ELSE 'completed' END AS provider, n_chars % 89 = 0 AS is_unsafe, CASE WHEN d.doc_id % 23 <> 0 THEN d.doc_id % 19 <> 0 END AS current_ok, n_chars % 3 <> 0 AS projected FROM {documents} d)"
_REFUSAL = "CASE WHEN retrieval_status <> 'evidence' THEN retrieval_status WHEN is_unsafe THEN 'unsafe_evidence' WHEN current_ok IS NULL THEN 'currentness_unavailable' WHEN NOT current_ok THEN 'stale_evidence' WHEN provider = 'failed' THEN 'provider_error' WHEN provider = 'invalid_response' THEN 'invalid_provider_output' END"
_STATUS = """o AS (SELECT *, CASE WHEN NOT prediction_ok THEN 'degraded:invalid_prediction' WHEN top_k NOT BETWEEN 1 AND 10 THEN 'degraded:invalid_request' WHEN disposition = 'normal' THEN 'skipped:normal' WHEN disposition = 'out_of_distribution' THEN 'skipped:out_of_distribution' WHEN retrieval_key IS NULL THEN 'skipped:undocumented_fault'
WHEN retrieval_status IN ('no_evidence', 'unmapped_fault') THEN 'skipped:' || retrieval_status WHEN retrieval_status = 'retrieval_unavailable' THEN 'degraded:retrieval_unavailable' WHEN provider = 'timed_out' THEN 'degraded:provider_timeout' WHEN provider = 'busy' THEN 'degraded:provider_busy' WHEN provider = 'disabled' THEN 'degraded:provider_disabled' WHEN provider = 'failed' THEN 'degraded:provider_error'
WHEN refusal IS NULL THEN 'generated:' WHEN refusal = 'currentness_unavailable' THEN 'degraded:currentness_unavailable' ELSE 'refused:guardrail_refusal' END AS decision FROM g)"""


def _cases(spark, sf_dir):
    c = spark.sql(f"WITH {_CASES} SELECT * FROM c", documents=read(spark, sf_dir, "documents"))
    d = {n: F.col(n) for n in ("prediction_ok", "top_k", "disposition", "retrieval_key", "retrieval_status", "provider")}
    refusal = outcomes.guardrail(d | {"diagnosis_ok": F.lit(True), "retrieval_ok": F.lit(True), "same_fault": F.lit(True), "items": F.lit(1), "blank": F.lit(False), "unsafe": F.col("is_unsafe"), "duplicate_ids": F.lit(False), "current": F.col("current_ok")})
    c = c.withColumn("refusal", refusal)
    return c.withColumn("o", outcomes.orchestration(d | {"refusal": F.col("refusal")}))


@register("RT-4", f"WITH {_CASES.format(documents='documents')} SELECT doc_id, {_REFUSAL} AS refusal FROM c")
def guardrail_decisions(spark, sf_dir):
    """Refusal codes of cases derived from documents."""
    return _cases(spark, sf_dir).select("doc_id", "refusal")


@register("RT-5", f"WITH {_CASES.format(documents='documents')}, g AS (SELECT *, {_REFUSAL} AS refusal FROM c), {_STATUS} SELECT doc_id, split_part(decision, ':', 1) AS status, nullif(split_part(decision, ':', 2), '') AS reason FROM o")
def orchestration_decisions(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", "o.status", "o.reason")


@register("PRJ-15 RT-7", f"""WITH {_CASES.format(documents='documents')}, g AS (SELECT *, {_REFUSAL} AS refusal FROM c), {_STATUS}, p AS (SELECT *, split_part(decision, ':', 1) AS status, nullif(split_part(decision, ':', 2), '') AS reason FROM o)
SELECT doc_id, CASE WHEN reason = 'normal' THEN 'normal' WHEN reason = 'out_of_distribution' THEN 'out_of_distribution' WHEN status = 'skipped' THEN 'undocumented_fault' WHEN status = 'generated' AND projected THEN 'documented_fault' ELSE 'degraded' END AS outcome,
CASE WHEN reason = 'normal' THEN NULL WHEN reason = 'out_of_distribution' THEN reason WHEN status = 'skipped' THEN 'documentation_not_found' WHEN status = 'generated' AND projected THEN NULL WHEN status = 'generated' THEN 'prescription_projection_unavailable' ELSE reason END AS warning FROM p""")
def outcome_decision(spark, sf_dir):
    """One of five public outcomes with its warning."""
    c = _cases(spark, sf_dir)
    return c.select("doc_id", outcomes.outcome(F.col("o.status"), F.col("o.reason"), F.col("projected")).alias("p")).select("doc_id", "p.*")


_EVENTS = """SELECT conv_id, turn AS sequence, lag(target) OVER (PARTITION BY conv_id ORDER BY turn) AS source_status, target AS target_status, conv_id * 1000 + turn - CASE WHEN turn % 5 = 4 THEN 3 ELSE 0 END AS occurred_at FROM (
SELECT conv_id, turn, CASE WHEN turn = first_turn THEN 'received' WHEN (turn - first_turn) % 3 = 1 THEN 'processing' WHEN (turn - first_turn) % 3 = 2 AND conv_id % 4 = 0 THEN 'failed' WHEN (turn - first_turn) % 3 = 2 THEN 'pending_approval' WHEN role = 'user' THEN 'rejected' ELSE 'approved' END AS target FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM {conversations}) AS numbered) AS states"""


def _log(spark, sf_dir):
    return spark.sql(_EVENTS, conversations=read(spark, sf_dir, "conversations"))


@register("WN-15 LC-6 PRJ-11", f"WITH e AS ({_EVENTS.format(conversations='conversations')}) SELECT conv_id, max_by(target_status, sequence) AS status, count(*) AS events, max(sequence) AS last_sequence FROM e GROUP BY conv_id")
def lifecycle_latest_state(spark, sf_dir):
    """Replay of an event log (derived from conversations) to the latest state."""
    return lifecycle.replayed(_log(spark, sf_dir), "conv_id")


_MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS s, '{b}' AS t" for a, bs in lifecycle.TRANSITIONS.items() for b in bs)


@register("LC-1 LC-4 WN-15", f"""WITH e AS ({_EVENTS.format(conversations='conversations')}), m AS ({_MATRIX}), w AS (SELECT e.*, lag(target_status) OVER o AS before, lag(sequence) OVER o AS n0, lag(occurred_at) OVER o AS t0 FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY sequence)),
p AS (SELECT conv_id, sequence, CASE WHEN before IS NULL AND (source_status IS NOT NULL OR target_status <> 'received') THEN 'first_event' WHEN before IS NULL THEN NULL WHEN source_status IS DISTINCT FROM before THEN 'source_mismatch' WHEN m.s IS NULL THEN 'transition' WHEN sequence <> n0 + 1 THEN 'sequence' WHEN occurred_at < t0 THEN 'clock' END AS problem FROM w LEFT JOIN m ON m.s = source_status AND m.t = target_status) SELECT * FROM p WHERE problem IS NOT NULL""")
def illegal_transitions(spark, sf_dir):
    """Steps outside the matrix, out of sequence or against the clock."""
    return lifecycle.illegal(_log(spark, sf_dir), "conv_id").select("conv_id", "sequence", "problem")


_DOCS = "SELECT o_custkey AS document, o_orderkey AS version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS sequence, CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending_approval' ELSE 'failed' END AS target_status, o_orderkey AS occurred_at FROM {orders}"


@register("LC-2", f"WITH e AS ({_DOCS.format(orders='orders')}), n AS (SELECT document, max(version) AS version, max_by(target_status, version) AS status, max_by(sequence, version) AS sequence, max(occurred_at) AS now FROM e GROUP BY document), a AS (SELECT * FROM n WHERE status = 'pending_approval') SELECT document, version, sequence + 1 AS sequence, 'approved' AS target_status, now AS occurred_at FROM a UNION ALL SELECT document, e.version, e.sequence + 1, 'superseded', now FROM e JOIN a USING (document) WHERE target_status = 'approved'")
def approval_supersession(spark, sf_dir):
    """Events of approvals with what they supersede; each order stands for a version of its customer's document."""
    e = spark.sql(_DOCS, orders=read(spark, sf_dir, "orders"))
    return lifecycle.approved(e, "version", "document", "reviewer").select("document", "version", "sequence", "target_status", "occurred_at")


@register("LC-3", "WITH v AS (SELECT l_orderkey AS document, l_linenumber AS version, l_partkey::VARCHAR AS sha256, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS wanted, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS earlier FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)) SELECT document, version, CASE WHEN version <> wanted THEN 'version_not_sequential' ELSE 'content_already_registered' END AS problem FROM v WHERE version <> wanted OR earlier > 1")
def registration_rules(spark, sf_dir):
    v = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("version")).agg(F.min("l_partkey").cast("string").alias("sha256"))
    return lifecycle.registration_problems(v, "document")


@register("LC-5 SNK-11", "WITH s AS (SELECT o_custkey AS document, count(*) AS revision, max(o_orderkey) AS last_command FROM orders GROUP BY 1), c AS (SELECT o_custkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS expected, o_orderkey AS command FROM orders) SELECT document, command, CASE WHEN expected = revision THEN 'applied' WHEN revision = expected + 1 AND last_command = command THEN 'replayed' ELSE 'conflict' END AS outcome FROM c JOIN s USING (document)")
def compare_and_swap(spark, sf_dir):
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders")
    stored = o.groupBy(F.col("o_custkey").alias("document")).agg(F.count(F.lit(1)).alias("revision"), F.max("o_orderkey").alias("last_command"))
    commands = o.select(F.col("o_custkey").alias("document"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("expected"), F.col("o_orderkey").alias("command"))
    return lifecycle.compare_and_swap(stored, commands, "document")


#: Events of one version of a document: fates by the order's key; a plant leaves out, repeats or turns one event.
_GOVERNED = """WITH v AS (SELECT o_custkey AS document, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, sha2(string(o_orderkey), 256) AS sha256, IF({plants}, o_orderkey % 17, 99) AS plant FROM {orders}),
e AS (SELECT *, posexplode(filter(array(
named_struct('version', version, 'action', 'registered', 'step', '', 'source', '', 'target', 'received', 'kept', true),
named_struct('version', version, 'action', 'processing_started', 'step', '', 'source', 'received', 'target', 'processing', 'kept', true),
named_struct('version', version, 'action', 'step_failed', 'step', 'extraction', 'source', 'processing', 'target', 'failed', 'kept', k % 3 = 0),
named_struct('version', version, 'action', 'reprocessing_started', 'step', '', 'source', 'failed', 'target', 'processing', 'kept', k % 3 = 0),
named_struct('version', version, 'action', 'step_succeeded', 'step', 'extraction', 'source', 'processing', 'target', 'processing', 'kept', plant <> 1),
named_struct('version', version, 'action', 'step_succeeded', 'step', 'extraction', 'source', 'processing', 'target', 'processing', 'kept', plant = 2),
named_struct('version', version, 'action', 'step_failed', 'step', 'extraction', 'source', 'processing', 'target', 'failed', 'kept', plant = 3),
named_struct('version', version, 'action', 'step_succeeded', 'step', 'indexing', 'source', 'processing', 'target', IF(plant = 4, 'processing', 'pending_approval'), 'kept', true),
named_struct('version', 1L, 'action', 'superseded', 'step', '', 'source', 'approved', 'target', 'superseded', 'kept', version = 2 AND plant NOT IN (5, 6)),
named_struct('version', version, 'action', 'approved', 'step', '', 'source', 'pending_approval', 'target', 'approved', 'kept', version <= 2 AND plant <> 5),
named_struct('version', version, 'action', 'rejected', 'step', '', 'source', 'pending_approval', 'target', 'rejected', 'kept', version > 2),
named_struct('version', version, 'action', 'reprocessing_started', 'step', '', 'source', 'rejected', 'target', 'processing', 'kept', version > 2),
named_struct('version', version, 'action', 'step_succeeded', 'step', 'extraction', 'source', 'processing', 'target', 'processing', 'kept', version > 2 AND plant <> 7),
named_struct('version', version, 'action', 'step_succeeded', 'step', 'indexing', 'source', 'processing', 'target', 'pending_approval', 'kept', version > 2),
named_struct('version', IF(plant = 8, version - 1, version), 'action', 'rejected', 'step', '', 'source', 'pending_approval', 'target', 'rejected', 'kept', version > 2 AND plant <> 5)), x -> x.kept)) AS (place, e) FROM v)
SELECT document, e.version AS version, row_number() OVER (PARTITION BY document ORDER BY v.version, place) AS sequence, e.action AS action, nullif(e.step, '') AS step, IF(e.action IN ('registered', 'reprocessing_started'), sha256, null) AS sha256, 'reviewer' AS actor, nullif(e.source, '') AS source_status, e.target AS target_status, v.version AS occurred_at FROM e AS v"""


def governed_log(spark, sf_dir, plants: bool):
    """A full event log: each customer is a document, each order a version of it. With plants, some versions break a rule."""
    # Orders are parted by customer before that column gets its other name, so the events, a hundred times their bytes, already lie by document and don't move.
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").repartition("o_custkey")
    return spark.sql(_GOVERNED.replace("{plants}", str(plants).lower()), orders=orders)


@register("LC-3 LC-4")
def governed_history_problems(spark, sf_dir):
    """Every rule of registering and of the steps on a log with planted breaks; each rule is held against a planted break in the tests."""
    return lifecycle.history_problems(governed_log(spark, sf_dir, True), "document")


@register("LC-3")
def registration_outcomes(spark, sf_dir):
    """Commands to register, by fifths: exact repeats, repeats by another actor, known content under a new number, a skipped number, new content."""
    log = governed_log(spark, sf_dir, True)
    first = log.where("action = 'registered'")
    last = log.groupBy("document").agg(F.max("version").alias("top"), F.max("occurred_at").alias("now"))
    kind = F.pmod("document", F.lit(5))
    commands = first.join(last, "document").where("version = top").select(
        "document", F.when(kind < 2, F.col("version")).when(kind == 3, F.col("version") + 2).otherwise(F.col("version") + 1).alias("version"),
        F.when(kind < 3, F.col("sha256")).otherwise(F.sha2(F.concat("sha256", F.lit("+")), 256)).alias("sha256"), F.when(kind == 1, F.lit("other")).otherwise(F.col("actor")).alias("actor"), F.col("now").alias("occurred_at"))
    return lifecycle.registrations(log, commands, "document")


@register("LC-5")
def audited_swaps(spark, sf_dir):
    """The last event of each document as a command on the rest; by sixths with a stored event changed, none added, a broken event, or another state than the replay's."""
    log = governed_log(spark, sf_dir, False).withColumn("occurred_at", F.col("occurred_at").cast("long"))
    sizes = log.groupBy("document").agg(F.max("sequence").alias("command"))
    both = log.join(sizes, "document")
    history = both.where("sequence < command").drop("command")
    kind = F.pmod("document", F.lit(6))
    proposed = both.where((kind != 2) | (F.col("sequence") < F.col("command"))).withColumn("actor", F.when((kind == 1) & (F.col("sequence") == 1), F.lit("other")).otherwise(F.col("actor")))
    proposed = proposed.withColumn("source_status", F.when((kind == 3) & (F.col("sequence") == F.col("command")), F.lit("received")).otherwise(F.col("source_status")))
    states = lifecycle.replayed(proposed, ["document", "command", "version"]).select("document", "command", "version", F.when((kind == 4) & (F.col("version") == 1), F.lit("failed")).otherwise(F.col("status")).alias("status"))
    stored = sizes.select("document", (F.col("command") - 1).alias("revision"), (F.col("command") - 1).alias("last_command"))
    return lifecycle.audited_swaps(stored, history, sizes.select("document", F.when(kind == 5, F.col("command") + 1).otherwise(F.col("command") - 1).alias("expected"), "command"), proposed, states, "document")


@register("JN-1", "SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey")
def versions_with_metadata(spark, sf_dir):
    """The one relational join: versions with their metadata."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@register("JN-11 SRC-12", "SELECT o_custkey AS parent, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS children FROM orders GROUP BY 1")
def children_under_parents(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parent")).agg(F.array_join(F.transform(ordered, lambda s: s["o_orderkey"].cast("string")), ",").alias("children"))


@register("JN-12 JN-13 SO-3 SO-7", "SELECT 'orders without customer' AS check_name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customers without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'customers with orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def referential_checks(spark, sf_dir):
    """Foreign keys as anti and semi joins."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n"))
    return count(o.join(c, on, "left_anti"), "orders without customer").unionAll(count(c.join(o, on, "left_anti"), "customers without orders")).unionAll(count(c.join(o, on, "left_semi"), "customers with orders"))


@register("SO-2 SO-3 SO-4", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS only_right")
def multiset_difference(spark, sf_dir):
    """Both differences of two multisets; equal ones have neither."""
    a, b = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    n = F.count(F.lit(1))
    return a.exceptAll(b).agg(n.alias("only_left")).crossJoin(b.exceptAll(a).agg(n.alias("only_right")))


@register("SNK-8 SNK-9 JN-9", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def idempotent_upsert(spark, sf_dir):
    """Half of the records stored before, all sent again: nothing doubles, nothing changes."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return doc.upsert(c.where("c_mktsegment < 'F'"), c, ["c_custkey"])
