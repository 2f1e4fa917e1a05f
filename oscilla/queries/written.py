"""Queries whose rows go through a reader or a writer: each writes into the shared folder, reads back and is held against SQL over the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import documents as doc
from ..operators import profile
from ..plans import canonical
from ..plans import models as plans
from ..plans import privacy
from ..shared import folder
from ..sources import commits, files, layout, ranges, readings
from ..streaming import streams
from . import Register, read
from .models import _E, _NN, parts

register = Register()


@register("SRC-1 SRC-2", f"WITH {readings.DUCK_READINGS}, w AS (SELECT count(*) AS dated FROM readings) SELECT fault, count(*) AS n, round(sum(temperature_c), 6) AS total_c, max(rpm) AS most_rpm, max(dated) AS dated FROM readings, w GROUP BY fault")
def csv_readings(spark, sf_dir):
    """The whole contract written as CSV and read by the pinned reader; one column again by itself."""
    path = folder(spark, "csv")
    readings.derived(spark, sf_dir).select(*readings.SCHEMA.names).write.option("header", True).csv(path)
    whole, dates = readings.read_csv(spark, path), readings.read_csv_column(spark, path, "created_at")
    made = whole.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("temperature_c"), 6).alias("total_c"), F.max("rpm").alias("most_rpm"))
    return made.crossJoin(dates.agg(F.count("created_at").alias("dated")))


@register("SNK-1 SRC-6 SRC-5", "SELECT 'orders' AS table_name, count(*) AS n, sum(o_custkey)::BIGINT AS total, true AS written, false AS again FROM orders UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT, true, false FROM customer")
def published_tables(spark, sf_dir):
    """Two tables published at once; the same digest again writes nothing; both read back under their schema."""
    path, tables = folder(spark, "dataset"), {"orders": "o_custkey", "customer": "c_custkey"}
    frames = {t: read(spark, sf_dir, t) for t in tables}
    digest = canonical.manifest_of(frames)
    written, again, made = files.publish(spark, frames, path, digest), files.publish(spark, frames, path, digest), None
    for t, key in tables.items():
        own = files.checked_parquet(spark, f"{path}/{t}", frames[t].schema).agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("total"))
        own = own.select(F.lit(t).alias("table_name"), "n", "total", F.lit(written).alias("written"), F.lit(again).alias("again"))
        made = own if made is None else made.unionAll(own)
    return made


#: Rows of a file here: far fewer than layout.FILE_ROWS, so that the smallest tables have several.
_FILE_ROWS = 1 << 10


@register("SNK-3", f"WITH r AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1) // {_FILE_ROWS} AS part FROM orders) SELECT part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total, true AS equal FROM r GROUP BY part")
def byte_equal_orders(spark, sf_dir):
    """Orders written twice from 3 and from 7 partitions: rows of each file, and whether both files have equal bytes."""
    orders, paths = read(spark, sf_dir, "orders"), {n: folder(spark, f"layout{n}") for n in (3, 7)}
    for n, path in paths.items():
        layout.write(orders.repartition(n), path, "o_orderkey", "o_custkey", _FILE_ROWS)
    held = spark.read.parquet(paths[3]).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return held.join(layout.differing(spark, *paths.values()), "part")


#: Bytes of a range here, for several ranges in each file.
_RANGE = 1 << 13
_LINES = f"""WITH r AS (SELECT doc_id, n_chars, concat_ws(',', doc_id, source, lang, n_chars, coalesce(md5(text), '-')) AS line, (row_number() OVER (ORDER BY doc_id, n_chars) - 1) // {_FILE_ROWS} AS part FROM documents),
    f AS (SELECT part, string_agg(line || chr(10), '' ORDER BY doc_id, n_chars) AS a, string_agg(CASE WHEN doc_id % 500 = 3 THEN left(line, -1) || '?' ELSE line END || chr(10), '' ORDER BY doc_id, n_chars) AS b FROM r GROUP BY part),
    s AS (SELECT part, a, b, unnest(range(0, length(a), {_RANGE})) AS start FROM f)
    SELECT part::BIGINT AS part, start, sha256(substr(a, start + 1, {_RANGE})) AS sha256, CASE WHEN substr(a, start + 1, {_RANGE}) <> substr(b, start + 1, {_RANGE}) THEN 'content' END AS problem FROM s"""


@register("SRC-3 KN-7", _LINES)
def sealed_ranges_documents(spark, sf_dir):
    """A line for each document, in a fixed order, sealed by ranges of bytes; a second writing with one byte changed in some lines is held against that seal."""
    documents, made = read(spark, sf_dir, "documents"), {n: folder(spark, f"lines-{n}") for n in ("sealed", "changed")}
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string"), F.coalesce(F.md5(F.col("text")), F.lit("-")))
    lines = documents.select("doc_id", "n_chars", line.alias("line"))
    layout.write_lines(lines, F.col("line"), made["sealed"], "doc_id", "n_chars", _FILE_ROWS)
    other = F.when(F.col("doc_id") % 500 == 3, F.concat(F.substring("line", F.lit(1), F.length("line") - 1), F.lit("?"))).otherwise(F.col("line"))
    layout.write_lines(lines, other, made["changed"], "doc_id", "n_chars", _FILE_ROWS)
    # Spark's writers put the id of a run into names of files; the folder of a part is its name here.
    manifest, named = folder(spark, "seal"), r"^part=(\d+)/"
    root = ranges.seal(spark, made["sealed"], manifest, _RANGE, named)
    found = ranges.problems(spark, made["changed"], manifest, root, named)
    return spark.read.parquet(manifest).join(found, ["name", "start"], "left").select(F.col("name").cast("long").alias("part"), "start", "sha256", "problem")


@register("SRC-6 SRC-3", "SELECT 'documents' AS table_name, count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders")
def verified_tables(spark, sf_dir):
    """The files of two tables sealed where they lie, and rows read only after their bytes are held against the seal; once more after the rows are counted."""
    made = None
    for t, key in (("documents", "doc_id"), ("orders", "o_orderkey")):
        path, manifest = f"{sf_dir}/{t}.parquet", folder(spark, "seal")
        root, schema = ranges.seal(spark, path, manifest), spark.read.parquet(path).schema
        count = lambda p, key=key, schema=schema: files.checked_parquet(spark, p, schema).agg(F.count(F.lit(1)), F.sum(key)).first()
        own = spark.createDataFrame([(t, *ranges.consume(spark, path, manifest, root, count))], "table_name string, n long, total long")
        made = own if made is None else made.unionAll(own)
    return made


@register("SRC-6", "SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5 FROM documents")
def verified_documents(spark, sf_dir):
    """Documents sealed where they lie, and their rows parsed after all bytes are held against that seal."""
    path, manifest = f"{sf_dir}/documents.parquet", folder(spark, "seal")
    root = ranges.seal(spark, path, manifest)
    rows = ranges.parquet(spark, path, manifest, root, spark.read.parquet(path).schema)
    return rows.select("doc_id", "source", "lang", "n_chars", F.md5(F.col("text")).alias("text_md5"))


@register("PL-8", f"WITH g AS (SELECT source, lang, n_chars // 10 AS size, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT text) AS texts, count(n_chars) AS sized, count(text) AS written FROM documents GROUP BY ALL) SELECT source, lang, size, CASE WHEN n >= {privacy.LEAST} THEN n END AS n, n < {privacy.LEAST} AS suppressed, CASE WHEN sized >= {privacy.LEAST} THEN chars END AS chars, CASE WHEN written >= {privacy.LEAST} THEN texts END AS texts FROM g")
def public_summary_documents(spark, sf_dir):
    """Figures of documents by source, language and size, saved through a sink that lets only classified fields out; small groups keep their row without figures."""
    rows = read(spark, sf_dir, "documents").withColumn("size", F.floor(F.col("n_chars") / 10))
    rows = privacy.classify(rows, {"doc_id": "record", "text": "record", "n_chars": "record", "source": "category", "lang": "category", "size": "category"})
    path, made = folder(spark, "public"), privacy.summary(rows, ["source", "lang", "size"], {"chars": ("sum", "n_chars"), "texts": ("distinct", "text")})
    canonical.save_report(made, path, strict=True)
    return spark.read.schema(made.schema).json(path)


@register("SNK-4 SNK-5", "WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 5000 <> 1 GROUP BY 1) SELECT (SELECT count(*) FROM a) AS first_written, 0::BIGINT AS same_written, (SELECT count(*) FROM b JOIN a USING (p) WHERE a.n <> b.n) AS changed_written, (SELECT sum(n)::BIGINT FROM b) AS stored")
def changed_inventory_orders(spark, sf_dir):
    """An inventory written, written again unchanged, and once more after some orders went: only what differs is touched."""
    path, orders = folder(spark, "inventory"), read(spark, sf_dir, "orders")
    inventory = lambda df: df.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = [files.write_changed(inventory(df), path, "p", 1000) for df in (orders, orders, orders.where("o_orderkey % 5000 <> 1"))]
    stored = spark.read.schema("value string, key string").format("text").load(path).agg(F.sum(F.get_json_object("value", "$.n").cast("long")).alias("stored"))
    return stored.select(*(F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("first_written", "same_written", "changed_written"), strict=True)), "stored")


@register("SNK-2 SNK-3", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "events", "orders")))
def manifest_rows(spark, sf_dir):
    """Rows of each table as a manifest has them; two makings must agree."""
    frames = {t: read(spark, sf_dir, t) for t in ("customer", "events", "orders")}
    found = json.loads(canonical.twice(lambda: canonical.manifest_of(frames)))
    return spark.createDataFrame([(t, e["rows"]) for t, e in found.items()], "table_name string, n long")


@register("SNK-12", "SELECT o_orderstatus AS status, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, true AS kept FROM orders GROUP BY 1")
def saved_report_orders(spark, sf_dir):
    """A report saved once; a second one at its place is refused, and the first stays."""
    path, orders = folder(spark, "report"), read(spark, sf_dir, "orders")
    report = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    canonical.save_report(report, path)
    try:
        canonical.save_report(report.limit(0), path)
        kept = False
    except Exception as e:
        kept = "exists" in str(e)
    return spark.read.schema("status string, n long, cents long").json(path).withColumn("kept", F.lit(kept))


@register("SNK-6 SNK-7 KN-6 KN-7", f"WITH {_E} SELECT sha256('neighbour:' || vec_id) AS opaque_id, label, 64 AS dimension FROM t")
def model_artifact_index(spark, sf_dir):
    """A model fitted, saved, loaded under its identity, and the index made from what was loaded."""
    train, queries = parts(spark, sf_dir)
    path = folder(spark, "model")
    identity = plans.save(plans.fit(train, queries.select("query_id", "v"))[0], path)
    stored = plans.index(plans.load(spark, path, identity)["vectors"])
    return stored.select("opaque_id", "label", F.size("v").alias("dimension"))


@register("KN-12", f"WITH {_E}, p AS (SELECT CASE WHEN vec_id % 4 <> 0 AND label < 8 THEN 'train' WHEN vec_id % 8 = 0 THEN 'validation' WHEN vec_id % 4 = 0 THEN 'test' END AS part FROM e) SELECT part, count(*) AS n, true AS same FROM p WHERE part IS NOT NULL GROUP BY part")
def frozen_plan_embeddings(spark, sf_dir):
    """What an evaluation is bound to before it reads the test part: rows of each part; made twice under one id."""
    train, queries = parts(spark, sf_dir)
    dataset = {"train": train, "validation": queries.where("query_id % 8 = 0"), "test": queries.where("query_id % 8 <> 0")}
    tables, _ = plans.fit(train, dataset["validation"].select("query_id", "v"))
    tables = {n: canonical.cut(t) for n, t in tables.items()}
    made = [plans.frozen_plan(dataset, tables, canonical.manifest_of(tables), plans.index(tables["vectors"]), "validation") for _ in range(2)]
    rows = [(p, e["rows"], made[0] == made[1]) for p, e in json.loads(made[0][1])["dataset"].items()]
    return spark.createDataFrame(rows, "part string, n long, same boolean")


@register("SRC-13", "SELECT vec_id AS request_id, CASE vec_id % 5 WHEN 1 THEN 'dimension' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'top_k' END AS problem FROM embeddings WHERE vec_id % 5 IN (1, 2, 3)")
def request_problems_embeddings(spark, sf_dir):
    """Requests with a planted fault in three of five: a short vector, a value that is no number, too many neighbours."""
    kind, v = F.col("vec_id") % 5, F.slice(vectors.doubles(F.col("embedding")), 1, 18)
    v = F.when(kind == 1, F.slice(v, 1, 17)).when(kind == 2, F.transform(v, lambda x, i: F.when(i == 3, float("nan")).otherwise(x))).otherwise(v)
    return plans.request_problems(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), v.alias("v"), F.when(kind == 3, 11).otherwise(5).alias("top_k")))


@register("SX-6", f"WITH {_NN} SELECT query_id, rank::INT AS rank, ref FROM n")
def stream_scores_embeddings(spark, sf_dir):
    """Queries that arrive as files are ranked batch by batch, as in batch."""
    train, queries = parts(spark, sf_dir)
    path = folder(spark, "scores")
    queries.select("query_id", "v").write.parquet(f"{path}/in")
    streams.score(streams.source(spark, f"{path}/in", queries.select("query_id", "v").schema), train, f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query_id", "rank", "ref")


def _commands() -> str:
    """Three rounds of compare and swap, one after another."""
    out, known = [], "SELECT NULL::BIGINT AS k, NULL::BIGINT AS version, NULL::BIGINT AS last WHERE false"
    for r in range(3):
        out.append(f"s{r} AS ({known})")
        out.append(f"j{r} AS (SELECT o_custkey AS k, o_orderkey AS command, CASE WHEN o_orderkey <> min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'behind' WHEN (o_orderkey // 3) % 2 = coalesce(version, 0) THEN 'applied' ELSE 'stale' END AS outcome, coalesce(version, 0) AS was FROM orders LEFT JOIN s{r} ON k = o_custkey WHERE o_orderkey % 3 = {r})")
        known = f"SELECT k, max(version) AS version, max_by(last, version) AS last FROM (SELECT * FROM s{r} UNION ALL SELECT k, was + 1, command FROM j{r} WHERE outcome = 'applied') GROUP BY k"
    return f"WITH {', '.join(out)}, e AS ({known}), o AS (SELECT * FROM j0 UNION ALL SELECT * FROM j1 UNION ALL SELECT * FROM j2) SELECT o.k AS o_custkey, command, outcome, coalesce(version, 0)::BIGINT AS version, last::BIGINT AS last FROM o LEFT JOIN e ON e.k = o.k"


@register("SNK-10 SNK-11 LC-5", _commands())
def registry_commits_orders(spark, sf_dir):
    """Orders as commands on a registry of customers, in three units of work; between them a unit is rolled back and a stale one refused."""
    store, outcomes = commits.Store(spark, folder(spark, "registry")), None
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("last"), (F.floor(F.col("o_orderkey") / 3) % 2).alias("expected"), F.col("o_orderkey").alias("command"))
    for r in range(3):
        stale = store.unit()
        with store.unit() as unit:
            own = commits.swap(unit, "registry", ["o_custkey"], orders.where(F.col("command") % 3 == r))
            own = canonical.cut(own)
            outcomes = own if outcomes is None else outcomes.unionByName(own)
            unit.commit()
        with store.unit() as unit:
            commits.swap(unit, "registry", ["o_custkey"], orders.where(F.col("command") % 3 != r))
        commits.swap(stale, "registry", ["o_custkey"], orders.limit(1))
        try:
            stale.commit()
            raise RuntimeError("a stale unit of work was committed")
        except commits.Conflict:
            pass
    return outcomes.join(store.read("registry"), "o_custkey", "left").withColumn("version", F.coalesce("version", F.lit(0).cast("long")))


@register("AG-8", "WITH r AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 1 UNION ALL SELECT * REPLACE (l_tax + 1 AS l_tax) FROM lineitem WHERE l_orderkey % 100 = 2), g AS (SELECT count(*) AS n FROM r GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) SELECT count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS excess_rows FROM g")
def whole_row_duplicates_lineitem(spark, sf_dir):
    """Whole rows that come again; some are planted, and some that differ in one column only."""
    rows = read(spark, sf_dir, "lineitem")
    more = rows.where("l_orderkey % 100 = 2").withColumn("l_tax", F.col("l_tax") + 1)
    return profile.row_duplicates(rows.unionByName(rows.where("l_orderkey % 100 = 1")).unionByName(more))


@register("FN-15 UX-2 PL-10")
def hash_embedding_chunks(spark, sf_dir):
    """The deterministic vectors of all chunks of all documents, in 32 places; SQL has no SHAKE-256."""
    chunks = doc.identified(doc.chunks(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    v = chunks.select("chunk_id", tx.hash_embedding()("content").alias("v"))
    return v.select("chunk_id", F.size("v").alias("dimension"), F.round(vectors.dot(F.col("v"), F.col("v")), 9).alias("power"), F.round(F.element_at("v", 1), 9).alias("first"))
