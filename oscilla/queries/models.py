"""Nearest neighbours with abstention, their index and their evaluation, over the embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numbers import rate, wilson
from ..operators import evaluation, neighbours, pruning
from . import Register, read

register = Register()
POLICY = neighbours.Policy(distance=8.5, margin=0.2, least_class=20)


def parts(spark, sf_dir):
    """Training vectors (three in four; labels 8 and 9 are withheld) and queries (one in four)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    train = e.where("vec_id % 4 <> 0 and label < 8").select(F.col("vec_id").alias("ref"), "label", "v")
    queries = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), "v")
    return train, queries


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings), t AS (SELECT * FROM e WHERE vec_id % 4 <> 0 AND label < 8), q AS (SELECT * FROM e WHERE vec_id % 4 = 0)"
_NN = _E + ", d AS (SELECT q.vec_id AS query_id, q.label AS truth, t.vec_id AS ref, t.label, array_distance(q.v, t.v) AS distance FROM q, t), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref) AS rank FROM d) WHERE rank <= 5)"
_VOTE = _NN + """, c AS (SELECT query_id, truth, label, count(*) AS votes, sum(distance) AS total, min(distance) AS nearest FROM n GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, total, label) AS place FROM c),
v AS (SELECT query_id, max(truth) AS truth, max(label) FILTER (place = 1) AS candidate, max(votes) FILTER (place = 1) AS votes, max(votes) FILTER (place = 1) / 5.0 AS vote_share, (max(votes) FILTER (place = 1) - coalesce(max(votes) FILTER (place = 2), 0)) / 5.0 AS vote_margin, min(nearest) AS nearest_distance FROM p GROUP BY query_id)"""
_DECIDED = _VOTE + ", k AS (SELECT label, count(*) AS class_count FROM t GROUP BY label), r AS (SELECT v.*, class_count, CASE WHEN nearest_distance > 8.5 THEN 'distance' WHEN class_count < 20 THEN 'class_count' WHEN vote_margin <= 0.2 THEN 'vote_margin' END AS abstention FROM v LEFT JOIN k ON k.label = v.candidate)"


@register("AG-23 KN-1", f"WITH {_E}, x AS (SELECT unnest(range(1, 65)) AS place, unnest(v::DOUBLE[]) AS value FROM t) SELECT (place - 1)::INT AS place, round(avg(value), 6) AS mean, round(CASE WHEN var_pop(value) > 0 THEN sqrt(var_pop(value)) ELSE 1 END, 6) AS scale, count(*) AS n FROM x GROUP BY place")
def scaler_stats_embeddings(spark, sf_dir):
    made = neighbours.scaler(parts(spark, sf_dir)[0])
    return made.select("n", F.posexplode(F.arrays_zip("mean", "scale")).alias("place", "x")).select("place", F.round("x.mean", 6).alias("mean"), F.round("x.scale", 6).alias("scale"), "n")


@register("FN-16 KN-1", f"WITH {_E}, x AS (SELECT vec_id, unnest(range(1, 65)) AS place, unnest(v::DOUBLE[]) AS value FROM t), s AS (SELECT place, avg(value) AS m, sqrt(var_pop(value)) AS d FROM x GROUP BY place) SELECT vec_id AS ref, round(sum((value - m) / d), 6) AS total, round(sum(((value - m) / d) * ((value - m) / d)), 6) AS power FROM x JOIN s USING (place) GROUP BY vec_id")
def standardized_vectors(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    z = neighbours.standardized(train, neighbours.scaler(train))
    return z.select("ref", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("power"))


@register("JN-8 WN-10 ST-2 ST-3 FN-17 KN-2 KN-8 UX-7", f"WITH {_NN} SELECT query_id, rank::INT AS rank, ref, label, round(distance, 6) AS distance FROM n")
def knn_top5_embeddings(spark, sf_dir):
    train, queries = parts(spark, sf_dir)
    return neighbours.ranked(queries, train).select("query_id", "rank", "ref", "label", F.round("distance", 6).alias("distance"))


@register("JN-8 KN-2 KN-8", f"WITH {_NN} SELECT query_id, rank::INT AS rank, ref, label, round(distance, 6) AS distance FROM n")
def knn_pruned_embeddings(spark, sf_dir):
    """The same rows by pivots and radii; what the triangle inequality rules out is not measured."""
    train, queries = parts(spark, sf_dir)
    found, _ = pruning.nearest(queries, train)
    return found.select("query_id", "rank", "ref", "label", F.round("distance", 6).alias("distance"))


@register("JN-8 KN-2")
def knn_pruned_pairs_embeddings(spark, sf_dir):
    """How many pairs of queries and training rows pruning measured, of how many; the tests hold it to a tenth on clustered vectors."""
    train, queries = parts(spark, sf_dir)
    return pruning.nearest(queries, train)[1]


@register("PRJ-14 KN-8", f"WITH {_E}, d AS (SELECT q.vec_id AS query_id, t.vec_id AS ref, t.label, array_distance(q.v, t.v) AS distance FROM q, t WHERE t.label IN (1, 3, 5)) SELECT query_id, rank::INT AS rank, ref, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref) AS rank FROM d) WHERE rank <= 3")
def knn_filtered_classes(spark, sf_dir):
    """Neighbours of listed classes only; the filter lies below the distances."""
    train, queries = parts(spark, sf_dir)
    return neighbours.ranked(queries, train.where(F.col("label").isin(1, 3, 5)), 3).select("query_id", "rank", "ref", "label")


def decided(spark, sf_dir):
    train, queries = parts(spark, sf_dir)
    v = neighbours.voted(neighbours.ranked(queries, train)).join(queries.select("query_id", "truth"), "query_id")
    counts = train.groupBy(F.col("label").alias("candidate")).agg(F.count(F.lit(1)).alias("class_count"))
    return v.join(counts, "candidate", "left").withColumn("abstention", neighbours.abstention(POLICY, F.col("nearest_distance"), F.col("class_count"), F.col("vote_margin")))


@register("AG-24 KN-2 UX-4", f"WITH {_VOTE} SELECT query_id, candidate, votes, vote_share, vote_margin, round(nearest_distance, 6) AS nearest_distance FROM v")
def knn_vote_embeddings(spark, sf_dir):
    train, queries = parts(spark, sf_dir)
    return neighbours.voted(neighbours.ranked(queries, train)).withColumn("nearest_distance", F.round("nearest_distance", 6))


@register("FN-22 FN-23 KN-4", f"WITH {_DECIDED} SELECT query_id, candidate, abstention, round(vote_share / (1 + nearest_distance / 8.5), 6) AS support_score, CASE WHEN abstention IS NOT NULL THEN 'out_of_distribution' WHEN candidate = 0 THEN 'normal' ELSE 'fault' END AS disposition FROM r")
def abstention_flags(spark, sf_dir):
    """Public predictions: abstained, normal (label 0) or fault."""
    d = decided(spark, sf_dir)
    disposition = F.when(F.col("abstention").isNotNull(), "out_of_distribution").when(F.col("candidate") == 0, "normal").otherwise("fault")
    return d.select("query_id", "candidate", "abstention", F.round(neighbours.support_score(F.col("vote_share"), F.col("nearest_distance"), POLICY.distance), 6).alias("support_score"), disposition.alias("disposition"))


@register("KN-3 AG-5", f"WITH {_VOTE}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM q), m AS (SELECT vec_id FROM o WHERE i IN (SELECT (k * (n - 1)) // 511 FROM range(512) r(k))), i AS (SELECT nearest_distance, vote_margin, row_number() OVER (ORDER BY nearest_distance) - 1 AS a, row_number() OVER (ORDER BY vote_margin) - 1 AS b, count(*) OVER () AS n FROM v WHERE query_id IN (SELECT vec_id FROM m)) SELECT round(max(nearest_distance) FILTER (a = ceil((n - 1) * 0.95)), 6) AS distance, max(vote_margin) FILTER (b = floor((n - 1) * 0.10)) AS margin FROM i")
def abstention_policy_fit(spark, sf_dir):
    """Fitted on at most 512 evenly spaced rows."""
    train, queries = parts(spark, sf_dir)
    chosen = queries.where(F.col("query_id").isin(neighbours.evenly_spaced_ids(queries, "query_id", neighbours.CALIBRATION)))
    p = neighbours.fit_policy(neighbours.voted(neighbours.ranked(chosen, train)).persist())
    return spark.createDataFrame([(round(p.distance, 6), p.margin)], "distance double, margin double")


@register("KN-3 WN-10", f"WITH {_E}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS ref, array_distance(a.v, b.v) AS distance FROM t a, t b WHERE a.vec_id <> b.vec_id) SELECT query_id, ref, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref) AS rank FROM d) WHERE rank = 1")
def leave_one_out_nearest(spark, sf_dir):
    """Nearest other training row, itself excluded."""
    train, _ = parts(spark, sf_dir)
    own = train.select(F.col("ref").alias("query_id"), "v")
    return neighbours.ranked(own, train, 1, exclude_self=True).select("query_id", "ref", F.round("distance", 6).alias("distance"))


@register("KN-5 AG-25", f"WITH {_E}, c AS (SELECT label, count(*) AS n FROM t GROUP BY label) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code, n, label = (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority FROM c")
def label_table_embeddings(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    n = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top"))
    return neighbours.label_table(train).join(n, "label").crossJoin(F.broadcast(top)).select("label", "code", "n", (F.col("label") == F.col("top")).alias("majority"))


_METRICS = f"""WITH {_NN}, rel AS (SELECT label AS truth, count(*) AS relevant FROM t GROUP BY label), x AS (SELECT n.query_id, CASE WHEN n.truth < 8 THEN 'known' ELSE 'unknown' END AS scope, k.k, n.label = n.truth AS hit, n.rank, coalesce(relevant, 0) AS relevant FROM n JOIN range(1, 6) k(k) ON n.rank <= k.k LEFT JOIN rel ON rel.truth = n.truth),
m AS (SELECT query_id, scope, k, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first_hit, max(relevant) AS relevant FROM x GROUP BY ALL)
SELECT coalesce(scope, 'all') AS scope, k::INT AS k, count(*) AS queries, round(avg((hits > 0)::INT::DOUBLE), 12) AS hit_rate, round(avg(hits / k), 12) AS precision, round(avg(CASE WHEN relevant > 0 THEN hits / relevant END), 12) AS recall, round(avg(coalesce(1.0 / first_hit, 0)), 12) AS mrr FROM m GROUP BY GROUPING SETS ((k), (k, scope))"""


@register("AG-26 WN-11 KN-13 JN-13", _METRICS)
def ranking_metrics_at_k(spark, sf_dir):
    train, queries = parts(spark, sf_dir)
    truth = queries.select("query_id", "truth", F.when(F.col("truth") < 8, "known").otherwise("unknown").alias("scope"))
    relevant = train.groupBy(F.col("label").alias("truth")).agg(F.count(F.lit(1)).alias("relevant"))
    return evaluation.ranking_metrics(neighbours.ranked(queries, train), truth, relevant)


@register("AG-27 AG-28", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT *, round(tp / (tp + fn), 12) AS recall_positive, round(tn / (tn + fp), 12) AS recall_negative, (round(tp / (tp + fn), 12) + round(tn / (tn + fp), 12)) / 2 AS balanced_accuracy FROM c""")
def confusion_binary_labels(spark, sf_dir):
    """One label held against the other, as a 2 x 2 table."""
    return evaluation.confusion(read(spark, sf_dir, "labels"), "quality", "toxic")


_Z = 1.959963984540054
_WILSON = "greatest(0, ({p} + {z} * {z} / (2 * {n}) - {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n}))"
_UPPER = "least(1, ({p} + {z} * {z} / (2 * {n}) + {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n}))"


def _interval(p: str, n: str) -> tuple[str, str]:
    return _WILSON.format(p=p, n=n, z=_Z), _UPPER.format(p=p, n=n, z=_Z)


@register("AG-29 AG-28", "WITH c AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (n_chars > 1500)::DOUBLE AS k FROM documents GROUP BY lang) SELECT lang, round(k / n, 12) AS share, round({}, 12) AS low, round({}, 12) AS high FROM c".format(*_interval("(k / n)", "n")))
def wilson_rates(spark, sf_dir):
    c = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1500).alias("k"))
    w = wilson(F.col("k"), F.col("n"))
    return c.select("lang", rate(F.col("k"), F.col("n")).alias("share"), F.round(w["low"], 12).alias("low"), F.round(w["high"], 12).alias("high"))


@register("AG-30 KN-13", f"WITH {_DECIDED}, g AS (SELECT truth < 8 AS known, count(*)::DOUBLE AS n, count(*) FILTER (abstention IS NULL)::DOUBLE AS k FROM r GROUP BY 1) SELECT known, n::BIGINT AS n, k::BIGINT AS accepted, round(k / n, 12) AS accepted_rate, round((n - k) / n, 12) AS rejected_rate, round({{}}, 6) AS low, round({{}}, 6) AS high FROM g".format(*_interval("(k / n)", "n")))
def open_set_rates(spark, sf_dir):
    d = decided(spark, sf_dir).select((F.col("truth") < 8).alias("known"), F.col("abstention").isNull().alias("accepted"))
    return evaluation.open_set(d).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


_SWEEP = f"""WITH {_VOTE}, s AS (SELECT round(nearest_distance, 3) AS x, vote_margin AS m, truth < 8 AS known, truth = candidate AS correct FROM v), mm AS (SELECT DISTINCT m AS margin FROM s UNION SELECT 0.0 UNION SELECT 1.0),
pt AS (SELECT DISTINCT margin, x AS distance FROM mm JOIN s ON s.m > margin UNION SELECT margin, 0.0 FROM mm)"""


def swept(spark, sf_dir):
    train, queries = parts(spark, sf_dir)
    v = neighbours.voted(neighbours.ranked(queries, train)).join(queries.select("query_id", "truth"), "query_id")
    return evaluation.sweep(v.select(F.round("nearest_distance", 3).alias("nearest_distance"), "vote_margin", F.lit(True).alias("supported"), (F.col("truth") < 8).alias("known"), (F.col("truth") == F.col("candidate")).alias("correct")))


@register("WN-13 SO-5 KN-11", _SWEEP + " SELECT margin::DOUBLE AS margin, distance::DOUBLE AS distance, count(*) FILTER (known)::BIGINT AS known_accepted, count(*) FILTER (NOT known)::BIGINT AS unknown_accepted, count(*) FILTER (known AND correct)::BIGINT AS correct_accepted FROM pt LEFT JOIN s ON s.m > margin AND s.x <= distance GROUP BY ALL")
def open_set_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@register("ST-7 KN-11", _SWEEP + """, a AS (SELECT margin, distance, count(*) FILTER (known) AS kn, count(*) FILTER (NOT known) AS un FROM pt LEFT JOIN s ON s.m > margin AND s.x <= distance GROUP BY ALL), z AS (SELECT count(*) FILTER (known)::DOUBLE AS known, count(*) FILTER (NOT known)::DOUBLE AS unknown FROM s),
b AS (SELECT margin, distance, kn, un, {} AS far_upper, kn / known AS coverage FROM a, z) SELECT margin::DOUBLE AS margin, distance::DOUBLE AS distance, kn::BIGINT AS known_accepted, un::BIGINT AS unknown_accepted, far_upper <= 0.5 AND coverage >= 0.2 AS passes FROM b ORDER BY passes DESC, kn DESC, far_upper, distance, margin DESC LIMIT 1""".format(_interval("(un / unknown)", "unknown")[1]))
def open_set_policy(spark, sf_dir):
    _, queries = parts(spark, sf_dir)
    n = queries.agg(F.count_if(F.col("truth") < 8).alias("known"), F.count_if(F.col("truth") >= 8).alias("unknown")).first()
    return evaluation.choose(swept(spark, sf_dir), n["known"], n["unknown"], 0.5, 0.2).select("margin", "distance", "known_accepted", "unknown_accepted", "passes")


@register("JN-14 KN-9 KN-10 SNK-7", f"""WITH {_NN}, s AS (SELECT vec_id, label, CASE WHEN vec_id % 50 = 3 THEN list_transform(v::DOUBLE[], lambda x, i: CASE WHEN i = 1 THEN x + 0.5 ELSE x END)::DOUBLE[64] ELSE v END AS v FROM t WHERE vec_id % 50 <> 1), d2 AS (SELECT q.vec_id AS query_id, s.vec_id AS ref, array_distance(q.v, s.v) AS distance FROM q, s), n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref) AS rank FROM d2) WHERE rank <= 5),
r AS (SELECT count(*) FILTER (n.ref <> n2.ref) AS refs, count(*) FILTER (abs(n.distance - n2.distance) > 1e-6) AS far FROM n JOIN n2 USING (query_id, rank)) SELECT (SELECT count(*) FROM t WHERE vec_id % 50 = 1) AS one_sided, refs + (SELECT count(*) FROM t WHERE vec_id % 50 = 2) AS different_refs, far + (SELECT count(*) FROM t WHERE vec_id % 50 = 3) AS beyond_tolerance FROM r""")
def index_parity_embeddings(spark, sf_dir):
    """Model and index held against each other, in ranks and in every stored row: the index's vectors went through text and back, and of fifty rows one is missing, one has another label, and one vector is shifted. Each count is over ranks and rows together."""
    train, queries = parts(spark, sf_dir)
    kind, v = F.col("ref") % 50, vectors.from_literal(vectors.literal(F.col("v")))
    shifted = F.transform(v, lambda x, i: F.when(i == 0, x + 0.5).otherwise(x))
    index = train.where(kind != 1).withColumn("label", F.when(kind == 2, F.col("label") + 1).otherwise(F.col("label"))).withColumn("v", F.when(kind == 3, shifted).otherwise(v))
    return index_parity(train, index, queries)


def index_parity(train, index, queries):
    ranks = neighbours.parity(neighbours.ranked(queries, train), neighbours.ranked(queries, index), ["query_id", "rank"])
    opaque = lambda df: df.select(F.sha2(F.concat(F.lit("neighbour:"), F.col("ref").cast("string")), 256).alias("opaque_id"), "label", "v")
    stored = neighbours.stored_parity(opaque(train), opaque(index), "opaque_id").withColumnRenamed("different_labels", "different_refs")
    both = ranks.unionByName(stored)
    return both.agg(*(F.sum(c).alias(c) for c in both.columns))


@register("FN-18 FN-17", f"WITH {_E}, m AS (SELECT label, min(vec_id) AS model_id FROM e GROUP BY label) SELECT a.vec_id, m.model_id, round(greatest(0, least(1, 0.5 + array_cosine_similarity(a.v, b.v) / 2)), 6) AS score FROM e a JOIN m USING (label) JOIN e b ON b.vec_id = m.model_id")
def cosine_scores_embeddings(spark, sf_dir):
    """Every vector against the first of its label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    first = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("model_id"), F.col("v").alias("w")), "vec_id").alias("m")).select("label", "m.*")
    return e.join(first, "label").select("vec_id", "model_id", F.round(vectors.cosine_score(F.col("v"), F.col("w")), 6).alias("score"))


@register("FN-29", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_tax) / nullif(greatest(abs(l_tax), abs(l_discount)), 0), 6) AS tax_ratio, round(abs(l_discount) / nullif(greatest(abs(l_tax), abs(l_discount)), 0), 6) AS discount_ratio FROM lineitem")
def feature_comparison_lineitem(spark, sf_dir):
    """A pair of measurements, each against the larger."""
    most = F.nullif(F.greatest(F.abs("l_tax"), F.abs("l_discount")), F.lit(0.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.abs("l_tax") / most, 6).alias("tax_ratio"), F.round(F.abs("l_discount") / most, 6).alias("discount_ratio"))


_PARITY = f"WITH {_NN}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS c FROM q), m AS (SELECT DISTINCT (j * (c - 1)) // 15 AS i FROM o, range(16) x(j)), w AS (SELECT vec_id AS query_id FROM o JOIN m USING (i)), l AS (SELECT query_id, string_agg(ref::VARCHAR || ':' || label::VARCHAR, ',' ORDER BY rank) AS neighbours FROM n JOIN w USING (query_id) GROUP BY query_id)"


@register("KN-14", _PARITY + " SELECT query_id, neighbours AS batch, neighbours AS single FROM l")
def batch_single_parity_embeddings(spark, sf_dir):
    """Neighbours of 16 evenly spaced queries, once from the batch of all queries and once from a plan for the one row."""
    train, queries = parts(spark, sf_dir)
    wanted = neighbours.evenly_spaced_ids(queries, "query_id", 16)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref", "label"))), lambda s: F.concat(s["ref"].cast("string"), F.lit(":"), s["label"].cast("string"))), ",")
    batch = neighbours.ranked(queries, train).where(F.col("query_id").isin(wanted)).groupBy("query_id").agg(text.alias("batch"))
    single = reduce(DataFrame.unionByName, (neighbours.nearest_of_one(train, queries.where(F.col("query_id") == i)) for i in wanted)).groupBy("query_id").agg(text.alias("single"))
    return batch.join(single, "query_id", "full")
