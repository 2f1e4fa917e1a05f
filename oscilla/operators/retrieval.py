"""Governed retrieval: eligible documents, term weights, ranking, budget, answer or abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain

#: Budget of evidence, threshold and tie width of an answer.
MOST_ITEMS, MOST_CHARACTERS, MOST_ITEM = 12, 24_000, 4_000
LEAST_SCORE, TIE = 0.25, 1e-12
#: Items that a class gives for ranking, features of a ranking, items that it returns.
CATALOG, FEATURES, ANSWERS = 10, 2_048, 3
TOKEN = r"[\p{L}\p{N}_]{2,}"


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): words of two characters or more and pairs of neighbours, small letters without accents.

    Texts move once, to their key; terms are then counted where they are, and rows of one key stay together."""
    words = F.regexp_extract_all(plain(F.col(text)), F.lit(f"({TOKEN})"), F.lit(1))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = df.select(key, text).repartition(key).select(key, words.alias("w")).select(key, F.explode(F.concat("w", pairs)).alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse(corpus: DataFrame, documents: int) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1."""
    return corpus.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(corpus: DataFrame, key: str, documents: int) -> tuple[DataFrame, DataFrame]:
    """(key, term, weight) with unit length for each key, and (term, idf)."""
    idf = inverse(corpus, documents)
    return normed(corpus, idf, key), idf


def raw_weights(tf: DataFrame, idf: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, term, raw) and (key, length): term counts by idf, and their Euclidean length. Terms without an idf count for nothing."""
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    return raw, raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))


def normed(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Unit term vectors."""
    raw, length = raw_weights(tf, idf, key)
    return raw.join(length, key).select(key, "term", (F.col("raw") / F.nullif(F.col("length"), F.lit(0.0))).alias("weight"))


def scored(questions: DataFrame, corpus: DataFrame, idf: DataFrame, question: str, document: str) -> DataFrame:
    """(question, document, score): cosine of term vectors, for pairs that share a term. questions, corpus: (key, term, tf).

    A document's weights go no further than to the questions' terms: lengths divide the finished sums, not each weight."""
    asked = normed(questions, idf, question).select(question, "term", F.col("weight").alias("x"))
    raw, length = raw_weights(corpus, idf, document)
    dots = asked.join(raw, "term").groupBy(question, document).agg(F.sum(F.col("x") * F.col("raw")).alias("dot"))
    return dots.join(length, document).select(question, document, (F.col("dot") / F.nullif(F.col("length"), F.lit(0.0))).alias("score"))


def top(df: DataFrame, by: str, score: str, ties: list[str], k: int) -> DataFrame:
    """The k best of each group in a total order; minus zero counts as zero."""
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.col(score) + F.lit(0.0)), *ties))
    return df.withColumn("rank", order).where(F.col("rank") <= k)


def budget(df: DataFrame, by: str, length: str, score: str, ties: list[str]) -> DataFrame:
    """The longest prefix of each group, by score, that stays within the budget; `fits` is false for all of a group if one item alone is too long.

    Only the best MOST_ITEMS of a group are ordered; what holds for all of it is one aggregate."""
    fits = df.groupBy(by).agg((~F.bool_or(F.col(length) > MOST_ITEM)).alias("fits"))
    ranked = top(df, by, score, ties, MOST_ITEMS)
    used = F.sum(length).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= MOST_CHARACTERS).join(fits, by)


def answer(df: DataFrame, by: str, content: str) -> DataFrame:
    """One row a group: the best item, or why there is no answer. df: ranked, with score."""
    made = df.groupBy(by).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col(content))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col(content))).alias("other"))
    tied = (F.col("second").isNotNull()) & (F.col("best") - F.col("second") <= TIE) & (F.col("first") != F.col("other"))
    decision = F.when(F.col("best") < LEAST_SCORE, "insufficient_score").when(tied, "insufficient_tie").otherwise("answered")
    return made.select(by, "best", decision.alias("decision"))


def mapped(classes: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(key, place, document_id) with one row of null document for a class that is mapped to nothing, and `mapped` false for one without a mapping."""
    joined = classes.join(mapping, key, "left")
    return joined.select(key, F.col("documents").isNotNull().alias("mapped"), F.posexplode_outer("documents").alias("place", "document_id"))


def current(snapshots: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots that are no longer there with the same keys and content."""
    return snapshots.join(now, keys, "left_anti")


def eligible(status: Column, extracted: Column, indexed: Column, is_current: Column) -> Column:
    return (status == "approved") & extracted & indexed & is_current


def approved(classes: DataFrame, mapping: DataFrame, states: DataFrame, chunks: DataFrame, by: str, document: str, score: str, ties: list[str]) -> DataFrame:
    """(by, reason, chunk's columns, place): the CATALOG best sound chunks of eligible documents that each class is mapped to.

    classes: (by); mapping: (by, document); states: (document, is_eligible) by `eligible`; chunks: (document, is_sound, score, ...).
    A class that gives nothing has one row with the reason: fault_class_unmapped, no_approved_coverage or empty_ranking."""
    own = mapping.join(states, document, "left").withColumn("is_eligible", F.coalesce("is_eligible", F.lit(False)))
    covered = own.groupBy(by).agg(F.bool_or("is_eligible").alias("covered"))
    found = own.where("is_eligible").select(by, document).join(chunks.where("is_sound").drop("is_sound"), document)
    best = top(found, by, score, ties, CATALOG).withColumnRenamed("rank", "place")
    reason = F.when(F.col("covered").isNull(), "fault_class_unmapped").when(~F.col("covered"), "no_approved_coverage").when(F.col("place").isNull(), "empty_ranking")
    return classes.select(by).distinct().join(covered, by, "left").join(best, by, "left").withColumn("reason", reason).drop("covered")


def stale(snapshots: DataFrame, now: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, is_stale): whether any snapshot of a class is no longer among what may be used now with the same keys."""
    used = snapshots.where("reason is null")
    gone = current(used, now.select(*keys).distinct(), keys).select(by).distinct().withColumn("is_stale", F.lit(True))
    return used.select(by).distinct().join(gone, by, "left").select(by, F.coalesce("is_stale", F.lit(False)).alias("is_stale"))


def ranked(questions: DataFrame, evidence: DataFrame, question: str, by: str, item: str) -> DataFrame:
    """(question, item, score, rank) of the ANSWERS best items of the question's class by cosine of term weights that are fitted on the class's own items.

    evidence: (by, item, content), CATALOG items a class at most; questions: (question, by, text). Every join is within a
    class, so a common term pairs a question with CATALOG items and no more. The FEATURES most frequent terms of a class count, ties by term."""
    tf = terms(evidence.select(F.struct(by, item).alias("key"), "content"), "key", "content").select(f"key.{by}", f"key.{item}", "term", "tf")
    vocabulary = tf.groupBy(by, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "term"))
    sizes = evidence.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    idf = vocabulary.withColumn("place", place).where(F.col("place") <= FEATURES).join(sizes, by).select(by, "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    asked = terms(questions.select(F.struct(question, by).alias("key"), "text"), "key", "text").select(f"key.{question}", f"key.{by}", "term", "tf")
    a = asked.join(idf, [by, "term"]).select(question, by, "term", (F.col("tf") * F.col("idf")).alias("x"))
    d = tf.join(idf, [by, "term"]).select(by, item, "term", (F.col("tf") * F.col("idf")).alias("y"))
    lengths = lambda df, keys, w, name: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(name))
    dots = a.join(d, [by, "term"]).groupBy(question, item).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = questions.select(question, by).join(evidence.select(by, item), by).join(dots, [question, item], "left")
    pairs = pairs.join(lengths(a, [question], "x", "p"), question, "left").join(lengths(d, [by, item], "y", "r"), [by, item], "left")
    score = F.round(F.coalesce(F.col("dot") / (F.col("p") * F.col("r")), F.lit(0.0)), 12)
    return top(pairs.select(question, item, score.alias("score")), question, "score", [item], ANSWERS)


def replied(questions: DataFrame, ranking: DataFrame, catalog: DataFrame, staleness: DataFrame, question: str, by: str) -> DataFrame:
    """(question, best, decision): answered, or what stands against it: the catalog's reason, insufficient_stale, insufficient_score, insufficient_tie. ranking: with content_sha256."""
    reasons = catalog.groupBy(by).agg(F.max("reason").alias("reason"))
    made = questions.select(question, by).join(reasons, by, "left").join(staleness, by, "left").join(answer(ranking, question, "content_sha256"), question, "left")
    decision = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.coalesce("is_stale", F.lit(False)), "insufficient_stale").otherwise(F.col("decision"))
    return made.select(question, "best", decision.alias("decision"))
