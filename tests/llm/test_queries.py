"""The opN queries and the pipeline over small tables, against SQL, brute force or held-out labels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oscilla.llm import minhash, packing, pretokens, quality, toxicity
from oscilla.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, same

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


def test_sharding_query(spark, small):
    found, docs = QUERIES["op1_sharding_bytes"](spark, small).toPandas(), documents(spark, small)
    both = found.merge(docs, on="doc_id")
    assert len(both) == len(docs) and all(len(t.encode()) + 8 == s and zlib.crc32(t.encode()) == c for t, s, c in zip(both.text, both["size"], both.text_crc32, strict=True))
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    totals = found.groupby("shard")["size"].sum()
    assert totals.max() - totals.min() <= 2 * found["size"].max() and set(found.law) == {"bytes"}


def test_sharding_plan_is_native_and_exchanges_once(spark, small):
    plan = QUERIES["op1_sharding_bytes"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("name", "label"), [("op2_quality_ftrl", "quality"), ("op6_toxicity_nnpu", "toxic")])
def test_held_out_accuracy(spark, name, label):
    found = QUERIES[name](spark, MIDDLE).toPandas()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]).all()
    both = found[found.held_out].merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    assert (both.predicted == both[label]).mean() >= 0.95
    clean = both[both[label] == (1 if label == "quality" else 0)]
    assert (clean.predicted == clean[label]).mean() >= 0.98


def test_bpe_query(spark, small):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.ranks(path), special_tokens={})
    both = QUERIES["op3_bpe_words"](spark, small).toPandas().merge(documents(spark, small), on="doc_id")
    for r in both.itertuples():
        ids = own.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_media_query(spark, small):
    both = QUERIES["op4_media_ogg"](spark, small).toPandas().merge(documents(spark, small), on="doc_id")
    for r in both.itertuples():
        raw = r.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert both.groupby("text").media_sha256.nunique().max() == 1


def test_neighbour_recall(spark):
    e = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    found = QUERIES["op7_additive_ann"](spark, MIDDLE).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = found[found.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 14)) and np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], atol=1e-12)
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
    assert hits >= 0.95 * total


def test_pipeline_against_brute_force(spark, small):
    """Each stage's decision made again by plain means on what the stage before kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import pyarrow as pa

    def passed(module, made, wanted):
        model = module.train(made, labels)
        ids = sorted(r["doc_id"] for r in made.select("doc_id").collect())
        margins = [module.margins(pa.array([texts[i]]), model)[0] for i in ids]
        return [i for i, m in zip(ids, margins, strict=True) if wanted(1 / (1 + np.exp(-m)))]

    kept = passed(quality, docs, lambda s: s >= 0.3)
    first = corpus_pipeline.good_quality(spark, docs, small)
    assert first.columns == columns and sorted(r["doc_id"] for r in first.collect()) == kept and 0 < len(kept) < len(texts)
    first = docs.where(F.col("doc_id").isin(kept))
    kept = passed(toxicity, first, lambda s: s < 0.5)
    second = corpus_pipeline.not_toxic(spark, first, small)
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == kept
    second = docs.where(F.col("doc_id").isin(kept))
    sets = {i: set(s.tolist()) for i, s in zip(kept, minhash.shingles(pa.array([texts[i] for i in kept])), strict=True)}
    root = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if b < a and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    third = corpus_pipeline.no_near_copies(spark, second, small)
    survivors = sorted(i for i in kept if root[i] == i)
    assert third.columns == columns and sorted(r["doc_id"] for r in third.collect()) == survivors
    final = corpus_pipeline.run(spark, small).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in survivors}
    assert final.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert final.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert final.sequence_id.nunique() <= 1.05 * -(-sum(lengths.values()) // packing.CAPACITY) + 1


def test_pipeline_on_an_empty_table(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, docs, small)
        assert made.columns == docs.columns and made.count() == 0


def test_pipeline_edges(spark, small):
    """Null and empty texts, rows without an id, a very long text, repeated rows, and columns named like those that stages add."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    body = " ".join(f"The council of town {i} met on a calm evening and agreed to mend the old bridge." for i in range(30))
    near = body.replace("town 7 ", "village 7 ")
    rows = [(1, body), (2, near), (None, near + " Yes."), (None, body), (3, None), (3, None), (4, ""), (None, "Quite another text about rivers and hills in the north of the land."), (5, body * 40), (6, "Some words of its own stand here and nowhere else."), (6, "Some words of its own stand here and nowhere else.")]
    docs = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], "doc_id long, text string, score double, kept int, number int")
    made = corpus_pipeline.no_near_copies(spark, docs, small)
    assert made.columns == docs.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in made.collect())
    # The long text repeats the words of the first, so it is a near copy.
    assert got == sorted([(1, body), (3, ""), (4, ""), (-1, rows[7][1]), (6, rows[9][1])])
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.not_toxic):
        found = stage(spark, docs, small)
        assert found.columns == docs.columns and {(r["doc_id"], r["text"]) for r in found.collect()} <= set(rows)
    pieces = corpus_pipeline.packed(spark, docs, small).toPandas()
    assert (pieces.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all() and (pieces[pieces.doc_id == 4]["length"] == 1).all()
