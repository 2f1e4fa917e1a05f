"""Every operator on nulls, empty and very long texts, ties, repeated rows, an empty table and clashing extra columns."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from oscilla.llm import additive, bpe, corpus_words, minhash, ogg, packing, pretokens, quality, sharding, tokencount, toxicity, warc

LONG = "long text of words that goes on and on " * 6000
ROWS = [(1, "one two three four five six"), (None, None), (None, "null id"), (2, ""), (2, ""), (3, "one two three four five six"), (-4, "ünï 中文 \x00 tail"), (5, LONG), (5, LONG), (2**62, " \t\n ")]
EXTRA = "doc_id long, text string, Score int, SIZE int, Media string, read int, n_tokens string, component_id string, kept int, shard string, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "m", 3, "t", "c", 0, "s", "l") for r in ROWS], EXTRA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(row):
    return tuple((v is None, v) for v in row)


def test_sharding(docs, none):
    made = sharding.deal(docs, shards=4, part=2)
    assert "text" in made.columns and "Score" in made.columns and "SIZE" not in made.columns
    found = made.toPandas()
    assert len(found) == len(ROWS)
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in made.collect():
        assert r["size"] == len((r["text"] or "").encode()) + 8
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
    assert sharding.deal(none).count() == 0


def test_sharding_splits_a_hot_key(spark):
    df = spark.createDataFrame([(7, "same")] * 300 + [(i, "x" * (i % 9)) for i in range(100)], "doc_id long, text string")
    found = sharding.deal(df, shards=24, part=20).toPandas()
    totals = found.groupby("shard")["size"].sum()
    assert len(totals) == 24 and totals.max() - totals.min() <= 2 * found["size"].max()
    total, order = found["size"].sum(), found.sort_values(["shard", "slot"])
    before = order["size"].cumsum() - order["size"]
    assert (before * 24 // total == order["shard"]).all() and order.doc_id.is_monotonic_increasing


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, docs, none, module):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, None, None), (-4, 1, 0), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    found = module.score(docs, model)
    assert [c for c in found.columns if c.lower() == "score"] == ["score"]
    rows = [(r["doc_id"], r["text"], r["score"]) for r in found.collect()]
    assert len(rows) == len(ROWS) and all(0 <= s <= 1 for *_, s in rows)
    by_text = {}
    for _, text, s in rows:
        assert by_text.setdefault(text or "", s) == s
    assert module.score(none, model).count() == 0
    unlearnt = module.train(none, labels.limit(0))
    assert all(r["score"] in (0.5, 1 / (1 + np.exp(35))) for r in module.score(docs, unlearnt).collect())


def test_media(docs, none):
    stored = ogg.store_media(docs)
    assert "Media" not in stored.columns and stored.columns[-2:] == ["media", "n_bytes"]
    rows = ogg.read_media(stored).collect()
    for r in rows:
        payload = ogg.padded((r["text"] or "").encode())
        found = ogg.decode(bytes(r["media"]))
        assert found.payload == payload and r["read"]["payload_bytes"] == len(payload) and r["n_bytes"] == len((r["text"] or "").encode())
        assert r["read"]["tail_crc32"] == zlib.crc32(payload[-64:]) and found.seconds[-1] == len(payload) / ogg.RATE
    assert ogg.store_media(none).count() == 0


def test_media_damage():
    media = bytearray(ogg.encode(bytes(range(256)) * 300))
    for at in (30, 200, len(media) - 5):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(broken))
    with pytest.raises(ValueError):
        ogg.decode(bytes(media[:-100]))


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.ranks(path), special_tokens={})
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode_documents(docs, path).collect()), key=key)
    assert got == sorted(((a, own.encode_ordinary(b or "")) for a, b in ROWS), key=key)
    back = sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.encode_documents(docs, path).collect()), key=key)
    assert back == sorted(((a, b or "") for a, b in ROWS), key=key)
    assert bpe.encode_documents(none, path).count() == 0


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    voc = tokencount.vocabulary(path)
    low = min(voc.values())
    whole = Tokenizer(models.Unigram([("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *voc.items()], 0, True))
    found = tokencount.count_tokens(docs, path)
    assert found.columns[-1] == "n_tokens" and found.columns.count("n_tokens") == 1
    for r in found.collect():
        text = r["text"] or ""
        assert r["n_tokens"] == (len(whole.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)
    assert tokencount.count_tokens(none, path).count() == 0


def test_token_count_ties():
    count = tokencount.counter({"a": -1.0, "b": -1.0, "ab": -2.0, "abb": -3.0})
    assert count("ab") == (-2.0, 1) and count("abb") == (-3.0, 1) and count("ba") == (-2.0, 2)
    assert tokencount.counter({})("é") == (-10.0, 2)


def test_neighbours(spark):
    v = lambda *x: list(map(float, x))
    rows = [(0, v(1, 0)), (0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, v(0, 0)), (4, None), (5, [1.0, None]), (6, v(float("nan"), 1)), (7, v(float("inf"), 1)), (8, v(1, 2, 3)), (None, v(1, 1)), (100, v(5, 5)), (9, v(4, 5))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    found = additive.search(df).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 100), (100, 1, 9), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert found[4]["score"] == 1.0
    assert additive.search(df.limit(0)).count() == 0


def test_neighbours_of_one_common_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in additive.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        if q % 3 == 0:
            assert [got[q][k] for k in range(1, 11)] == best.tolist()
        hits += len(set(best) & set(got[q].values()))
    assert hits >= 0.9 * 150


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack(docs, path, with_ids=True).toPandas()
    wanted = sorted((a, tuple(tokenizer.encode(b or "", add_special_tokens=False).ids) + (2,)) for a, b in [(-1 if a is None else a, b) for a, b in ROWS])
    got, open_rows = [], {}
    for r in found.assign(doc_id=found.doc_id.fillna(-1)).sort_values(["doc_id", "start"]).itertuples():
        ids = tuple(np.frombuffer(r.ids, "<u4"))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        open_rows.setdefault(int(r.doc_id), []).append(ids)
    for d, parts in open_rows.items():
        copies = sum(1 for a, _ in wanted if a == d)
        whole = sum(len(p) for p in parts)
        assert whole == sum(len(w) for a, w in wanted if a == d) and len(parts) >= copies
        got.append(d)
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.concatenate([[0], np.cumsum(part.length)[:-1]])).all() and part.length.sum() <= 1024
    assert packing.pack(none, path).count() == 0


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(2)

    def optimum(items, room):
        items, best = sorted(items, reverse=True), [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] >= items[i] and bins[j] not in bins[:j]:
                    bins[j] -= items[i]
                    place(i + 1, bins)
                    bins[j] += items[i]
            place(i + 1, [*bins, room - items[i]])

        place(0, [])
        return best[0]

    for _ in range(200):
        room = int(rng.integers(5, 25))
        items = rng.integers(1, room + 1, int(rng.integers(1, 9)))
        counts = np.bincount(items, minlength=room + 1)
        fixed, left = packing.reduce(counts, room)
        rest = np.repeat(np.arange(room + 1), left)
        assert sum(b for b, _ in fixed) + optimum(rest.tolist(), room) == optimum(items.tolist(), room)
        packed = packing.pack_counts(counts, room)
        again = np.zeros(room + 1, int)
        for bins, layout in packed:
            assert sum(x * k for x, k in layout) <= room
            for x, k in layout:
                again[x] += bins * k
        assert (again == counts).all()


def test_warc(spark):
    body = "<html>" + "x" * 200
    rows = [(3, "http://a", body), (1, "http://b", body), (1, "http://b", body), (None, "http://c", body), (4, None, "short"), (5, "u\r\nX: y", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 400_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_bytes string")
    table = warc.write_archives(df)
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(table).collect()), key=key)
    n = len(body)
    assert found == sorted([(1, n, "response", None)] * 2 + [(3, n, "revisit", 1), (None, n, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 800_000, "response", None)], key=key)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    bundle = warc.BundleReader(bytes(table.first()["data"]))
    entry = table.first()["records"][0]
    fields, _ = warc.parse(bundle.read(entry["frame"], entry["offset"], entry["length"]))
    assert fields["warc-record-id"] == f"<{entry['record_id']}>"
    with pytest.raises(ValueError):
        warc.BundleReader(bytes(table.first()["data"])[:-1])


def plain_components(rows):
    sets = []
    for doc_id, text in rows:
        words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
        sets.append((doc_id, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {(d, len(s)): root(d) if s else d for d, s in sets}


@pytest.mark.parametrize(("exact", "block"), [(False, 512), (True, 512), (False, 8), (True, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, exact, block):
    """By signatures and by prefixes; with buckets of one part and of several."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(400)])
    rows, n = [], 0
    for _ in range(25):
        base = rng.choice(words, int(rng.integers(8, 120)))
        for _ in range(int(rng.integers(1, 9))):
            copy = base.copy()
            for _ in range(int(rng.integers(0, 5))):
                copy[rng.integers(0, len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(rng.choice(words, 40))
    rows += [(n + i, shared + " " + " ".join(rng.choice(words, int(rng.integers(5, 40))))) for i in range(40)]
    rows += [(1000, ""), (1001, ""), (1002, None), (1003, "A b"), (1004, "a  B"), (1005, " \t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(df, exact=exact).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_edges(docs, none):
    found = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=key)
    assert found == sorted([(1, True, 1, True), (3, True, 1, False), (None, False, None, True), (None, True, None, True), (2, False, 2, True), (2, False, 2, True), (-4, True, -4, True), (5, True, 5, True), (5, True, 5, True), (2**62, False, 2**62, True)], key=key)
    assert minhash.near_duplicates(none).count() == 0


def test_one_doc_id_with_several_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_pretokens_match_the_pattern():
    import random

    import regex

    rng, pattern = random.Random(6), regex.compile(public_tokenizers.PATTERN)
    letters = "ab 's't're\n\t   é1²!?'’ll ve d m中　́😀\x85​'T'S\x1c\x0b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["'s", "''s", "'re'", "'", " 't", "\n'tis", "it'sx's"]
    raw, offsets = pretokens.buffer_of(pa.array(texts))
    starts, ends, first = pretokens.pretokens(raw, offsets)
    for i, t in enumerate(texts):
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == pattern.findall(t)


def test_additive_many_copies_do_not_fill_the_shortlist(spark):
    """64 dimensions, a third of the rows one vector, and neighbours of each query a little nearer than that one."""
    rng = np.random.default_rng(5)
    common, asked = rng.normal(size=64), rng.normal(size=(30, 64))
    asked = common + asked
    near = (asked[:, None] + 0.9 * rng.normal(size=(30, 15, 64))).reshape(-1, 64)
    x = np.concatenate([near, np.tile(common, (2700, 1)), common + rng.normal(size=(4500, 64))])
    x = x[rng.permutation(len(x))]
    ids = np.array([i for i in range(1, 20000) if i % 100][: len(x)])
    ids, x = np.concatenate([ids, np.arange(30) * 100]), np.concatenate([x, asked])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in additive.search(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i, q in enumerate(asked):
        distance = np.sqrt(((x - q) ** 2).sum(1))
        distance[ids == i * 100] = np.inf
        hits += len(found[i * 100] & set(ids[np.lexsort((ids, distance))[:10]].tolist()))
    assert hits >= 0.98 * 300


def recall(found, ids, x, every=100, k=10):
    hits = total = 0
    for i in np.flatnonzero(ids % every == 0):
        distance = np.sqrt(((x - x[i]) ** 2).sum(1))
        distance[i] = np.inf
        hits, total = hits + len(found[int(ids[i])] & set(ids[np.lexsort((ids, distance))[:k]].tolist())), total + k
    return hits / total


@pytest.mark.parametrize("clusters", [0, 40])
def test_additive_recall_over_lists(spark, clusters):
    """Eight lists; the shortlist is 4 % of each block, or as calibrated. Vectors without any structure, and clustered ones."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4200, 64)) if not clusters else rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 4200)] + 0.3 * rng.normal(size=(4200, 64))
    ids, found = np.arange(4200), {}
    for r in additive.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), list_rows=512).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(found, ids, x) >= 0.9


def test_additive_scores_by_tables_at_every_size(spark, monkeypatch):
    """With a share of nearly nothing only k + 1 codes of a block are reranked, so recall must fall: no size is ranked exactly."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    books = additive.fit(x, codebooks=2, words=16)
    codes = additive.beam_encode(x, books)
    norms = (additive.decoded(codes, books) ** 2).sum(1).astype(np.float32)
    ids = np.arange(400)
    exact = additive.nearest(x[:20], ids[:20], ids, x, 10)
    rough = additive.reranked(x[:20], ids[:20], ids, x, codes.astype(np.uint8), norms, books, 10, 0.0)
    assert sum(len(set(a) & set(b)) for a, b in zip(exact, rough, strict=True)) < 150
    assert all((a == b).all() for a, b in zip(exact, additive.reranked(x[:20], ids[:20], ids, x, codes.astype(np.uint8), norms, books, 10, 1.0), strict=True))
    score = additive.lookups(x[:3], books, codes, norms)
    assert np.allclose(score, norms - 2 * x[:3] @ additive.decoded(codes, books).T, atol=1e-3)


def test_classifiers_pass_over_what_is_beyond_their_bounds(spark):
    docs = spark.createDataFrame([(i, f"good plain text number {i}") for i in range(40)] + [(1, "good plain text number 1")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.training_vectors(docs, labels, 20).count() <= 20
    assert toxicity.training_features(docs, labels, 5, 7).count() <= 12
    assert (quality.train(docs, labels, features=0) == 0).all()
    assert toxicity.train(docs, labels, features=0).bias == -35.0


def test_sharding_against_brute_force(spark):
    """Ids of all magnitudes and signs, repeated and null ones: the order of the key, shares of the bytes before a row."""
    rng = np.random.default_rng(12)
    ids = [None, None, -(2**63), 2**63 - 1, -1, 0] + [int(i) for i in rng.integers(-(2**62), 2**62, 150)] + [int(i) for i in rng.integers(0, 900, 300)] + [77] * 90
    rows = [(i, "y" * int(n)) for i, n in zip(ids, rng.integers(0, 400, len(ids)), strict=True)]
    found = sharding.deal(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shards=7, part=16).collect()
    order = sorted(range(len(rows)), key=lambda k: (-(2**63) if rows[k][0] is None else rows[k][0], k))
    total, before, slots, wanted = sum(len(t) + 8 for _, t in rows), 0, {}, []
    for k in order:
        shard = before * 7 // total
        wanted.append((rows[k][0], len(rows[k][1]) + 8, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += len(rows[k][1]) + 8
    assert [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))] == wanted


def test_equal_hashes_are_told_apart(monkeypatch):
    """All pre-tokens get one of four hashes; ids must be right all the same."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.ranks(path), special_tokens={})
    texts = ["one two three one four", "two five", "six seven two"]
    monkeypatch.setattr(pretokens, "hashes", lambda raw, starts, ends: ((ends - starts) % 4).astype(np.uint64))
    memory = pretokens.Memory(pretokens.rank_encoder(path))
    block = corpus_words._Block()
    for t in texts:
        ids, cut = pretokens.encode_texts(pa.array([t]), memory)
        assert ids.tolist() == own.encode_ordinary(t)
        block.add(pa.array([1], pa.int64()), pa.array([t], pa.large_string()), bpe.split)
    assert b"".join(block.words[i] for i in np.concatenate(block.numbers)).decode() == "".join(texts)


def test_index_of_many_keys():
    rng, index, known = np.random.default_rng(3), pretokens.Index(), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 5000, 200).astype(np.uint64))
        found = index.find(keys)
        assert found.tolist() == [known.get(int(k), -1) for k in keys]
        new = keys[found < 0]
        places = len(known) + np.arange(len(new))
        index.add(new, places)
        known |= dict(zip(new.tolist(), places.tolist(), strict=True))


def test_token_count_of_one_long_stretch_and_refused_pieces():
    count = tokencount.counter({"a": -1.0, "aa": -1.5, "b": -1.0})
    assert count("a" * 200_001 + "b") == (-1.5 * 100_000 - 2.0, 100_002) and count("") == (0.0, 0)
    with pytest.raises(ValueError):
        tokencount.cuttable({"a▁b": -1.0})
    assert tokencount.cuttable({"▁▁": -1.0, "▁a": -1.0})


def test_pieces_of_many_parts_of_one_length(spark, monkeypatch):
    """More parts of a length than are added up together."""
    monkeypatch.setattr(packing, "PART", 4), monkeypatch.setattr(packing, "GROUP", 3)
    df = spark.createDataFrame([(i, "word") for i in range(300)], "doc_id long, text string")
    found = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=2 * packing.pack(df.limit(1), public_tokenizers.path("byte_bpe_50k.json")).first()["length"]).toPandas()
    assert len(found) == 300 and found.sequence_id.nunique() == 150 and (found.groupby("sequence_id").offset.agg(["min", "max"]).to_numpy() == [0, found.length.iloc[0]]).all()


def test_further_links_join_components(spark):
    labels = minhash.components(spark.createDataFrame([(5, 6), (6, 7), (1, 2), (20, 21)], "a long, b long"))
    further = spark.createDataFrame([(7, 9), (9, 2), (30, 31)], "a long, b long")
    assert {r["node"]: r["component"] for r in minhash.joined(labels, further).collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 9: 1, 20: 20, 21: 20, 30: 30, 31: 30}


def test_ftrl_against_plain_updates():
    """The same examples by the published formulas, one coordinate at a time."""
    import math

    rng, model = np.random.default_rng(14), quality.Ftrl(dim=6)
    z, n = [0.0] * 7, [0.0] * 7

    def weight(i):
        return 0.0 if abs(z[i]) <= model.l1 else -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(200):
        index = np.sort(rng.permutation(6)[: int(rng.integers(0, 5))])
        value, label = rng.random(len(index)), int(rng.integers(0, 2))
        model.learn(index, value, label)
        row = [*zip(index.tolist(), value.tolist(), strict=True), (6, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * x for i, x in row)))
        old = {i: weight(i) for i, _ in row}
        for i, x in row:
            g = (p - label) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * old[i]
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(7)], atol=1e-5) and np.abs(model.weights()).max() > 0.05


def test_unlabelled_toxic_texts_are_not_taken_as_clean():
    """A toxic word stands in all confirmed texts and in the prior's share of unlabelled ones: it is learnt, ordinary words are not."""
    rng = np.random.default_rng(15)
    texts = lambda n, bad: [" ".join([*rng.choice([f"plain{i}" for i in range(60)], 20), *(["venomword"] if k < bad else [])]) for k in range(n)]
    toxic, free = toxicity.present(pa.array(texts(80, 80))), toxicity.present(pa.array(texts(1000, 50)))
    model = toxicity.fit(toxic, free, 0.05)
    score = lambda t: 1 / (1 + np.exp(-toxicity.margins(pa.array([t]), model)[0]))
    assert score("plain1 plain2 venomword plain3") > 0.5 and score("plain1 plain2 plain3") < 0.1 and score("") < 0.1


@pytest.mark.parametrize("kind", ["queries elsewhere", "huge", "tiny", "far from zero"])
def test_additive_finds_all_whatever_the_vectors(spark, kind):
    """Queries unlike the other rows, and vectors that single precision can't hold or tell apart."""
    rng = np.random.default_rng(12)
    x, ids, found = rng.normal(size=(1500, 64)), np.arange(1500), {}
    if kind == "queries elsewhere":
        x[ids % 100 > 0] = rng.normal(size=(20, 64))[rng.integers(0, 20, 1485)] + 0.05 * rng.normal(size=(1485, 64))
    x = {"huge": 1e20, "tiny": 1e-25}.get(kind, 1) * x + (1e6 if kind == "far from zero" else 0)
    for r in additive.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), list_rows=128).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(found, ids, x) == 1


def test_near_duplicates_move_only_what_shares_a_bucket(spark, monkeypatch):
    """Of 300 documents three are alike: only these have members of shared buckets, signatures and texts written down again."""
    rng, written = np.random.default_rng(13), {}
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 10**6, 60))) for i in range(300)]
    rows += [(500, rows[7][1] + " more"), (501, rows[7][1] + " and more")]
    kept = minhash.shared_table

    def noted(spark, df, name):
        found = kept(spark, df, name)
        written[name] = found.count()
        return found

    monkeypatch.setattr(minhash, "shared_table", noted)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(300)} | {500: 7, 501: 7}
    assert written["met"] <= 3 * minhash.BANDS and written["ends"] == written["texts"] == 3


def test_filter_of_nodes_leaves_none_out(spark):
    nodes = spark.range(-500, 500).select(F.col("id").alias("node"))
    every = spark.range(-5000, 5000).select(F.col("id").alias("node"))
    passed = {r["node"] for r in every.where(minhash._among(nodes, 1 << 20)).collect()}
    assert set(range(-500, 500)) <= passed and len(passed) < 1100
    assert every.where(minhash._among(nodes, 64)).count() == 10000 and every.where(minhash._among(nodes.limit(0), 64)).count() == 0
