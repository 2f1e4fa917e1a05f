"""Packing of texts with added tokens, words encoded once, conversation repair and Merkle manifests, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oscilla.llm import bpe, corpus_words, merkle, packing, pieces, pretokens, repair
from oscilla.llm.queries import QUERIES

from .test_edges import LONG, ROWS, key

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
END = "<|endoftext|>"
ADDED = [END, END * 2, f"a{END}", f"{END}b", f"in{END}side", f"hello {END} world", f"x {END}{END} y{END}", "<|endoftext|", f"<|end{END}oftext|>", "'" + END + "s", "", "plain"]


def test_packing_matches_added_tokens_as_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    found = packing.pack(docs, JSON, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(JSON)
    for i, text in enumerate(ADDED):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        row = found[found.doc_id == i]
        assert np.frombuffer(row.ids.iloc[0], "<u4").tolist() == ids and row["length"].tolist() == [len(ids)]
        assert row.ids_crc32.tolist() == [zlib.crc32(np.array(ids, "<u4").tobytes())]


def test_added_tokens_that_need_more_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"added_tokens": [{"id": 1, "content": "<x>", "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}], "normalizer": null}')
    with pytest.raises(ValueError):
        pretokens.added_tokens(str(path))


def test_packing_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = QUERIES["op8_bestfit_packing"](spark, small).toPandas()
    tokenizer = Tokenizer.from_file(JSON)
    for doc_id, part in found.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 2], "<u4")
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(len(part))) and part.start.tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() == len(ids)
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part["length"], strict=True)]
        assert (part["length"].iloc[1:] == 1024).all() and (len(ids) > 1024 or len(part) == 1)
    assert set(found.doc_id) == set(docs)
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 1024
    assert found.sequence_id.nunique() <= 1.01 * -(-found["length"].sum() // 1024) + 1


def test_piece_query(spark, small):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_words"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = own.encode(docs[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids).encode()).hexdigest()


def test_pieces(spark, monkeypatch):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    more = ["a▁b  c ", " ", "   ", " ▁ ", "▁", "▁▁x", "</s> <unk> <0x41> \x00\n\t é😀中文", "a ", "x" * 30000, "tab\there  and　there"]
    rows = [*ROWS, *((100 + i, t) for i, t in enumerate(more))]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, block int, NUMBER int").repartition(3)
    monkeypatch.setattr(corpus_words, "BLOCK_BYTES", 100)
    wanted = []
    for i, t in rows:
        ids = own.encode(t or "", add_eos=True)
        wanted.append((i, ids, own.decode(ids)))
    found = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in pieces.encode_documents(docs, PIECES).collect()]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert pieces.encode_documents(docs.limit(0), PIECES).count() == 0


def test_words_are_encoded_once_and_unknown_ids_are_errors(spark):
    docs = spark.createDataFrame([(i, f"the same words {i % 3}") for i in range(50)], "doc_id long, text string").repartition(5)
    kept = corpus_words.blocks(docs, bpe.split, 4).cache()
    assert kept.where("bucket is null").count() == 5 and kept.where("bucket is not null").count() <= 20
    asked = []

    def encoder():
        def encode(word):
            asked.append(word)
            return [len(word)]

        return encode

    run = corpus_words.encoded(kept, encoder).collect()
    assert sum(len(corpus_words._unpack(bytes(r["ids"]), 2)[1]) for r in run) == 30 and {r["bucket"] for r in run} <= {0, 1, 2, 3}
    words = [w for r in kept.where("bucket is not null").collect() for w in corpus_words._unpack_words(bytes(r["packed"]))]
    assert len(words) == 30 and set(words) == {b"the", b" same", b" words", b" 0", b" 1", b" 2"}
    # A word is in one bucket only, whatever its block.
    assert all(len({r["bucket"] for r in kept.where("bucket is not null").collect() if w in corpus_words._unpack_words(bytes(r["packed"]))}) == 1 for w in set(words))
    tokens = corpus_words.Tokens({0: b"a", 2: b"\xff\x01"})
    data, sizes = tokens.decoded(np.array([2, 0, 0, 2]), np.array([2, 0, 2]))
    assert data.tobytes() == b"\xff\x01aa\xff\x01" and sizes.tolist() == [3, 0, 3]
    for wrong in (1, 3, 99):
        with pytest.raises(ValueError):
            tokens.decoded(np.array([wrong]), np.array([1]))


def test_texts_are_cut_once_and_read_from_one_exchange(spark, small):
    plan = QUERIES["op12_piece_words"](spark, small)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[0].count("ReusedExchange") == 1


def cheapest(signs: bytes) -> tuple[int, str]:
    """Least cost, and of its edits the ASCII-least, from all edits of every row and up to two insertions before each; whole strings are kept for each state."""
    paths = {0: [(0, "")]}
    for sign in signs:
        fault, initial = divmod(sign, 4)
        grown = {}
        for q, options in paths.items():
            for cost, text in options:
                for n in range(3):
                    p = q
                    for _ in range(n):
                        p = {0: 2, 1: 2, 2: 3, 3: 2}[p]
                    c, t = cost + 5 * n, text + "I" * n
                    grown.setdefault(p, set()).add((c + 2, t + "D"))
                    if fault in (0, 3):
                        more = 5 if fault == 3 else 0
                        nxt = {0: 2, 1: 2, 2: 3, 3: 2}[p]
                        grown.setdefault(nxt, set()).add((c + 1 + more, t + "R"))
                        if p == 0 and initial == 0:
                            grown.setdefault(1, set()).add((c + more, t + "K"))
                        if initial == {0: 1, 1: 1, 2: 2, 3: 1}[p]:
                            grown.setdefault(nxt, set()).add((c + more, t + "K"))
        paths = {q: [o for o in options if o[0] == min(c for c, _ in options)] for q, options in grown.items()}
    ends = []
    for q, options in paths.items():
        tail = {0: "", 1: "II", 2: "I", 3: ""}[q]
        ends += [(c + 5 * len(tail), t + tail) for c, t in options]
    return min(ends)


def test_automaton_against_all_edits():
    rng = random.Random(5)
    own = repair.Automaton()
    cases = [bytes(c) for n in range(4) for c in itertools.product((0, 1, 2, 3, 4, 13, 14), repeat=n)]
    cases += [bytes(rng.choice((0, 1, 1, 2, 2, 3, 5, 9, 12, 13, 14)) for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    for signs in cases:
        cost, path = own.scan(signs)
        edits = own.trace(signs, path)
        assert (cost, "".join(edits)) == cheapest(signs)
    assert len(own.vectors) < 500


def plain_repair(rows: list[tuple]) -> dict:
    """One conversation's result, from its rows in order."""
    seen, signs, pairs = set(), [], [r[1][:1] for r in rows]
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
        seen.add((role, text))
        signs.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * fault)
    cost, audit = cheapest(bytes(signs))
    at, state, lines = 0, "", []
    for letter in audit:
        if letter == "I":
            state += "u" if state[-1:] in ("", "s", "a") else "a"
            lines.append({"u": "user:", "a": "assistant:"}[state[-1]])
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            state += role[0]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state += "u" if state[-1:] in ("", "s", "a") else "a"
            lines.append(f"{ {'u': 'user', 'a': 'assistant'}[state[-1]]}:{text}")
    turns = {t for t, *_ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": sum(s // 4 == 1 for s in signs), "duplicate": sum(s // 4 == 2 for s in signs), "truncated": sum(s // 4 == 3 for s in signs),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(pairs[:-1], pairs[1:], strict=True)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_repair_against_plain_version(spark, monkeypatch, chunk):
    """Conversations inside one task, at its edges and over many chunks give the same."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["One.", "Two!", "cut", "", " \n", None, "Long " * 40 + "tail a.", "Long " * 40 + "tail b."]
    rows = []
    for conv in [*range(30), None]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)))
    rows += [(77, t, "user" if t % 2 else "assistant", f"Turn {t % 50}{'.' if t % 7 else ''}") for t in range(400)] + [(78, 3, "user", "Same.")] * 60
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, Audit string, copies int").repartition(4)
    found = {r["conv_id"]: r.asDict() for r in repair.repair(df).collect()}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert len(found) == len(convs)
    for conv, own in convs.items():
        if len(own) > 100:
            continue  # the plain version keeps all strings
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        assert {k: v for k, v in found[conv].items() if k != "conv_id"} == plain_repair(own), conv
    assert repair.repair(df.limit(0)).count() == 0
    long = found[77]
    assert (long["duplicate"], long["gaps"], long["illegal"]) == (300, 0, 0) and len(long["audit"].replace("I", "")) == 400


def test_repair_of_what_is_not_there(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (2, None, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    for r in repair.repair(df, copies=F.lit(0)).collect():
        assert r["audit"] == "" and r["repaired_sha256"] == empty and sum(r[c] for c in repair.FACTS) == 0


def plain_tree(leaves: list[str], fanout: int) -> tuple[str, list[str]]:
    """The root, and for each leaf the joined siblings from the leaf up."""
    level, paths, at = leaves, [""] * len(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k in range(len(leaves)):
            run = range(at[k] // fanout * fanout, min(len(level), at[k] // fanout * fanout + fanout))
            paths[k] += "".join(level[j] for j in run if j != at[k])
        level = [hashlib.sha256("".join(level[j : j + fanout]).encode()).hexdigest() for j in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], paths


@pytest.mark.parametrize(("fanout", "size"), [(2, 3), (2, 1 << 14), (3, 4), (5, 7)])
def test_manifest_against_plain_trees(spark, monkeypatch, fanout, size):
    monkeypatch.setattr(merkle, "RUN", size)
    rng = random.Random(size)
    rows = [(i, f"text {i}" * (i % 4), rng.choice(["b", "ä", "", "Z", None]) if i % 3 else "hot") for i in range(300)] + [(None, None, "b"), (7, "again", "lone")] + [(5, "same", "hot")] * 9
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "doc_id long, text string, lang string, leaf string, n int").repartition(7)
    values = [F.col("doc_id"), F.col("text"), F.col("lang")]
    offered = F.when(F.col("doc_id") % 10 == 0, F.lit("0" * 64))
    trees = merkle.forest(df, F.col("lang"), [F.col("doc_id")], merkle.leaf_digest(*values), {"doc_id": F.col("doc_id"), "offered_": offered}, fanout, size)
    assert trees.runs.count() > 5
    monkeypatch.setattr(merkle.forest, "__defaults__", (None, 2, size))
    found = merkle.manifest(df, F.col("lang"), [F.col("doc_id")], values, offered, {"doc_id": F.col("doc_id")}, fanout).collect()

    def leaf(row):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    wanted, subroots = [], {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots[g] = (*plain_tree([leaf(r) for r in own], fanout), own)
    root, tops = plain_tree([subroots[g][0] for g in names], fanout)
    for g, top in zip(names, tops, strict=True):
        subroot, paths, own = subroots[g]
        wanted += [(r[0], leaf(r), subroot, root, hashlib.sha256((p + top).encode()).hexdigest(), r[0] is None or r[0] % 10 != 0) for r, p in zip(own, paths, strict=True)]
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in found]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert all((r["folded_root"] == root) == r["verified"] for r in found)
    assert merkle.manifest(df.limit(0), F.col("lang"), [F.col("doc_id")], values, offered, {"doc_id": F.col("doc_id")}, fanout).count() == 0


def test_leaf_of_long_and_null_values(spark):
    row = spark.createDataFrame([(1, LONG, None)], "a long, b string, c string").select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert row["h"] == hashlib.sha256(f"1:1{len(LONG)}:{LONG}-".encode()).hexdigest()
