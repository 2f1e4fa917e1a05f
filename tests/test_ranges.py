"""Files bound to a manifest by ranges of their bytes."""

from __future__ import annotations

import hashlib
import os

import pytest

from oscilla.sources import ranges


def plant(folder, files):
    for name, data in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


FILES = {"a.bin": os.urandom(1000), "sub/b.bin": b"x" * 300, "sub/empty.bin": b"", "c d%20.bin": os.urandom(100)}


def by_hand(files, size):
    return sorted((n, len(d), s, size, hashlib.sha256(d[s : s + size]).hexdigest()) for n, d in files.items() for s in range(0, len(d), size))


@pytest.mark.parametrize("size", [37, 100, 5000])
def test_digests_by_either_reader(spark, tmp_path, monkeypatch, size):
    plant(tmp_path, FILES)
    assert sorted(map(tuple, ranges.digests(spark, str(tmp_path), size).collect())) == by_hand(FILES, size)
    monkeypatch.setattr(ranges, "OPENED", ())
    assert sorted(map(tuple, ranges.digests(spark, f"file://{tmp_path}", size).collect())) == by_hand(FILES, size)


def test_one_file_and_hidden_ones(spark, tmp_path):
    plant(tmp_path, FILES | {"_SUCCESS": b"", ".a.crc": b"1"})
    assert [tuple(r) for r in ranges.digests(spark, str(tmp_path / "sub/b.bin"), 1000).collect()] == by_hand({"b.bin": FILES["sub/b.bin"]}, 1000)
    assert ranges.digests(spark, str(tmp_path), 1000).count() == 3


def test_no_task_holds_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 1000)
    plant(tmp_path, {"a.bin": os.urandom(40_000)})
    dealt = ranges.digests(spark, str(tmp_path), 1000)
    assert dealt.rdd.getNumPartitions() == 40
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 10


def test_problems_are_named_by_range(spark, tmp_path):
    data, manifest = tmp_path / "data", str(tmp_path / "seal")
    plant(data, FILES)
    sealed = ranges.seal(spark, str(data), manifest, 100)
    assert ranges.problems(spark, str(data), manifest, sealed).count() == 0
    flipped = bytearray(FILES["a.bin"])
    flipped[250] ^= 1
    flipped[999] ^= 128
    plant(data, {"a.bin": bytes(flipped), "sub/b.bin": b"x" * 299, "new.bin": b"1"})
    (data / "c d%20.bin").unlink()
    found = {tuple(r) for r in ranges.problems(spark, str(data), manifest, sealed).collect()}
    assert found == {("a.bin", 200, "content"), ("a.bin", 900, "content"), ("sub/b.bin", None, "length"), ("new.bin", None, "unlisted"), ("c d%20.bin", None, "missing")}


def test_a_changed_manifest_is_refused(spark, tmp_path):
    plant(tmp_path / "data", FILES)
    sealed = ranges.seal(spark, str(tmp_path / "data"), str(tmp_path / "seal"), 100)
    entries = spark.read.parquet(str(tmp_path / "seal"))
    changes = ["start + if(name = 'a.bin' and start = 100, 1, 0) start", "length + 1 length", "if(start = 200, reverse(sha256), sha256) sha256", "size * 2 size", "concat(name, ' ') name"]
    changed = [entries.selectExpr(*(c for c in entries.columns if c != e.split()[-1]), e) for e in changes]
    changed += [entries.where("start <> 200"), entries.where("name <> 'sub/b.bin'"), entries.unionByName(entries.limit(1))]
    for i, rows in enumerate(changed):
        path = str(tmp_path / f"other{i}")
        rows.write.parquet(path)
        with pytest.raises(ValueError, match="another root"):
            ranges.problems(spark, str(tmp_path / "data"), path, sealed)


def test_blocks_and_buckets_fold_alike_in_any_order(spark, tmp_path, monkeypatch):
    plant(tmp_path, FILES)
    rows = ranges.digests(spark, str(tmp_path), 40)
    whole = ranges.root(rows)
    assert whole == ranges.root(rows.orderBy("sha256").repartition(7))
    monkeypatch.setattr(ranges, "FAN", 3)
    assert ranges.root(rows) != whole
    assert ranges.roots(rows).count() == 3
    assert ranges.root(rows.limit(0)) == ranges.root(rows.where("start < 0"))


def test_nothing_is_parsed_before_it_is_held_against_the_seal(spark, tmp_path):
    path, manifest = str(tmp_path / "table"), str(tmp_path / "seal")
    spark.range(100).repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    sealed = ranges.seal(spark, path, manifest, 64)
    assert ranges.parquet(spark, path, manifest, sealed, schema).count() == 100
    file = next((tmp_path / "table").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes()[:-1] + b"?")
    # The last byte belongs to the magic number, so a parser would fail in words of its own.
    with pytest.raises(ValueError, match=f"content of {file.name} from byte"):
        ranges.parquet(spark, path, manifest, sealed, schema)


def test_consumers_lose_results_of_files_that_change(spark, tmp_path):
    data, manifest = tmp_path / "data", str(tmp_path / "seal")
    plant(data, FILES)
    sealed = ranges.seal(spark, str(data), manifest, 100)
    assert ranges.consume(spark, str(data), manifest, sealed, lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).count()) == 3

    def careless(path):
        plant(data, {"a.bin": FILES["a.bin"][:-1] + b"!" if FILES["a.bin"][-1:] != b"!" else FILES["a.bin"][:-1] + b"?"})
        return 1

    with pytest.raises(ValueError, match="content of a.bin from byte 900"):
        ranges.consume(spark, str(data), manifest, sealed, careless)


def test_names_must_be_distinct_and_empty_folders_seal(spark, tmp_path):
    plant(tmp_path / "data", FILES)
    with pytest.raises(ValueError, match="distinct"):
        ranges.digests(spark, str(tmp_path / "data"), 100, r"(\.bin)$")
    (tmp_path / "none").mkdir()
    sealed = ranges.seal(spark, str(tmp_path / "none"), str(tmp_path / "seal"), 100)
    assert ranges.problems(spark, str(tmp_path / "none"), str(tmp_path / "seal"), sealed).count() == 0
    plant(tmp_path / "none", {"x": b"1"})
    assert [tuple(r) for r in ranges.problems(spark, str(tmp_path / "none"), str(tmp_path / "seal"), sealed).collect()] == [("x", None, "unlisted")]
