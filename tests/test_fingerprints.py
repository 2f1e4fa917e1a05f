"""Digests of files of any size, from tasks and through Spark's readers."""

from __future__ import annotations

import hashlib

import pytest

from oscilla.sources import files


def digest(path):
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@pytest.mark.parametrize("schemes", [files.OPENED, ()], ids=["tasks", "readers"])
def test_files_beyond_one_value(spark, tmp_path, monkeypatch, schemes):
    """A file of more than 2 GB, which no value holds, with one of a name with blanks, one in a folder and an empty one beside it, which Spark's readers leave out."""
    monkeypatch.setattr(files, "OPENED", schemes)
    with (tmp_path / "large").open("wb") as f:
        f.write(b"begin")
        f.seek((1 << 31) + 100)
        f.write(b"end")
    (tmp_path / "empty").touch()
    (tmp_path / "a b%20c").write_bytes(b"\r\n\x00\xff")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.gz").write_bytes(b"\xef\xbb\xbf")
    found = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in files.fingerprints(spark, f"file://{tmp_path}").collect()}
    wanted = {p.name: (p.stat().st_size, digest(p)) for p in tmp_path.rglob("*") if p.is_file() and p.stat().st_size}
    assert len(wanted) == 3 and sorted(found.values()) == sorted(wanted.values())
