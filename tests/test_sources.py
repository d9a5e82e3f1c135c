"""Collections that queries write for a reader to read back."""

import os

import pytest

from cardloom.plans import sources

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


def test_uploads_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file a record, in one folder an owner; the few bytes aren't coalesced to one task."""
    monkeypatch.setattr(sources, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    found = sources.QUERIES["src_8_ingest_uploads"](spark, DATA)
    files = [p for p in (tmp_path / "uploads").rglob("part-*") if p.is_file()]
    assert len(files) == found.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert all(p.parent.parent == tmp_path / "uploads" for p in files)
    assert len({p.name.split("-")[1] for p in files}) > 1
