"""Files of uploads are members of bundles: few large files, nothing lost."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bidlens.sources import documents as D
from bidlens.sources import history_store as store


def _files(path):
    return [name for _, _, names in os.walk(path.removeprefix("file://")) for name in names if name.startswith("part-")]


def test_members_come_back_as_they_were(spark, tmp_path):
    bodies = ["", None, "a\nb\n", "\x1e\x1f\x1b", "\x1b0\x1b1\x1b2", "строка \x00 \r\n", "﻿я\U0001f600", "x" * 20_000, "ы" * 300_000, "\n", "ok"]
    rows = spark.createDataFrame([(f"package={i}/f_{i}.TXT", body) for i, body in enumerate(bodies)], "member string, body string").coalesce(1)
    D.write_bundles(rows, str(tmp_path / "b"))
    assert len(_files(str(tmp_path / "b"))) == 3
    got = {r.name: r for r in D.scan_bundles(spark, str(tmp_path / "b")).collect()}
    assert {n: bytes(r.content).decode() for n, r in got.items()} == {f"f_{i}.TXT": body or "" for i, body in enumerate(bodies)}
    assert all(r.ext == "txt" and r.size == len(r.content) and r.path.endswith(f"/package={n[2:-4]}/{n}") for n, r in got.items())


@pytest.mark.parametrize("most", [7, 100])
def test_bundles_are_bounded(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(D, "BUNDLES", ((10, most), (None, 1)))
    rows = spark.range(0, 50, numPartitions=1).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.repeat(F.lit("x"), (F.col("id") % 12).cast("int")).alias("body"))
    D.write_bundles(rows, str(tmp_path / "b"))
    long = sum(i % 12 > 10 for i in range(50))
    assert len(_files(str(tmp_path / "b"))) == -(-(50 - long) // most) + long
    assert D.scan_bundles(spark, str(tmp_path / "b")).count() == 50


def test_uploads_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda *_: str(tmp_path / "uploads"))
    sf = "/root/testdata/sf0.001"
    found = __spark_entry__.queries()["upload_scan"](spark, sf)
    n_docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found.agg(F.sum("n_files")).first()[0] == n_docs
    assert len(_files(str(tmp_path / "uploads"))) <= n_docs // 20
