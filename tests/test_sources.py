"""File trees, nested records, id lists and writers on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators.duplicates import duplicate_groups
from weftline.sources.files import manifest, scan_files
from weftline.sources.records import read_id_list, read_plans, write_records


def test_manifest(spark, tmp_path):
    root = tmp_path / "in"
    for name, data in {"p10.txt": b"same", "p2.txt": b"same", "a/b/c.md": b"deep", "a/Thumbs.db": b"x", "skip/no.txt": b"no", "big.txt": b"x" * 200, "draft pic.png": bytes.fromhex("89504E470D0A1A0A0000000D4948445200000002000000030000"), "odd.xyz": b"?"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = {r.relative_path: r for r in manifest(scan_files(spark, [str(root)], [str(root / "skip")], max_bytes=100), 100).collect()}
    assert set(rows) == {"p10.txt", "p2.txt", "a/b/c.md", "big.txt", "draft pic.png", "odd.xyz"}
    assert rows["p10.txt"].exact_duplicate and not rows["p2.txt"].exact_duplicate
    assert rows["p2.txt"].id.startswith("m-") and len(rows["p2.txt"].id) == 27
    big = rows["big.txt"]
    assert (big.sha256, big.category, big.id[:2], big.warnings) == (None, "unsupported", "u-", ["file is too large"])
    pic = rows["draft pic.png"]
    assert (pic.mime, pic.category, tuple(pic.dimensions), pic.warnings) == ("image/png", "image", (2, 3), ["possible version variant"])
    assert rows["odd.xyz"].category == "unsupported" and rows["a/b/c.md"].mime == "text/markdown"
    shallow = scan_files(spark, [str(root)], max_depth=0)
    assert shallow.where("depth > 0").count() == 0 and shallow.count() == 5
    groups = duplicate_groups(manifest(scan_files(spark, [str(root)])).withColumn("n", F.col("relative_path")), "sha256", "n", "id").collect()
    assert [g.members for g in groups] == [2]


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "x.txt").write_bytes(b"x")
    (tmp_path / "large.txt").write_bytes(b"xy")
    (tmp_path / "large.txt").chmod(0)
    rows = {r.name: r.content for r in scan_files(spark, [str(tmp_path)], max_bytes=1).collect()}
    assert rows == {"x.txt": bytearray(b"x"), "large.txt": None}


def test_plans(spark, tmp_path):
    good = {"schemaVersion": 1, "platform": "douyin", "titleLineCount": 2, "variants": []}
    (tmp_path / "good.json").write_text("﻿" + json.dumps(good, indent=1))
    (tmp_path / "typed.json").write_text(json.dumps(good | {"titleLineCount": True}))
    (tmp_path / "list.json").write_text("not json")
    rows = {r.plan_id.rsplit("/", 1)[1]: r for r in read_plans(spark, str(tmp_path), "cover").collect()}
    assert rows["good.json"].platform == "douyin" and rows["good.json"].corrupt is None
    assert rows["typed.json"].titleLineCount is None and rows["typed.json"].corrupt
    assert rows["list.json"].corrupt and rows["list.json"].platform is None


def test_id_list_and_writer(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("﻿a \n\n b\na\n　\n")
    ids = read_id_list(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.id for r in ids.collect()) == ["a", "b"]
    for fmt in ("json", "parquet"):
        write_records(ids, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 2
    with pytest.raises(Exception, match="already exists"):
        write_records(ids, str(tmp_path / "json"))


def test_uris_and_order(spark, tmp_path):
    for name in ("z.txt", "sub/b.txt", "sub/deep/c.txt", "gone/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"same")
    uri = f"file://{tmp_path}/"
    files = manifest(scan_files(spark, [uri], [f"file://{tmp_path}/gone/"]))
    marks = {r.relative_path: r.exact_duplicate for r in files.collect()}
    # a folder's files are found before its folders, so z.txt is the first
    assert marks == {"z.txt": False, "sub/b.txt": True, "sub/deep/c.txt": True}
    assert [r.relative_path for r in scan_files(spark, [f"{tmp_path}/z.txt"]).collect()] == ["z.txt"]
    large = manifest(scan_files(spark, [uri], max_bytes=1), 1).where("relative_path = 'z.txt'").first()
    assert large.id.startswith("u-") and len(large.id) == 26
    with pytest.raises(ValueError, match="absolute"):
        scan_files(spark, ["some/folder"])
