"""Cases that the given tables don't have."""

from types import SimpleNamespace

from weftline.operators import duplicates
from weftline.plans import records


def test_ids_once(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    got = records.id_except(SimpleNamespace(documents=ids(1, 1, 2, 3, None), labels=ids(3)))
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 2, None]


def test_targets_without_hashes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "x")], "id long, digest string")
    assert {r.id: r.target_id for r in duplicates.asset_targets(rows, "digest", "id", "id").collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
