"""Ids that are used for several texts lose no text that has no other copy."""

import pytest

from weftline.llm import near_copies, simhash


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_shared_ids(spark, module):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    kept = lambda *docs: sorted(map(tuple, module.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert kept((5, a), (3, b), (5, b)) == [(3, b), (5, a)]
    assert kept((5, a), (5, b), (7, b), (5, b), (9, c)) == [(5, a), (5, b), (9, c)]
