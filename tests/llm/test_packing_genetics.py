"""The genetic algorithm of the packing: it runs on the given documents, and changes results."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import packing
from weftline.session import settled
from weftline.sources.tables import table


def whole(p, sizes, capacity):
    bins, fill = p
    assert sorted(i for own in bins for i in own) == list(range(len(sizes)))
    assert fill == [sum(sizes[i] for i in own) for own in bins] and max(fill) <= capacity


def test_crossover_keeps_all_pieces():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 500).tolist()
    more = packing.first_people(sizes, 1000, rng)
    a, b, told = next(more), next(more), Counter()
    child = packing.cross(a, b, sizes, 1000, rng, told)
    whole(child, sizes, 1000)
    assert told["crossovers"] == 1 and told["injected"] > 0 and told["displaced"] > 0


@pytest.mark.parametrize("seed", range(3))
def test_beats_best_fit(seed):
    """Triples that fill bins exactly: best fit alone needs more bins than evolution does."""
    rng = np.random.default_rng(seed)
    sizes = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        sizes += [a, b, 1000 - a - b]
    best_fit = next(packing.first_people(sizes, 1000, rng))
    told = Counter()
    found = packing.evolve(sizes, [], 1000, seed, told)
    whole(found, sizes, 1000)
    assert 60 <= len(found[1]) and packing.fitness(found) > packing.fitness(best_fit) and told["better"] > 0


def test_islands_of_documents(spark, data, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 500)
    items = settled(packing.pieces(table(spark, data, "documents")).where("length < 2048").select(F.monotonically_increasing_id().alias("id"), "length"))
    n = items.count()
    out = packing.evolved(items, n, packing.CAPACITY, 0).groupBy("shard", "island").agg(F.count("id").alias("n"), F.max("crossovers").alias("crossovers"), F.max("better").alias("better"), F.max("used").alias("used"), F.sum("length").alias("sum")).collect()
    assert len({r.island for r in out}) == packing.ISLANDS and sum(r.n for r in out) == packing.ISLANDS * n
    assert all(r.crossovers >= 2 for r in out) and any(r.better for r in out)
    assert all(r.used <= 1.01 * -(-r.sum // packing.CAPACITY) + 1 for r in out)


def test_migration():
    """An elite that comes to an island takes part: of two packings the island starts from, the better one is where it begins."""
    sizes = [600, 400] * 30
    perfect = packing.packing_of(sizes, [i // 2 for i in range(60)])
    poor = packing.packing_of(sizes, list(range(60)))
    assert packing.fitness(packing.evolve(sizes, [poor, perfect], 1000, 0)) == packing.fitness(perfect)


def test_near_the_bound(spark, data):
    """Sequences over all shards, against the least that any packing needs."""
    out = packing.pack_documents(table(spark, data, "documents"))
    r = out.agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("sum")).first()
    assert r.n <= 1.002 * -(-r["sum"] // packing.CAPACITY) + 1


def test_another_tokenizer():
    """One that splits otherwise gets whole texts."""
    memory = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Some words, it's 12 o'clock", "", "  two  spaces\n"]
    ids, sizes = memory.encode(texts)
    assert not memory.known
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [memory.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.Tokens(packing.tokenizer_path()).known
