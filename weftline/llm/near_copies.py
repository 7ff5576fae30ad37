"""Near copies: SimHash near-duplicates held to an exact similarity of word shingles.

Two texts are near copies if the sets of their shingles of five words have a Jaccard similarity of 0.8 or more. The nearest are
found by operator 6: SimHash fingerprints of those shingles, linked within four bits by pigeonring filtering. Texts at 0.8 to 0.9
differ in 5 to 13 bits, too many for any filter by segments, so min-hashes find the rest: 40 bands of five; a pair at 0.8 shares
no band with a probability of 1.2e-7, and less above. Every candidate's similarity is then worked out from both whole sets, so no
link is a guess.

Work is on different sets. Links are looked for in rounds, so that a crowd of near copies costs what it has members, not pairs:
the fingerprints' links together with each set against the smallest set that it shares a band with, then what is still apart
against the smallest of each of its bands. Bands that still hold several components are settled by the rare shingles that similar
sets must share, against the most central set of each and then among all that are still apart. After each round what was linked is contracted to components, and only edges between components go on.

Every table that is read twice is written once, as Parquet, and deleted when the round is over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import claim, give_back, representatives, text_hash, with_least
from weftline.llm.simhash import GROUP_ROWS, LEAST_GROUPS, fingerprint, links, shingle_hashes, union
from weftline.session import Kept

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, BAND = 40, 5
#: Shingles that are min-hashed at once, and edges of one set that meet in one task.
BLOCK, EDGES = 512, 200
#: Rows of a batch that are worked on at once.
ROWS = 500
#: Bits, a multiple of 64, that tell of a set's shingles by parity.
PARITY = 512
#: Rows of a table that is broadcast, and edges whose components one task may find.
FEW, FEW_EDGES = 200_000, 100_000

_RNG = np.random.default_rng(SEED)
_TURNS = _RNG.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = _RNG.integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, words, SEED))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band; the number tells bands apart, too."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), BLOCK):
        np.minimum(least, (found[i : i + BLOCK, None] * _TURNS).min(axis=0), out=least)
    x = (least.reshape(BANDS, BAND) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185) + np.arange(BANDS, dtype=np.uint64)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Bits by which sets are told apart: whether an odd number of the shingles hash to each."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what is made of them isn't held for a whole batch."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, th, fp, sid, bands)`` of each row: the hash of its text, its fingerprint, the id of its set of shingles, and the set's
    bands."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies", lambda: None)
        for b in sliced(batches):
            fps, sids, every = np.empty(b.num_rows, np.uint64), [], []
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                hashes = shingle_hashes(t, WORDS, SEED)
                fps[i], own = fingerprint(hashes), np.unique(hashes)
                sids.append(set_id(own))
                every.append(bands(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(sids, pa.int64()), pa.array(every, pa.list_(pa.int64()))], names=["key", "th", "fp", "sid", "bands"])
        give_back()

    return docs.select(f"`{key}`", text_hash(text), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"key {kind}, th bigint, fp bigint, sid bigint, bands array<bigint>")


def by_band(rows: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], sets: int, schema: str) -> DataFrame:
    """``found`` of each part of the rows ``(bands, sid, root)``, spread over their bands; it gets band, sid and root, sorted by band and
    sid, every band whole."""
    groups = max(LEAST_GROUPS, -(-BANDS * sets // GROUP_ROWS))
    spread = rows.select("sid", "root", F.explode("bands").alias("band")).withColumn("part", F.pmod(F.xxhash64("band"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        band, sid, root = (table.column(c).to_numpy() for c in ("band", "sid", "root"))
        order = np.lexsort((sid, band))
        return pa.table(found(band[order], sid[order], root[order]))

    return spread.groupBy("part").applyInArrow(run, schema)


def starts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted keys begins, and how many rows it has."""
    heads = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return heads, np.diff(np.r_[heads, len(keys)])


def heads_in_bands(band: np.ndarray, sid: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
    """Different pairs of a set and the smallest set that it shares a band with, where that is another."""
    heads, size = starts_of(band)
    pairs = np.unique(np.stack([sid, np.repeat(sid[heads], size)], axis=1), axis=0) if len(sid) else np.empty((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return {"u": pairs[:, 0], "v": pairs[:, 1]}


def mixed_in_bands(band: np.ndarray, sid: np.ndarray, root: np.ndarray) -> dict[str, np.ndarray]:
    """Sets in bands that hold several components."""
    heads, size = starts_of(band)
    several = np.zeros(0, bool) if not len(heads) else np.minimum.reduceat(root, heads) != np.maximum.reduceat(root, heads)
    own = np.unique(np.stack([sid, root], axis=1)[np.repeat(several, size)], axis=0)
    return {"sid": own[:, 0], "root": own[:, 1]}


def sets_of(docs: DataFrame, distinct: DataFrame, wanted: DataFrame, text: str, kept: Kept) -> DataFrame:
    """``(sid, shingles, bits)`` of the wanted sets, from one text of each."""
    one = small(kept.write(distinct.join(small(wanted, kept), "sid", "left_semi").select("th")), kept)
    body = docs.select(text_hash(text), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).join(one, "th", "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            ids, own, bits = pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, own, bits], names=["sid", "shingles", "bits"])
        give_back()

    return body.mapInArrow(run, "sid bigint, shingles array<bigint>, bits array<bigint>").dropDuplicates(["sid"])


def small(df: DataFrame, kept: Kept) -> DataFrame:
    """A written table, with a broadcast hint if it has few rows."""
    return F.broadcast(df) if kept.rows(df) <= FEW else df


def with_sets(edges: DataFrame, side: str, sets: DataFrame, kept: Kept) -> DataFrame:
    """``edges`` with the shingles of ``side``; a set of many edges is handed to many tasks."""
    ends = small(kept.write(edges.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / EDGES).cast("int").alias("copies"))), kept)
    copies = sets.select(F.col("sid").alias(side), "shingles").join(ends, side).select(side, F.col("shingles").alias(f"{side}_set"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = edges.join(ends, side).withColumn("copy", F.pmod(F.xxhash64("u", "v"), F.col("copies")).cast("int")).drop("copies")
    return dealt.join(copies, [side, "copy"]).drop("copy")


def confirmed(edges: DataFrame, sets: DataFrame, kept: Kept, least: float = SIMILARITY) -> DataFrame:
    """The edges ``(u, v)`` (each once, written) whose sets are similar enough."""
    if not kept.rows(edges):
        return edges
    both = with_sets(with_sets(edges, "u", sets, kept), "v", sets, kept).withColumn("both", F.size(F.array_intersect("u_set", "v_set")))
    return kept.write(both.where(F.col("both") / (F.size("u_set") + F.size("v_set") - F.col("both")) >= least).select("u", "v"))


def alike(marked: DataFrame, kept: Kept) -> DataFrame:
    """Candidates ``(u, v)`` among sets: those of one fingerprint, and a spanning forest of the fingerprints' links."""
    sets = kept.write(marked.select("fp", "sid").distinct())
    heads = kept.write(sets.groupBy("fp").agg(F.min("sid").alias("head")))
    same = sets.join(heads, "fp").where("sid <> head").select(F.col("sid").alias("u"), F.col("head").alias("v"))
    head = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head"))
    near = links(heads.select("fp")).join(head("u"), "u").join(head("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return same.unionByName(near)


def ordered(edges: DataFrame) -> DataFrame:
    """Different edges ``(u, v)`` with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def renamed(df: DataFrame, side: str, star: DataFrame | None, kept: Kept) -> DataFrame:
    """``df`` with ``side`` replaced by its root where the written ``star`` ``(u, root)`` has one."""
    if star is None:
        return df
    at = star.select(F.col("u").alias(side), F.col("root").alias("__root"))
    return df.join(F.broadcast(at) if kept.rows(star) <= FEW else at, side, "left").withColumn(side, F.coalesce("__root", side)).drop("__root")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of the task."""
    edges = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
    if edges:
        nodes, place = np.unique(np.concatenate(edges), return_inverse=True)
        root = union(np.arange(len(nodes)), *place.reshape(-1, 2).T)
        below = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["u", "root"])


def stars(edges: DataFrame, kept: Kept, few: int = FEW_EDGES) -> DataFrame:
    """``(u, root)``: each node of ``edges`` that isn't the smallest of its component, with the smallest.

    Every node hangs below its smallest neighbour, the trees are flattened by doubling, and the edges are contracted to their roots;
    so until none is left. At most ``few`` edges are settled by one task, which is then bounded.
    """
    left, star = kept.write(ordered(edges)), None
    while n := kept.rows(left):
        if n <= few:
            up = kept.write(left.coalesce(1).mapInArrow(_forest, "u bigint, root bigint"))
        else:
            up = kept.write(left.groupBy("u").agg(F.min("v").alias("root")))
            while True:
                at = up.select(F.col("u").alias("root"), F.col("root").alias("further"))
                on = kept.write(up.join(at, "root", "left").select("u", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
                kept.drop(up)
                up = kept.write(on.drop("moved"))
                if not on.where("moved").limit(1).count():
                    break
        star = up if star is None else kept.write(renamed(star, "root", up, kept).unionByName(up))
        if n <= few:
            break
        left = kept.write(ordered(renamed(renamed(left, "u", up, kept), "v", up, kept)))
    return kept.write(left.select("u", F.col("v").alias("root"))) if star is None else star


def components(docs: DataFrame, marked: DataFrame, text: str, kept: Kept) -> DataFrame:
    """``(u, root)`` of each set that has a near copy and isn't the smallest of its component."""
    n = kept.rows(marked)
    distinct = kept.write(marked.groupBy("sid").agg(F.min("th").alias("th"), F.first("bands").alias("bands")))
    alone = distinct.select("bands", "sid", F.col("sid").alias("root"))
    heads = kept.write(by_band(alone, heads_in_bands, n, "u bigint, v bigint").distinct())
    near = kept.write(ordered(alike(marked, kept).unionByName(heads.groupBy("u").agg(F.min("v").alias("v")))))
    wanted = F.explode(F.array("u", "v")).alias("sid")
    sets = kept.write(sets_of(docs, distinct, kept.write(heads.unionByName(near).select(wanted).distinct()), text, kept))

    star = merged(None, confirmed(near, sets, kept), kept)
    second = kept.write(apart(heads.join(near, ["u", "v"], "left_anti"), star, kept))
    star = merged(star, confirmed(second, sets, kept), kept)
    # bands whose sets are not yet in one component
    kin = renamed(distinct.join(sets.select("sid"), "sid").select("bands", "sid", F.col("sid").alias("root")), "root", star, kept)
    left = kept.write(by_band(kin, mixed_in_bands, n, "sid bigint, root bigint").distinct())
    return by_rare_shingles(star, left, sets, kept)


def apart(edges: DataFrame, star: DataFrame | None, kept: Kept) -> DataFrame:
    """The edges ``(u, v)`` whose ends are in different components."""
    both = edges.select("u", "v", F.col("u").alias("u_root"), F.col("v").alias("v_root"))
    return renamed(renamed(both, "u_root", star, kept), "v_root", star, kept).where("u_root <> v_root").select("u", "v")


def merged(star: DataFrame | None, edges: DataFrame, kept: Kept) -> DataFrame | None:
    """The components ``star`` (None: no two are joined yet) and those that the written ``edges`` between sets join."""
    if not kept.rows(edges):
        return star
    up = stars(renamed(renamed(edges, "u", star, kept), "v", star, kept), kept)
    return up if star is None else kept.write(renamed(star, "root", up, kept).unionByName(up))


def rare_shingles(left: DataFrame, sets: DataFrame, kept: Kept, least: float = SIMILARITY) -> DataFrame:
    """The shingles by which sets ``(sid, root)`` of different components must meet: ``(shingle, sid, root, n, rest, share, bits)``.

    With all shingles in one order, rare ones first, two sets of that similarity share one of the first |x| - ceil(least |x|) + 1
    of each, early enough for the ``rest`` to suffice. Texts that have a common body and a ninth of their own don't meet. ``share``
    is the part of a set's shingles that other sets have, too.
    """
    own = sets.join(small(left, kept), "sid").select("sid", "root", "bits", F.size("shingles").alias("n"), "shingles")
    every = own.select("sid", "root", "n", F.explode("shingles").alias("shingle"))
    common = every.groupBy("shingle").count().where("count > 1")
    # a shingle of one set comes first and pairs nothing: how many a set has is enough
    order = every.join(common, "shingle").groupBy("sid", "root", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("shared"))
    begin = F.greatest(F.lit(0), F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    first = order.select("sid", "root", "n", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), begin)).alias("at", "x"))
    first = kept.write(first.select("x.shingle", "sid", "root", "n", (F.col("m") - F.col("at")).alias("rest"), (F.col("m") / F.col("n")).alias("share")))
    return kept.write(where_mixed(first).join(own.select("sid", "bits"), "sid"))


def where_mixed(first: DataFrame) -> DataFrame:
    """The rows of ``rare_shingles`` whose shingle is in several components."""
    mixed = first.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("shingle")
    return first.join(mixed, "shingle", "left_semi")


def meeting(first: DataFrame, other: DataFrame, kept: Kept, least: float = SIMILARITY) -> DataFrame:
    """Different ``(u, v)``, u > v, that meet at a shingle, aren't in one component, and aren't seen to be too far apart.

    From the first shared shingle on, the rest of both must hold as many as two sets of these sizes have to share. And where bits
    tell whether the number of shingles that hash to them is odd, every bit that differs is a shingle that one of the sets lacks.
    """
    held = other.select("shingle", *[F.col(c).alias(f"v_{c}") for c in ("sid", "root", "n", "rest", "bits")])
    both = F.col("n") + F.col("v_n")
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("v_bits")[i])) for i in range(PARITY // 64)), F.lit(0))
    enough = (F.least("rest", "v_rest") >= least / (1 + least) * both - 1e-6) & (differ <= (1 - least) / (1 + least) * both + 1e-6)
    near = first.join(held, "shingle").where((F.col("sid") != F.col("v_sid")) & (F.col("root") != F.col("v_root")) & enough)
    return kept.write(ordered(near.select(F.col("sid").alias("u"), F.col("v_sid").alias("v"))))


def central(first: DataFrame) -> DataFrame:
    """Of each shingle the set that is nearest to the others' common body: the one with the largest part of shingles that others have."""
    row = F.struct("sid", "root", "n", "rest", "bits")
    return first.groupBy("shingle").agg(F.max_by(row, F.struct("share", "sid")).alias("x")).select("shingle", "x.*")


def by_rare_shingles(star: DataFrame | None, left: DataFrame, sets: DataFrame, kept: Kept) -> DataFrame | None:
    """``star`` and what the sets ``(sid, root)`` of different components join, every pair that is similar enough included: first
    each set with the central one of its rare shingles, which makes one component of most of a crowd, then what is still apart."""
    if not kept.rows(left):
        return star
    first = rare_shingles(left, sets, kept)
    star = merged(star, confirmed(meeting(first, central(first), kept), sets, kept), kept)
    apart_yet = kept.write(where_mixed(renamed(first, "root", star, kept)))
    return merged(star, confirmed(meeting(apart_yet, apart_yet, kept), sets, kept), kept)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """One document of each component of near copies: the one with the smallest key. All columns stay.

    Texts without words are copies of each other. A row without a key can't be told from others, so it stays.
    """
    kept = Kept(docs.sparkSession)
    marked = kept.write(marks(docs, key, text))
    star = components(docs, marked, text, kept)
    found = kept.write(renamed(marked.select("key", "th", F.col("sid").alias("root")), "root", star, kept))
    named = kept.write(with_least(found, "root", "key", "component", keep=kept.write))
    out = representatives(docs, named, key, text, most_broadcast, keep=Kept(docs.sparkSession).write)
    kept.drop_all()
    return out
