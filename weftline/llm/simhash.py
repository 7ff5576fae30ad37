"""SimHash near-duplicates by pigeonring filtering.

Two fingerprints within ``bits`` differing bits, cut into ``segments`` > ``bits`` segments laid in a ring, have a segment from
which every chain of l consecutive segments differs in at most floor(l * bits / segments) bits. The first segment of that
chain is therefore equal and the first two differ in one bit at most: fingerprints are grouped by the first, matched on the
first two with a bit of the second flipped, and longer chains are held against their budgets before the whole distance is.

Work is on different fingerprints, so exact copies cost nothing. A group emits a spanning forest of its links, never its
pairs, and components come from large-star/small-star rounds over those edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import representatives, text_hash, with_least
from weftline.session import settled

#: Rows (five for each fingerprint) that one group of the candidate search is meant to hold, and the least number of groups.
GROUP_ROWS, LEAST_GROUPS = 200_000, 48
#: Pairs that are compared at once inside a group.
CHUNK = 2_000_000


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles of ``words`` words, A-Z lower-cased, repeats included. Fewer words make one shingle; none make none."""
    w = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), seed)] if w else [], "<u8")
    return np.array([digest(b" ".join(s), seed) for s in zip(*[w[i:] for i in range(words)])], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash: the bits that are set in over half of the hashes; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    return fingerprint(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``(key, th, fp)`` for each row, th being its text's hash; a null text is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((text_fingerprint(t, words, seed) for t in b.column(2).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["key", "th", "fp"])

    return docs.select(f"`{key}`", text_hash(text), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"key {kind}, th bigint, fp bigint")


def widths(segments: int) -> list[int]:
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]: the smallest index of each component."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def ring_links(fps: np.ndarray, first: int, second: int, bits: int, ring: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``fps`` (rotated so that the chain starts at the top bit).

    first, second: widths of the chain's first two segments; ring: all widths from the chain's start.
    """
    budget = [(length + 1) * bits // len(ring) for length in range(len(ring))]
    keys = fps >> np.uint64(64 - first - second)
    order = np.lexsort((fps, keys))
    fps, keys = fps[order], keys[order]
    # each key's first fingerprint takes in what is near to it, so that a dense crowd is one label and isn't compared pairwise
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    head = np.repeat(heads, np.diff(np.r_[heads, len(keys)]))
    label = np.where(distance(fps, fps[head]) <= bits, head, np.arange(len(fps)))
    order = np.lexsort((label, keys))
    fps, keys, label = fps[order], keys[order], label[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (label[1:] != label[:-1])])
    ends, run_key, run_label = np.r_[starts[1:], len(keys)], keys[starts], label[starts]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root = place[label]
    root = union(np.arange(len(fps)), np.arange(len(fps)), root)

    def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = hi - lo
        who = np.repeat(np.arange(len(lo)), n)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)

    flips = [0] + ([1 << k for k in range(second)] if budget[1] else [])
    for flip in flips:
        near = keys ^ np.uint64(flip)
        q, run = spread(np.searchsorted(run_key, near, "left"), np.searchsorted(run_key, near, "right"))
        other = run_label[run] != label[q]
        q, run = q[other], run[other]
        size = ends[run] - starts[run]
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1, len(q)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            pair, m = spread(starts[run[i:j]], ends[run[i:j]])
            a = q[i:j][pair]
            keep = (a < m) & (root[a] != root[m])
            a, m = a[keep], m[keep]
            diff, used = fps[a] ^ fps[m], first + second
            for length in range(2, len(ring)):
                used += ring[length]
                keep = np.bitwise_count(diff >> np.uint64(64 - used)) <= budget[length]
                a, m, diff = a[keep], m[keep], diff[keep]
            root = union(root, a, m)
    child = np.flatnonzero(root != np.arange(len(root)))
    return fps[child], fps[root[child]]


def rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(distinct: DataFrame, bits: int = 4, segments: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` between fingerprints of the column ``fp`` (each once) that join all within ``bits`` bits and no others."""
    segments = segments or bits + 1
    if not bits < segments <= 64:
        raise ValueError("there must be more segments than bits that may differ")
    ring = widths(segments)
    offsets = np.cumsum([0, *ring])[:-1].tolist()
    groups = max(LEAST_GROUPS, -(-segments * distinct.count() // GROUP_ROWS))
    view = lambda i: F.struct(F.lit(i).alias("start"), rotated(F.col("fp"), offsets[i]).alias("fp"), F.shiftrightunsigned(rotated(F.col("fp"), offsets[i]), 64 - ring[i]).alias("block"))
    rows = distinct.select(F.explode(F.array(*map(view, range(segments)))).alias("v")).select("v.start", "v.fp", F.pmod(F.xxhash64("v.start", "v.block"), F.lit(groups)).alias("part"))

    def run(table: pa.Table) -> pa.Table:
        start, fp = table.column("start").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        us, vs = [], []
        for i in range(segments):
            own = fp[start == i]
            if len(own) > 1:
                a, b = ring_links(own, ring[i], ring[(i + 1) % segments], bits, ring[i:] + ring[:i])
                back = lambda x: x if not offsets[i] else (x >> np.uint64(offsets[i])) | (x << np.uint64(64 - offsets[i]))  # noqa: B023, E731
                us.append(back(a))
                vs.append(back(b))
        u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
        return pa.table({"u": u, "v": v})

    return rows.groupBy("part").applyInArrow(run, "u bigint, v bigint")


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(u, root)``: each node of ``edges`` that isn't the smallest of its component, with the smallest.

    Alternating large-star and small-star; every round is written to the shared folder and ends when nothing changes.
    """
    e = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = lambda d: d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = signature(e)
    if not seen[0]:
        return e.withColumnRenamed("v", "root")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = settled(small)
        now = signature(e)
        if now == seen:
            return e.withColumnRenamed("v", "root")
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, bits: int = 4, segments: int | None = None) -> DataFrame:
    """``(key, th, fp, root, component)`` for each row of ``docs``: hash of the text, fingerprint, smallest fingerprint and
    smallest key reachable over links.

    Fingerprints link at ``bits`` or fewer differing bits. Null and empty texts have fingerprint 0 and link like others. A null
    key is never a component's name unless the component has no other. Repeated rows each have their row.
    """
    marked = settled(fingerprints(docs, key, text, words, seed))
    distinct = settled(marked.groupBy("fp").agg(F.min("key").alias("least")))
    star = stars(links(distinct.select("fp"), bits, segments))
    rooted = distinct.join(star, distinct["fp"] == star["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = with_least(settled(rooted), "root", "least", "component").select("fp", "root", "component")
    return marked.join(named, "fp").select("key", "th", "fp", "root", "component")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 200_000, **options) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest key. All columns stay.

    A row without a key can't be told from others by key, so it stays. Of rows of one component that share a key, one stays.
    """
    found = settled(near_duplicates(docs, key, text, **options).select("key", "th", "root", "component"))
    return representatives(docs, found, key, text, most_broadcast)


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each row. A null text is empty; a null id names a component only where no other does; repeated
    rows each have their row."""
    out = near_duplicates(docs)
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
