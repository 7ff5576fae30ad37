"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Texts are tokenised where they are read and only piece lengths and checksums move on. Pieces are dealt to shards of bounded
size by a hash; each shard is packed by several islands at once. An island's individuals are whole packings: crossover takes
well-filled bins of one parent over into the other, drops the bins that hold a piece twice and puts the displaced pieces back
by best fit. Between epochs an island's elite goes to its neighbour. Fewer bins are better, and of as many bins those that gather
the free room in few of them, which leaves fewer bins that aren't full. Those are broken up and packed again, all shards'
together, in the same way.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.common import claim, give_back
from weftline.session import settled

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces a shard is meant to hold, islands of a shard, epochs, and times that bins which aren't full are packed again together.
SHARD, ISLANDS, EPOCHS, AGAIN = 4096, 2, 2, 1
#: Individuals of an island; generations of an epoch, and at most where more bins are in use than their sum needs.
PEOPLE, GENERATIONS, MOST_GENERATIONS = 4, 3, 30
#: Share of a bin that counts as full.
FULL = 0.995
#: Different word parts whose ids a worker keeps.
KEPT_PARTS = 800_000

# The splitting of the tokenizer that the memory of word parts is made for, and its pattern written out for the
# characters below U+0100 in lower case.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_LETTERS = "a-zªµºß-öø-ÿ"
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼½¾]|[^{_SPACES}0-9²³¹¼½¾{_LETTERS}]+")


#: Marks a chunk that goes to the tokenizer as it is; no part that the pattern splits off has this character.
RAW = "Ā"


class Words(dict):
    """Word part to its number; a new part gets the next number and waits in ``fresh`` to be tokenised."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.fresh.append(part)
        return n


class Grown:
    """Numbers in a row, with room for more."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.r_[self.data[: self.n], np.empty(max(len(more), self.n // 2), self.data.dtype)]
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Tokens:
    """The tokenizer with a memory of word parts.

    It never merges across the parts its pattern splits off, so a text's ids are its parts' ids in a row, and each different
    part is tokenised once. Chunks with characters above U+00FF or special tokens go to the tokenizer as they are. A tokenizer
    that splits in another way gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        end = own["model"].get("end_of_word_suffix")
        self.known = ((own["normalizer"] or {}).get("normalizers"), (own["pre_tokenizer"] or {}).get("pretokenizers"), end) == (_NORMALIZERS, _SPLITTERS, "</w>")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.parts, self.ids, self.begin = Words(), Grown(np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), Grown(np.uint32)
        self.begin.add(np.zeros(1, np.uint32))

    def split(self, text: str) -> list[str]:
        lower = text.lower()
        if "<|" not in text and (text.isascii() or max(text) < "Ā"):
            return _PARTS.findall(lower)
        out = []
        for chunk in re.split("[ \t\n\r]+", text):
            plain = "<|" not in chunk and (chunk.isascii() or max(chunk, default=" ") < "Ā")
            out += _PARTS.findall(chunk.lower()) if plain else [RAW + chunk]
        return out

    def learn(self) -> None:
        """Ids of the fresh parts. Simple ones are tokenised a thousand at a time; the word-end tokens tell them apart."""
        fresh, self.parts.fresh = self.parts.fresh, []
        if not fresh:
            return
        pieces: list[np.ndarray] = []
        for i in range(0, len(fresh), 1000):
            some = fresh[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids) and not any(p[0] == RAW for p in some):
                pieces += np.split(ids, cuts[:-1])
            else:
                pieces += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([p.removeprefix(RAW) for p in some], add_special_tokens=False)]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin.add(self.ids.n + np.cumsum(size))
        self.ids.add(np.concatenate(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.known:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        if len(self.parts) > KEPT_PARTS:
            self.clear()
        split = [self.split(t) for t in texts]
        number = self.parts.__getitem__
        words = np.fromiter((number(p) for parts in split for p in parts), np.int64, sum(map(len, split)))
        self.learn()
        begin = self.begin.data[words].astype(np.int64)
        size = self.begin.data[words + 1] - begin
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)
        of_text = np.r_[0, ends][np.cumsum([0, *map(len, split)])]
        return self.ids.data[places].astype(np.uint32), np.diff(of_text)


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = "doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Bytes of text that are tokenised at once.
TEXT_BYTES = 1 << 20


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and then ``end``, cut into runs of ``capacity``; the last may be shorter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _TOKENS.clear)
        model = tokens(path or tokenizer_path())
        for whole in batches:
            texts = whole.column(1).fill_null("")
            sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(sizes // TEXT_BYTES)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                ids, sizes = model.encode(texts.slice(i, j - i).to_pylist())
                doc, number, start, length, crc = [], [], [], [], []
                at = 0
                for k, n in enumerate(sizes.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, capacity)):
                        part = own[s : s + capacity]
                        doc.append(i + k)
                        number.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(f"`{key}`", F.col(f"`{text}`").cast("string")).mapInArrow(run, PIECES.format(key=kind))


class Room:
    """Open bins by the room they have left; the fullest bin that a piece fits is found by bit arithmetic."""

    def __init__(self) -> None:
        self.mask, self.by_room = 0, {}

    def add(self, b: int, room: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        own = self.by_room[room]
        b = own.pop()
        if not own:
            del self.by_room[room]
            self.mask &= ~(1 << room)
        return b, room


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], capacity: int, fill: list[int]) -> None:
    """Put ``items``, longest first, each into the fullest bin it fits, or else into a new one."""
    room = Room()
    for b, f in enumerate(fill):
        room.add(b, capacity - f)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        found = room.take(size)
        if found is None:
            bins.append([i])
            fill.append(size)
            room.add(len(bins) - 1, capacity - size)
        else:
            b, left = found
            bins[b].append(i)
            fill[b] += size
            room.add(b, left - size)


Packing = tuple[list[list[int]], list[int]]


def fitness(p: Packing) -> tuple[int, int]:
    """Fewer bins first, then free room gathered in few bins."""
    return -len(p[1]), sum(f * f for f in p[1])


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator, told: Counter) -> Packing:
    """``a`` with some well-filled bins of ``b``; bins of ``a`` that hold a piece of these go, and what they displace is best-fitted
    with the pieces of the bins that are loosest."""
    bins_b, fill_b = b
    good = [k for k, f in enumerate(fill_b) if f >= FULL * capacity] or list(range(len(bins_b)))
    chosen = [k for k, x in zip(good, (rng.random(len(good)) < 0.3).tolist(), strict=True) if x]
    taken = {i for k in chosen for i in bins_b[k]}
    bins, fill, loose = [bins_b[k][:] for k in chosen], [fill_b[k] for k in chosen], []
    for own, f in zip(*a, strict=True):
        if taken.isdisjoint(own):
            bins.append(own[:])
            fill.append(f)
        else:
            loose += [i for i in own if i not in taken]
    told.update(crossovers=1, injected=len(chosen), displaced=len(loose))
    return refitted((bins, fill), loose, sizes, capacity, rng)


def refitted(p: Packing, loose: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """``p`` and the loose pieces, its loosest bins and a few others broken up and best-fitted with them."""
    bins, fill = p
    few = max(2, len(fill) // 50)
    worst = set(np.argsort(fill, kind="stable")[:few].tolist()) | set(rng.integers(0, len(fill), few).tolist()) if fill else set()
    loose = loose + [i for k in worst for i in bins[k]]
    kept, filled = [own for k, own in enumerate(bins) if k not in worst], [f for k, f in enumerate(fill) if k not in worst]
    best_fit(sizes, loose, kept, capacity, filled)
    return kept, filled


def first_people(sizes: list[int], capacity: int, rng: np.random.Generator) -> Iterator[Packing]:
    """All pieces best-fitted, longest first; then, for variety, a random part of them by itself and the others after it."""
    some: list[int] = []
    while True:
        bins: list[list[int]] = []
        fill: list[int] = []
        best_fit(sizes, some, bins, capacity, fill)
        best_fit(sizes, list(set(range(len(sizes))).difference(some)), bins, capacity, fill)
        yield bins, fill
        some = np.flatnonzero(rng.random(len(sizes)) < 0.5).tolist()


def evolve(sizes: list[int], start: list[Packing], capacity: int, seed: int, told: Counter | None = None) -> Packing:
    """The best packing after some generations, from the given ones and more to make up the island's people.

    Every generation crosses the best with another, both ways, and the children take the places of the worst. It goes on while
    the bins are more than their sum needs and stops early only where no packing is better: all bins but one full to the last.
    """
    rng, told = np.random.default_rng(seed), told if told is not None else Counter()
    people, more = list(start), first_people(sizes, capacity, rng)
    while len(people) < PEOPLE:
        people.append(next(more))
    least = -(-sum(sizes) // capacity)
    ideal = -least, (least - 1) * capacity**2 + (sum(sizes) - (least - 1) * capacity) ** 2
    for g in range(MOST_GENERATIONS):
        people.sort(key=fitness, reverse=True)
        best = fitness(people[0])
        if best == ideal or g >= GENERATIONS and -best[0] <= least:
            break
        other = people[1 + int(rng.integers(0, len(people) - 1))]
        people[-2:] = [cross(people[0], other, sizes, capacity, rng, told), cross(other, people[0], sizes, capacity, rng, told)]
        told["better"] += fitness(max(people[-2:], key=fitness)) > best
    return max(people, key=fitness)


def packing_of(sizes: list[int], bin_of: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        bins.setdefault(b, []).append(i)
    return list(bins.values()), [sum(sizes[i] for i in own) for own in bins.values()]


def labels(p: Packing, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for b, own in enumerate(p[0]):
        out[own] = b
    return out


ISLAND = "shard bigint, island bigint, rank bigint, id bigint, length bigint, bin bigint, used bigint, squares bigint, crossovers bigint, better bigint"


def evolved(items: DataFrame, count: int, capacity: int, seed: int) -> DataFrame:
    """``items (id, length)`` as every island of their shards packed them after the last epoch.

    ``used`` and ``squares`` say how good an island's packing is, ``crossovers`` and ``better`` how many it made in the last epoch
    and in how many generations a child was better than all before. Rank 0 is an island's own packing, rank 1 one that came.
    """
    shards = max(1, -(-count // SHARD))
    number = lambda n: F.lit(n).cast("long")
    rows = items.select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).alias("shard"), F.explode(F.sequence(number(0), number(ISLANDS - 1))).alias("island"), number(0).alias("rank"), "id", "length",
        number(-1).alias("bin"), *[number(0).alias(c) for c in ("used", "squares", "crossovers", "better")],
    )

    def island(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            shard, own = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
            ids, size, rank, at = (table.column(c).to_numpy() for c in ("id", "length", "rank", "bin"))
            start, order = [], None
            for r in np.unique(rank):
                m = np.flatnonzero(rank == r)
                m = m[np.argsort(ids[m])]
                if order is None:
                    order = m
                if at[m[0]] >= 0:
                    start.append(packing_of(size[m].tolist(), at[m].tolist()))
            sizes, told = size[order].tolist(), Counter()
            best = evolve(sizes, start, capacity, seed * 1_000_003 + shard * 101 + own + 7 * len(start), told)
            n, (_, squares) = len(sizes), fitness(best)
            homes = [(own, 0)] if last else [(own, 0), ((own + 1) % ISLANDS, 1)]
            whole = {"used": len(best[1]), "squares": squares, "crossovers": told["crossovers"], "better": told["better"], "shard": shard}
            repeated = {"island": [h for h, _ in homes], "rank": [r for _, r in homes]}
            tiled = {"id": ids[order], "length": size[order], "bin": labels(best, n)}
            columns = {k: np.full(n * len(homes), v, np.int64) for k, v in whole.items()} | {k: np.repeat(np.array(v, np.int64), n) for k, v in repeated.items()} | {k: np.tile(v, len(homes)) for k, v in tiled.items()}
            return pa.table(columns).select([c.split()[0] for c in ISLAND.split(", ")])

        return run

    for epoch in range(EPOCHS):
        rows = rows.groupBy("shard", "island").applyInArrow(island(epoch == EPOCHS - 1), ISLAND)
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """``items (id bigint, length bigint)``, ids all different and lengths at most ``capacity``, with ``sequence_id``: the least id
    of the sequence."""
    done = items.where(F.col("length") >= capacity).select("id", "length", F.col("id").alias("sequence_id"))
    rest = items.where(F.col("length") < capacity)
    for turn in range(AGAIN + 1):
        count = rest.count()
        packed = settled(evolved(rest, count, capacity, seed + turn))
        # the better island of each shard
        best = packed.groupBy("shard").agg(F.min(F.struct("used", -F.col("squares"), "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
        whole = Window.partitionBy("shard", "bin")
        chosen = packed.join(best, ["shard", "island"]).select("id", "length", F.min("id").over(whole).alias("sequence_id"), F.sum("length").over(whole).alias("filled"))
        if turn < AGAIN and count > SHARD:
            chosen = settled(chosen)
            done = done.unionByName(chosen.where(F.col("filled") >= int(FULL * capacity)).drop("filled"))
            rest = chosen.where(F.col("filled") < int(FULL * capacity)).select("id", "length")
        else:
            return done.unionByName(chosen.drop("filled"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id and the gapless ``offset`` in the sequence.

    A null or empty text is one piece, the end id alone. Repeated rows and null ids are packed like others, each row by itself.
    """
    cut = settled(pieces(docs, path, capacity).withColumn("id", F.monotonically_increasing_id()))
    placed = pack(cut.select("id", "length"), capacity, seed)
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.drop("length").join(placed, "id").withColumn("offset", offset).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
