"""LM scoring with an Elias-Fano n-gram trie.

The model is a trigram model. Its levels are files in the shared folder, cut into shards, and tasks map them into memory:

* words: sorted 64-bit hashes (the place is the word's id), counts, and what a word leaves to the unigrams after it;
* pairs (u, v), in the shard of their hash: the contexts u that occur there, pointers to their children, and the children v.
  A child is kept as v above its context's base, bases rising by the number of words, so the whole level rises and is one
  Elias-Fano sequence, and a context's child is found as the successor of v from that base, inside the context's pointers;
* triples (u, v, w), in the file of (u, v): pointers from the pairs, and children w kept the same way.

Children carry log probabilities in 256 steps. Absolute discounting, interpolated: a kept n-gram has (c - D) / c(context),
rounded down to a step, and what its kept children leave of 1 goes to the shorter context, down to (c + 0.1) / (N + 0.1 (V + 1)).
So the probabilities after every context sum to 1 exactly, unknown words as one word included. All n-grams are kept, those seen
once included, unless ``least`` says otherwise.

Texts are read three times: for the words, for the triples (a pair's count is the sum of its triples', an end being followed by
a mark of its own), and to be scored. Counting gathers sorted blocks of counts from each task, by shard, so a frequent word or
pair is one entry of a block and hash shards stay even. Nothing but totals and file names of shards comes to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from weftline.llm.common import remainder, without
from weftline.llm.elias_fano import EliasFano, Files, Marks
from weftline.session import settled, shared_dir

#: Weight that every word and the unknown word have beyond their count, and discount of n-grams.
ADD, DISCOUNT = 0.1, 0.5
#: Steps of the quantised probabilities. They are multiples of 2**-48, so sums of them are exact in any order; the last step
#: stands for nothing: what is so improbable is left to the shorter context.
STEP, STEPS = 0.03, 256
PROBABILITY = np.floor(10.0 ** (-STEP * np.arange(STEPS)) * 2.0**48) / 2.0**48
PROBABILITY[-1] = 0.0
#: Tokens whose n-grams one shard is meant to hold, and words of a word shard.
SHARD_TOKENS, SHARD_WORDS = 4_000_000, 4_000_000
#: Bytes of text, bytes whose words are hashed, and windows of three tokens that are handled at once.
CHUNK, BLOCK, RUN = 8 << 20, 1 << 20, 1_500_000
#: Hashes of the end token, of the start of a text (a context only), and of the mark behind an end. Words have hashes in between.
END, START, NONE = np.uint64(0), np.uint64(2**64 - 2), np.uint64(2**64 - 1)

BLOCKS = "shard int, block binary"


def codes(p: np.ndarray) -> np.ndarray:
    """Steps, rounded so that the quantised probability is not above ``p``."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) / STEP - 1e-12), 0, STEPS - 1).astype(np.uint8)


def block(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths, compressed byte by byte place; the first is sorted and kept as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    parts = [(a, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in (first, *arrays[1:])]
    raw = b"".join(p for _, p in parts)
    head = json.dumps([len(raw), *[[a.dtype.str, len(a)] for a, _ in parts]]).encode()
    return len(head).to_bytes(4, "little") + head + pa.compress(raw, codec="zstd", asbytes=True)


def unblock(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    total, *kinds = json.loads(data[4 : 4 + size])
    raw, at, out = pa.decompress(data[4 + size :], decompressed_size=total, codec="zstd", asbytes=True), 0, []
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def heads_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the next of the sorted keys begins."""
    fresh = np.ones(len(sorted_keys[0]), bool)
    if len(fresh):
        fresh[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(fresh)


def summed(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of all blocks in order, and the sums of their values."""
    keys, values = (np.concatenate(c) for c in zip(*map(unblock, blocks), strict=True))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = heads_of(keys)
    return keys[heads], np.add.reduceat(values, heads) if len(heads) else values


def shard_cuts(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by shard that keeps the order inside shards, the shards that occur, and where they begin (and the last ends)."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    heads = heads_of(shard[order])
    return order, shard[order][heads], np.r_[heads, len(shard)]


def dealt(shard: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """A block for each shard, from arrays of one length sorted by their first."""
    order, names, cuts = shard_cuts(shard)
    split = [a[order] for a in arrays]
    return sent(names, [block(*[a[i:j] for a in split]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def sent(shards: np.ndarray, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(blocks, pa.binary())], names=["shard", "block"])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


# words are hashed by a random 64-bit number for each byte times one for its place, summed
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_SPACE] = 0
_BYTES[65:91] = _BYTES[97:123]
_PLACES = mixed(np.arange(1, 1 << 12, dtype=np.uint64)) | np.uint64(1)


def places(n: int) -> np.ndarray:
    return _PLACES if n <= len(_PLACES) else mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) of all texts in a row, and how many each text has."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inside = offsets[:-1][offsets[:-1] < len(data)]
    begins[inside] = ~space[inside]
    begins = np.flatnonzero(begins)
    sizes = np.diff(np.searchsorted(begins, offsets))
    hashes = np.empty(len(begins), np.uint64)
    cuts = np.r_[0, np.flatnonzero(np.diff(begins // BLOCK)) + 1, len(begins)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            a, z = begins[i], begins[j] if j < len(begins) else len(data)
            length = np.diff(np.r_[begins[i:j], z])
            at = np.arange(z - a) - np.repeat(begins[i:j] - a, length)
            hashes[i:j] = np.add.reduceat(_BYTES[data[a:z]] * places(int(length.max()))[at], begins[i:j] - a)
    hashes = mixed(hashes)
    return np.clip(hashes, END + np.uint64(1), START - np.uint64(1), out=hashes), sizes


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' words."""
    for b in batches:
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield b.slice(i, j - i), *words_of(b.column(column).slice(i, j - i))


def stream(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each a start, its words, an end and the mark behind it; and where each text begins."""
    size = sizes + 3
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    for at, token in ((begin, START), (begin + size - 2, END), (begin + size - 1, NONE)):
        out[at], inner[at] = token, False
    out[inner] = hashes
    return out, begin


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order, and the place of each hash among them, found from its leading bits."""
    unique = np.unique(hashes)
    shift = np.uint64(64 - max(8, len(unique).bit_length() + 1))
    first = np.searchsorted(unique, np.arange(1 << int(64 - shift), dtype=np.uint64) << shift)
    at = first[(hashes >> shift).astype(np.int64)]
    late = np.flatnonzero(unique[at] != hashes)
    while len(late):
        at[late] += 1
        late = late[unique[at[late]] != hashes[late]]
    return unique, at


def grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys of so many bits: the different ones in order, how often each occurs, and the place of each key among them."""
    width = len(key).bit_length()
    if bits + width <= 64:  # a key and its place fit one number, and numbers sort much faster than places by their keys
        both = np.sort(key << np.uint64(width) | np.arange(len(key), dtype=np.uint64))
        order, key = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    else:
        order = np.argsort(key)
        key = key[order]
    heads = heads_of(key)
    n = np.diff(np.r_[heads, len(key)])
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(heads)), n)
    return key[heads], n, back


@dataclass
class Grams:
    """The different windows of a run of tokens: words (in order of their hashes), pairs of them, and triples as a pair and a word.

    ``pair`` and ``triple`` say for each window of three tokens which one it begins with and is.
    """

    words: np.ndarray
    token: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pair: np.ndarray
    head: np.ndarray
    third: np.ndarray
    count: np.ndarray
    triple: np.ndarray


def grams(tokens: np.ndarray) -> Grams:
    words, token = ranked(tokens)
    bits = len(words).bit_length()
    low, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    local = token.astype(np.uint64)
    pairs, _, pair = grouped(local[:-2] << low | local[1:-1], 2 * bits)
    triples, count, triple = grouped(pair.astype(np.uint64) << low | local[2:], bits + len(pairs).bit_length())
    as_place = lambda x: x.astype(np.int64)
    return Grams(words, token, as_place(pairs >> low), as_place(pairs & mask), pair, as_place(triples >> low), as_place(triples & mask), count, triple)


def spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in a row."""
    n = end - begin
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


@dataclass(frozen=True)
class Sizes:
    """What every task must know of a model: few numbers, and the files of the shards that have any."""

    folder: str
    word_bits: int
    word_starts: tuple[int, ...]
    tokens: int
    documents: int
    shards: int
    word_files: dict[int, str]
    left_files: dict[int, str]
    gram_files: dict[int, str]

    @property
    def words(self) -> int:
        return self.word_starts[-1]


class Model:
    """A model as a task sees it. Ids: words by their hashes, then the start of a text, then unknown words and the mark behind an end."""

    def __init__(self, sizes: Sizes) -> None:
        self.sizes, self.files = sizes, Files(sizes.folder)

    def word_numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, count and share left to unigrams, of sorted hashes; count 0 and share 1 for a word that isn't there."""
        s = self.sizes
        ids, counts, share = np.full(len(hashes), s.words + 1, np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        ids[hashes == START], ids[hashes == NONE] = s.words, s.words + 2
        if s.left_files.get(1 << s.word_bits):
            share[hashes == START] = self.files.map(s.left_files[1 << s.word_bits])["left"][0]
        bounds = np.searchsorted(hashes >> np.uint64(64 - s.word_bits), np.arange((1 << s.word_bits) + 1, dtype=np.uint64))
        for k, name in s.word_files.items():
            own = np.arange(bounds[k], bounds[k + 1])
            if not len(own):
                continue
            there = self.files.map(name)
            at = np.minimum(np.searchsorted(there["hash"], hashes[own]), len(there["hash"]) - 1)
            good = there["hash"][at] == hashes[own]
            own, at = own[good], at[good]
            ids[own], counts[own] = s.word_starts[k] + at, there["count"][at]
            if k in s.left_files:
                share[own] = self.files.map(s.left_files[k])["left"][at]
        return ids, counts, share

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids as contexts; the start counts once a text."""
        s = self.sizes
        out = np.full(len(ids), s.documents, np.int64)
        bounds = np.searchsorted(ids, s.word_starts)
        for k, name in s.word_files.items():
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                out[a:b] = self.files.map(name)["count"][ids[a:b] - s.word_starts[k]]
        return out

    def pair_shard(self, pairs: np.ndarray) -> np.ndarray:
        return (mixed(pairs) % np.uint64(self.sizes.shards)).astype(np.int64)


def child(pointers: tuple[np.ndarray, np.ndarray], children: EliasFano, context: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    """Place of ``word`` among the children of ``context``, or -1: its successor from the context's base, if in the context's range."""
    begin, end = pointers
    at, hit = children.find(context * width + word)
    return np.where(hit & (at >= begin) & (at < end), at, -1)


def level_of(context: np.ndarray, word: np.ndarray, contexts: int, width: int, name: str) -> dict[str, np.ndarray]:
    """Pointers and children of a level; ``context`` (sorted, from 0) and ``word`` (sorted in each context, below ``width``) name
    its n-grams."""
    pointers = np.r_[0, np.cumsum(np.bincount(context, minlength=contexts))]
    return EliasFano.build(pointers).arrays(f"{name}.pointers") | EliasFano.build(context * width + word).arrays(f"{name}.children")


class GramFile:
    """A shard of pairs and their triples. What the triples of a pair leave is kept where they are several, else it follows from the one."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        sequence = lambda name: EliasFano.of(arrays, name)
        self.contexts, self.pair_pointers, self.pairs = sequence("contexts"), sequence("pair.pointers"), sequence("pair.children")
        self.pointers, self.triples, self.several = sequence("triple.pointers"), sequence("triple.children"), Marks.of(arrays, "several")
        self.pair_code, self.code, self.left = arrays["pair.code"], arrays["triple.code"], arrays["left"]

    @staticmethod
    def arrays(u: np.ndarray, v: np.ndarray, pair_code: np.ndarray, head: np.ndarray, w: np.ndarray, code: np.ndarray, width: int) -> dict[str, np.ndarray]:
        contexts, rank = np.unique(u, return_inverse=True)
        several = np.bincount(head, minlength=len(u)) > 1
        left = 1 - np.bincount(head, PROBABILITY[code], len(u))[several]
        if not (left > 0).all():
            raise ArithmeticError("n-grams leave nothing to the shorter context")
        return (EliasFano.build(contexts).arrays("contexts") | level_of(rank, v, len(contexts), width, "pair") | level_of(head, w, len(u), width, "triple")
                | Marks.arrays(several, "several") | {"pair.code": pair_code, "triple.code": code, "left": left})

    def find_pairs(self, u: np.ndarray, v: np.ndarray, width: int) -> np.ndarray:
        """Places of pairs sorted by u; -1 where a pair isn't there."""
        heads = heads_of(u)
        context, known = self.contexts.find(u[heads])
        begin, end = self.pair_pointers.both(np.where(known, context, 0))
        n = np.diff(np.r_[heads, len(u)])
        known, context, begin, end = (np.repeat(x, n) for x in (known, context, begin, end))
        out = np.full(len(u), -1, np.int64)
        out[known] = child((begin[known], end[known]), self.pairs, context[known], v[known], width)
        return out

    def look_up(self, u: np.ndarray, v: np.ndarray, n: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs sorted by u, each with ``n`` words after it: the pair's probability, what it leaves, the words' probabilities."""
        q2, left, q3 = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(w))
        if not len(self.pair_code):
            return q2, left, q3
        place = self.find_pairs(u, v, width)
        here = np.flatnonzero(place >= 0)
        at = place[here]
        q2[here] = PROBABILITY[self.pair_code[at]]
        begin, end = self.pointers.both(at)
        own, more = end - begin == 1, end - begin > 1
        left[here[own]] = 1 - PROBABILITY[self.code[begin[own]]]
        left[here[more]] = self.left[self.several.rank(at[more])]
        some = end > begin
        here, at, begin, end = here[some], at[some], begin[some], end[some]
        stop = np.cumsum(n)
        word = spread(stop[here] - n[here], stop[here])
        word_at, begin, end = (np.repeat(x, n[here]) for x in (at, begin, end))
        real = w[word] < width
        word, word_at = word[real], word_at[real]
        found = child((begin[real], end[real]), self.triples, word_at, w[word], width)
        q3[word[found >= 0]] = PROBABILITY[self.code[found[found >= 0]]]
        return q2, left, q3


_MODELS: dict[str, Model] = {}


def opened(sizes: Sizes) -> Model:
    """The worker's model; while a model is being written, a task has what was written before it began."""
    if sizes.folder not in _MODELS or _MODELS[sizes.folder].sizes != sizes:
        _MODELS.clear()
        _MODELS[sizes.folder] = Model(sizes)
    return _MODELS[sizes.folder]


def _reduced(rows: DataFrame, work: Callable[[int, list[bytes]], pa.Table], schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return work(table.column("shard")[0].as_py(), table.column("block").to_pylist())

    return rows.groupBy("shard").applyInArrow(run, schema)


def train(docs: DataFrame, text: str = "text", least: int = 1, shards: int | None = None) -> Sizes:
    """Count the texts and write a model of them to the shared folder.

    least: n-grams of two or more tokens seen less often are left out; 1 keeps all. ``shards`` follows from the number of tokens.
    Null and empty texts are an end alone; without texts the model knows no word.
    """
    body = docs.select(F.lit(0).alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    bits = 6
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/lm-{uuid.uuid4().hex}"
    files = Files(folder)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, sizes in chunks(batches):
            keys, n = np.unique(hashes, return_counts=True)
            keys, n = np.r_[END, keys], np.r_[len(sizes), n].astype(np.int64)
            yield dealt((keys >> np.uint64(64 - bits)).astype(np.int64), keys, n)

    def write_words(shard: int, blocks: list[bytes]) -> pa.Table:
        keys, n = summed(blocks)
        name = files.write(f"words{shard}", {"hash": keys, "count": n})
        ends = int(n[keys == END].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "tokens": [int(n.sum())], "documents": [ends], "file": [name]})

    rows = _reduced(body.mapInArrow(count_words, BLOCKS), write_words, "shard int, n bigint, tokens bigint, documents bigint, file string").collect()  # one row a shard
    n_words = np.zeros(1 << bits, np.int64)
    for r in rows:
        n_words[r["shard"]] = r["n"]
    tokens = sum(r["tokens"] for r in rows)
    sizes = Sizes(folder, bits, tuple(np.r_[0, np.cumsum(n_words)].tolist()), tokens, sum(r["documents"] for r in rows), shards or max(8, -(-tokens // SHARD_TOKENS)), {r["shard"]: r["file"] for r in rows}, {}, {})
    if sizes.words + 3 >= 1 << 32:
        raise ValueError("the vocabulary has more than 2**32 words")

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sizes)
        for _, hashes, n in chunks(batches):
            whole, _ = stream(hashes, n)
            for i in range(0, len(whole) - 2, RUN):
                yield triple_blocks(model, grams(whole[i : i + RUN + 2]))

    def write_grams(shard: int, blocks: list[bytes]) -> pa.Table:
        u, v, n_pairs, head, w, n = summed_triples(blocks)
        kept = n_pairs >= least
        place = np.cumsum(kept) - 1
        good = kept[head] & (n >= least) & (w < sizes.words)
        head, w, n = head[good], w[good], n[good]
        code = codes((n - DISCOUNT) / n_pairs[head])
        u, v, n_pairs = u[kept], v[kept], n_pairs[kept]
        contexts, first = np.unique(u, return_index=True)
        pair_code = codes((n_pairs - DISCOUNT) / np.repeat(opened(sizes).count_of(contexts), np.diff(np.r_[first, len(u)])))
        name = files.write(f"grams{shard}", GramFile.arrays(u, v, pair_code, place[head], w, code, sizes.words))
        mass = np.add.reduceat(PROBABILITY[pair_code], first) if len(u) else np.empty(0)
        # what the kept pairs take of each context word, in blocks by the words' shards; the start's in one of its own
        at = np.searchsorted(sizes.word_starts, contexts, "right") - 1
        tails = dealt(np.where(contexts >= sizes.words, 1 << bits, at), contexts, mass)
        named = pa.table({"shard": pa.array([shard], pa.int32()), "block": pa.array([None], pa.binary()), "file": pa.array([name], pa.string())})
        return pa.concat_tables([named, pa.Table.from_batches([tails]).append_column("file", pa.nulls(tails.num_rows, pa.string()))])

    def write_left(shard: int, blocks: list[bytes]) -> pa.Table:
        ids, mass = summed(blocks)
        last = shard == 1 << bits
        left = np.ones(1 if last else int(n_words[shard]))
        left[ids - (sizes.words if last else sizes.word_starts[shard])] -= mass
        return pa.table({"shard": pa.array([shard], pa.int32()), "file": [files.write(f"left{shard}", {"left": left})]})

    written = settled(_reduced(body.mapInArrow(count_triples, BLOCKS), write_grams, f"{BLOCKS}, file string"))
    named = lambda df: {r["shard"]: r["file"] for r in df.collect()}  # noqa: E731 -- one row a shard
    left_files = named(_reduced(written.where("block is not null").select("shard", "block"), write_left, "shard int, file string"))
    return Sizes(folder, bits, sizes.word_starts, tokens, sizes.documents, sizes.shards, sizes.word_files, left_files, named(written.where("file is not null").select("shard", "file")))


def triple_blocks(model: Model, g: Grams) -> pa.RecordBatch:
    """The triples of a run as blocks by the shard of their pair: pairs, how many triples each has, their third words and counts."""
    ids, _, _ = model.word_numbers(g.words)
    behind = ids == model.sizes.words + 2  # windows that leave a text begin with a pair that holds the mark
    inside = ~(behind[g.first] | behind[g.second])
    pairs = ids[g.first].astype(np.uint64) << np.uint64(32) | ids[g.second].astype(np.uint64)
    stop = np.searchsorted(g.head, np.arange(len(pairs)), "right")
    begin = np.r_[0, stop[:-1]]
    own = np.flatnonzero(inside)
    order, names, cuts = shard_cuts(model.pair_shard(pairs[own]))
    own = own[order]
    pairs, begin, stop = pairs[own], begin[own], stop[own]
    member = spread(begin, stop)
    n = (stop - begin).astype(np.uint32)
    w, count = ids[g.third[member]].astype(np.uint32), g.count[member]
    at = np.r_[0, np.cumsum(n, dtype=np.int64)][cuts]
    blocks = [block(pairs[i:j], n[i:j], w[a:b], count[a:b]) for i, j, a, b in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)]
    return sent(names, blocks)


def summed_triples(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all blocks: the different pairs in order as first word, second word and count; and the different triples in order as the
    place of their pair, third word and count."""
    pairs, sizes, words, counts = zip(*map(unblock, blocks), strict=True)
    keys = np.unique(np.concatenate(pairs))
    head = np.concatenate([np.repeat(np.searchsorted(keys, p), n) for p, n in zip(pairs, sizes, strict=True)])
    key = head.astype(np.uint64) << np.uint64(32) | np.concatenate(words).astype(np.uint64)
    count = np.concatenate(counts)
    del pairs, sizes, words, counts, head
    order = np.argsort(key)
    key, count = key[order], count[order]
    heads = heads_of(key)
    key, count = key[heads], np.add.reduceat(count, heads) if len(heads) else count
    head, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = heads_of(head)
    n_pairs = np.add.reduceat(count, first) if len(first) else count
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), n_pairs, head, w, count


def run_probabilities(model: Model, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a run: the probability of its second token after its first; of its third after both, without the part
    that goes through the shorter context; what is left for that part; and of its second token, whether it is known and its
    unigram probability, as a number and a sign: negative if the word isn't known."""
    s = model.sizes
    ids, counts, share = model.word_numbers(g.words)
    unigram = (counts + ADD) / (s.tokens + ADD * (s.words + 1))
    u, v = ids[g.first], ids[g.second]
    q2, left, q3 = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(g.head))
    stop = np.searchsorted(g.head, np.arange(len(u)), "right")
    begin = np.r_[0, stop[:-1]]
    own = np.flatnonzero((u <= s.words) & (v < s.words))
    order, names, cuts = shard_cuts(model.pair_shard(u[own].astype(np.uint64) << np.uint64(32) | v[own].astype(np.uint64)))
    own = own[order]
    w = ids[g.third]
    for k, i, j in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True):
        if k not in s.gram_files:
            continue
        mine = own[i:j]
        member = spread(begin[mine], stop[mine])
        q2[mine], left[mine], q3[member] = gram_file(model, k).look_up(u[mine], v[mine], stop[mine] - begin[mine], w[member], s.words)
    second = g.token[1:-1]
    low = q2[g.pair] + share[g.token[:-2]] * unigram[second]
    return low, q3[g.triple], left[g.pair], np.where(counts > 0, unigram, -unigram)[second]


def gram_file(model: Model, shard: int) -> GramFile:
    return GramFile(model.files.map(model.sizes.gram_files[shard]))


def log_probabilities(model: Model, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the number of known tokens, and log10 of the unigrams' and of the model's probability."""
    whole, begin = stream(hashes, sizes)
    p, unigram = np.ones(len(whole)), np.ones(len(whole))
    real = (whole != START) & (whole != NONE)
    known = np.zeros(len(whole), np.int64)
    starts = np.zeros(len(whole), bool)
    starts[begin] = True
    for i in range(0, len(whole) - 2, RUN):
        # a window says how probable its second token is, with the help of the window before it, which the run before ended with
        a = max(0, i - 1)
        low, high, left, signed = run_probabilities(model, grams(whole[a : i + RUN + 2]))
        at = np.arange(a, a + len(low))
        after = np.r_[1.0, left[:-1]], np.r_[0.0, high[:-1]]
        value = np.where(starts[at], low, after[1] + after[0] * low)
        fresh = (at >= i) & real[at + 1]
        p[at[fresh] + 1], unigram[at[fresh] + 1], known[at[fresh] + 1] = value[fresh], np.abs(signed[fresh]), signed[fresh] > 0
    return np.add.reduceat(known, begin), np.add.reduceat(np.log10(unigram), begin), np.add.reduceat(np.log10(p), begin)


def score(docs: DataFrame, sizes: Sizes, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score for every whole text; such input columns are replaced.

    A null or empty text is the end token alone. Repeated rows are scored each.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    base = without(docs, *added)
    names, at = [*base.columns, *added], base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sizes)
        for b, hashes, n in chunks(batches, at):
            known, unigram, p = log_probabilities(model, hashes, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), sizes.tokens)), pa.array(unigram), pa.array(p)], names=names)

    schema = StructType([*base.schema.fields])
    for name in added:
        schema = schema.add(name, DoubleType() if name.endswith("score") else LongType())
    return base.mapInArrow(run, schema)


def lm_digest(docs: DataFrame, folds: int = 10) -> DataFrame:
    """All texts scored by a model of those outside fold 0; the model's files go once the scores are settled.

    A null id counts as an empty text for its fold. Repeated rows train and are scored each; a null text is empty.
    """
    held_out = remainder(F.col("doc_id"), folds) == 0
    sizes = train(docs.where(~held_out).select("text"))
    out = settled(score(docs.select("doc_id", "text"), sizes).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    Files(sizes.folder).remove()
    return out
