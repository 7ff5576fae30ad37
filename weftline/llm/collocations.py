"""Phrase collocations by FM-indexes over word ids, one for each shard of the texts, summed across shards.

A shard is a run of texts as one sequence of word ids, a separator (id 0) behind each piece. Its index holds two Burrows-Wheeler
transforms: of the sequence, whose symbols are the words before each place, and of the reversed sequence, whose symbols are the
words behind it; both with places in the order of the next ``depth`` words, which is all that phrases of so many words need. A
phrase is an interval in each. Extending it by a word to the right steps back in the reversed transform (the new interval there
is first[w] + rank of w) and splits its interval in the other one by the words behind it; extending to the left is the same with
both exchanged. The phrases of m + 1 words that can be frequent are those that both ways reach: by the right from a frequent
prefix and by the left from a frequent suffix. Both give the same interval, so they meet by its start, and prefix and suffix of
every phrase are known.

Levels are jobs: shards extend what is frequent over all shards, counts are summed by (prefix, suffix) in hash parts, and every
shard gets back those of its phrases that are frequent, with their intervals. A phrase is thus dropped only when its count over
all texts is known; a shard emits an entry for each of its phrases, however often it occurs there, so a frequent phrase is no hot
key.

Most pairs of words are rare, so pairs are first summed by cells of their hashes, a few bytes each: a shard learns, by a bit for
each of its pairs, whose cell occurs often enough, and emits those alone. That leaves out no frequent pair, and what a cell holds
besides is told apart by the exact sums that follow. Words are summed as text; that no two have one hash is checked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.elias_fano import Files
from weftline.llm.lm_trie import block, dealt, heads_of, mixed, spread, unblock
from weftline.session import Kept, shared_dir

#: Words of a shard's sequence, bytes of a text that are split at once, characters whose pairs a part of the sums is meant to hold.
SHARD_WORDS, SLICE, PART_CHARS, LEAST_PARTS = 2_000_000, 1 << 20, 6_000_000, 24
#: Bits of a pair's cell.
CELL_BITS = 42
#: Fixed value: the seed that Spark's xxhash64 begins with; a word's id is the hash of a salt, its language and its text.
SEED = 42
#: All of these bytes end a piece; ``.`` stands for them, as no word can hold it.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS, b"." * len(_ENDS))


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about a megabyte, cut at blanks."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, with ``.`` where a piece ends."""
    return text.lower().translate(_TABLE).replace(b".", b" . ").split()


class _Ids(dict):
    """Ids of a language's words in a shard, given in order of appearance; all languages of a shard count together."""

    def __init__(self, names: list[tuple[str, bytes]], lang: str) -> None:
        super().__init__({b".": 0})
        self.names, self.lang = names, lang

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names)
        return len(self.names)


class Sequence:
    """The word ids of a shard, as they are gathered."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.ids: dict[str, _Ids] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids.get(lang) or self.ids.setdefault(lang, _Ids(self.names, lang))
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def end_text(self) -> None:
        self.parts.append(np.zeros(1, np.int32))

    def cut(self) -> tuple[np.ndarray, list[tuple[str, bytes]], list[tuple[str, bytes]]]:
        """All up to the last separator, without repeated separators; the names of its ids; and the words behind it."""
        tokens = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        zeros = np.flatnonzero(tokens == 0)
        last = zeros[-1] + 1 if len(zeros) else 0
        body, rest = tokens[:last], [self.names[i - 1] for i in tokens[last:].tolist()]
        return body[(body != 0) | (np.r_[np.int32(0), body[:-1]] != 0)], self.names, rest


def sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of keys of so many bits, equal ones in their own order, and the sorted keys."""
    width = len(key).bit_length()
    if bits + width <= 64:  # a key and its place fit one number, and numbers sort much faster than places by their keys
        both = np.sort(key.astype(np.uint64) << np.uint64(width) | np.arange(len(key), dtype=np.uint64))
        return (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def bits_of(largest: int) -> int:
    return max(1, int(largest).bit_length())


def suffix_order(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the (circular) sequence in the order of their next ``depth`` symbols, by doubling ranks."""
    rank, known = tokens.astype(np.uint64), 1
    order, key = sorted_places(rank, bits_of(rank.max()))
    while known < depth:
        step = min(known, depth - known)  # ranks may overlap: the first ``known`` symbols, then those up to ``known + step``
        bits = bits_of(rank.max())
        order, key = sorted_places(rank << np.uint64(bits) | np.roll(rank, -step), 2 * bits)
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        known += step
    return order


def index_of(tokens: np.ndarray, words: int, depth: int) -> dict[str, np.ndarray]:
    """``first``: where each symbol's places begin in either order; ``before`` and ``after``: the two transforms."""
    first = np.r_[0, np.cumsum(np.bincount(tokens, minlength=words + 1))].astype(np.int64)
    back = tokens[::-1]
    return {"first": first, "before": tokens[suffix_order(tokens, depth) - 1], "after": back[suffix_order(back, depth) - 1]}


def steps_back(transform: np.ndarray) -> np.ndarray:
    """For each place, that of the sequence which is one symbol longer in front."""
    order, _ = sorted_places(transform, bits_of(transform.max()))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return back


def extended(transform: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """All one-word extensions of intervals, for each: the interval it extends, the word, its count, how many of that interval have a
    smaller word, and its first place."""
    place = spread(start, start + n)
    symbol, owner = transform[place], np.repeat(np.arange(len(start)), n)
    bits = bits_of(symbol.max()) if len(symbol) else 1
    order, key = sorted_places(owner.astype(np.uint64) << np.uint64(bits) | symbol.astype(np.uint64), bits + bits_of(len(start)))
    heads = heads_of(key)
    count = np.diff(np.r_[heads, len(key)])
    whose, word = (key[heads] >> np.uint64(bits)).astype(np.int64), key[heads] & np.uint64((1 << bits) - 1)
    smaller = heads - (np.cumsum(n) - n)[whose]
    real = word != 0
    return whose[real], word[real].astype(np.int64), count[real], smaller[real], place[order[heads]][real]


def longer(index: dict[str, np.ndarray], gram: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases one word longer that extend one of the given to the right and another to the left.

    gram: ids; left, right: starts of their intervals in the orders of ``before`` and of ``after``. Returns prefix, suffix, count
    and both starts.
    """
    whose, _, count, smaller, place = extended(index["after"], right, n)
    prefix, start, behind = gram[whose], left[whose] + smaller, steps_back(index["after"])[place]
    other, _, _, _, place = extended(index["before"], left, n)
    suffix, same = gram[other], steps_back(index["before"])[place]
    _, a, b = np.intersect1d(start, same, assume_unique=True, return_indices=True)
    return prefix[a], suffix[b], count[a], start[a], behind[a]


#: Arrays of an index, in the order in which its file holds them.
_ARRAYS = ("first", "before", "after", "hash")


def kept_index(files: Files, shard: int, index: dict[str, np.ndarray]) -> None:
    """Write a shard's index, compressed: transforms hold like words beside each other."""
    files.write(f"{shard:x}", {"index": np.frombuffer(block(*[index[a] for a in _ARRAYS]), np.uint8)}, exact=True)


def index_from(files: Files, shard: int) -> dict[str, np.ndarray]:
    return dict(zip(_ARRAYS, unblock(files.map(f"{shard:x}")["index"].tobytes()), strict=True))


def pairs_of(index: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """All pairs of words of a shard in the order of their cells: cell, first and second word, count, and both starts' parts (how many
    have the first word and a smaller second one, and the first place in the other order)."""
    first = index["first"]
    one, two, count, smaller, place = extended(index["after"], first[1:-1], np.diff(first[1:]))
    h = index["hash"]
    cell = mixed(h[one] * np.uint64(3) + mixed(h[two - 1])) >> np.uint64(64 - CELL_BITS)
    order = np.argsort(cell, kind="stable")
    return tuple(x[order] for x in (cell, one, two - 1, count, smaller, place))


def part_of(cell: np.ndarray, parts: int) -> np.ndarray:
    return (cell * np.uint64(parts) >> np.uint64(CELL_BITS)).astype(np.int64)


def word_hashes(names: list[tuple[str, bytes]], salt: str) -> np.ndarray:
    """Spark's xxhash64 of salt, language and word."""
    begin = xxhash.xxh64_intdigest(salt.encode(), SEED)
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), begin) for lang in {lang for lang, _ in names}}
    return np.fromiter((xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in names), np.uint64, len(names))


BUILT = "lang string, word string, n bigint, part int, shard bigint, block binary"


def build_shards(docs: DataFrame, text: str, lang: str, depth: int, folder: str, none: str, parts: int, salt: str) -> DataFrame:
    """Rows of two kinds: ``(lang, word, n)``, the words of each shard and how often they occur there; and ``(part, shard, block)``, the
    cells of its pairs and their counts. The index of a shard is the file of that name."""
    files = Files(folder)

    def batch(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"lang": pa.string(), "word": pa.string(), "n": pa.int64(), "part": pa.int32(), "shard": pa.int64(), "block": pa.binary()}
        return pa.RecordBatch.from_arrays([columns[c].cast(kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

    def flushed(seq: Sequence, out: list[pa.RecordBatch]) -> Sequence:
        tokens, names, rest = seq.cut()
        fresh = Sequence()
        for where, word in rest:
            fresh.add(where, [word])
        if len(tokens):
            index = index_of(tokens, len(names), depth) | {"hash": word_hashes(names, salt)}
            shard = uuid.uuid4().int >> 65
            kept_index(files, shard, index)
            n = np.diff(index["first"][1:])
            used = np.flatnonzero(n)  # words behind the last separator aren't there
            out.append(batch(lang=pa.array([names[i][0] for i in used.tolist()], pa.string()), word=pa.array([names[i][1] for i in used.tolist()], pa.binary()), n=pa.array(n[used])))
            cell, _, _, count, _, _ = pairs_of(index)
            sent = dealt(part_of(cell, parts), cell, count.astype(np.uint32))
            out.append(batch(part=sent.column(0), shard=pa.array(np.full(sent.num_rows, shard)), block=sent.column(1)))
        return fresh

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, out = Sequence(), []
        for b in batches:
            for where, body in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for part in slices(body.as_py() or b""):
                    seq.add(where, tokens_of(part))
                    if seq.size >= SHARD_WORDS:
                        seq = flushed(seq, out)
                        yield from out
                        out.clear()
                seq.end_text()
        flushed(seq, out)
        yield from out

    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(none)), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).mapInArrow(run, BUILT)


def often(built: DataFrame, least: int) -> DataFrame:
    """``(shard, part, bits)``: for each pair of a shard's block, whether its cell occurs at least ``least`` times over all shards."""

    def total(table: pa.Table) -> pa.Table:
        cells, counts = zip(*[unblock(b) for b in table.column("block").to_pylist()], strict=True)
        sizes, cell = [len(c) for c in cells], np.concatenate(cells)
        order = np.argsort(cell, kind="stable")
        heads = heads_of(cell[order])
        f = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), heads)
        flag = np.empty(len(cell), bool)
        flag[order] = np.repeat(f >= least, np.diff(np.r_[heads, len(cell)]))
        bits = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(sizes)[:-1])]
        return pa.table({"shard": table.column("shard"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return built.select("part", "shard", "block").groupBy("part").applyInArrow(total, "shard bigint, part int, bits binary")


def first_level(flags: DataFrame, folder: str, parts: int) -> DataFrame:
    """``(part, shard, block)``: the pairs of each shard whose cells occur often, for ``summed_level``."""
    files = Files(folder)

    def extend(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        index = index_from(files, shard)
        cell, one, two, count, smaller, place = pairs_of(index)
        own = part_of(cell, parts)
        keep = np.zeros(len(cell), bool)
        for part, bits in zip(table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True):
            a, b = np.searchsorted(own, [part, part + 1])
            keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a))
        one, two, count, smaller, place = (x[keep] for x in (one, two, count, smaller, place))
        h = index["hash"].view(np.int64)
        return entries(shard, parts, h[one], h[two], count, index["first"][1:][one] + smaller, steps_back(index["after"])[place])

    return flags.groupBy("shard").applyInArrow(extend, "part int, shard bigint, block binary")


def entries(shard: int, parts: int, prefix: np.ndarray, suffix: np.ndarray, *numbers: np.ndarray) -> pa.Table:
    """A shard's phrases as a block for each part: prefix, suffix, count and both starts."""
    part = (mixed(prefix.view(np.uint64) * np.uint64(3) + mixed(suffix.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((suffix, prefix))
    out = dealt(part[order], prefix[order], suffix[order], *(x[order].astype(np.int32) for x in numbers))
    return pa.table({"part": out.column(0), "shard": pa.array(np.full(out.num_rows, shard)), "block": out.column(1)})


def next_level(replies: DataFrame, folder: str, parts: int) -> DataFrame:
    """From the frequent phrases of each shard ``(shard, block)``, those one word longer, as ``first_level`` gives them."""
    files = Files(folder)

    def extend(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        gram, left, right, n = (np.concatenate(c).astype(np.int64) for c in zip(*map(unblock, table.column("block").to_pylist()), strict=True))
        prefix, suffix, count, left, right = longer(index_from(files, shard), gram, left, right, n)
        return entries(shard, parts, prefix, suffix, count, left, right)

    return replies.groupBy("shard").applyInArrow(extend, "part int, shard bigint, block binary")


def summed_level(found: DataFrame, least: int) -> DataFrame:
    """Exact sums over all shards of the phrases of one level.

    Rows with a null shard are the frequent phrases ``(gram, prefix, suffix, f)``; the others ``(shard, block)`` tell each shard which
    of its own are frequent, and their intervals.
    """

    def total(table: pa.Table) -> pa.Table:
        part, shards = table.column("part")[0].as_py(), table.column("shard").to_numpy()
        blocks = [unblock(b) for b in table.column("block").to_pylist()]
        prefix, suffix, n, left, right = (np.concatenate(c) for c in zip(*blocks, strict=True))
        shard = np.repeat(shards, [len(b[0]) for b in blocks])
        order = np.lexsort((suffix, prefix))
        prefix, suffix, n, left, right, shard = (x[order] for x in (prefix, suffix, n, left, right, shard))
        heads = heads_of(prefix, suffix)
        size = np.diff(np.r_[heads, len(n)])
        f = np.add.reduceat(n.astype(np.int64), heads)
        frequent = f >= least
        gram = (np.int64(part) << np.int64(32)) + np.cumsum(frequent) - 1
        mine = np.flatnonzero(np.repeat(frequent, size))
        own, heads, gram, f = np.repeat(gram, size)[mine], heads[frequent], gram[frequent], f[frequent]
        by = mine[order := np.argsort(shard[mine], kind="stable")]
        own, cuts = own[order], heads_of(shard[by])
        replies = [block(own[i:j], left[by[i:j]], right[by[i:j]], n[by[i:j]]) for i, j in zip(cuts, np.r_[cuts, len(by)][1:], strict=True)]
        both = lambda a, b, kind=pa.int64(): pa.concat_arrays([pa.nulls(len(heads), kind) if a is None else pa.array(a, kind), pa.nulls(len(cuts), kind) if b is None else pa.array(b, kind)])
        return pa.table({"shard": both(None, shard[by[cuts]]), "gram": both(gram, None), "prefix": both(prefix[heads], None), "suffix": both(suffix[heads], None), "f": both(f, None), "block": both(None, replies, pa.binary())})

    return found.groupBy("part").applyInArrow(total, "shard bigint, gram bigint, prefix bigint, suffix bigint, f bigint, block binary")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, depth: int = 5, none: str = "und", salt: str = "") -> tuple[DataFrame, list[DataFrame]]:
    """Occurrences of all words of each language ``(lang, n)``, and for each number of words from 1 to ``depth`` the phrases that
    occur at least ``least`` times: ``(gram, lang, phrase, last, f, prefix, suffix, firsts, lasts)``.

    prefix, suffix: the phrases without the last and without the first word; firsts, lasts: how often the first and the last 1, 2,
    ... words occur. Null texts are empty; a null language is ``none``. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/fm-{uuid.uuid4().hex}"
    kept = Kept(spark)
    chars = docs.agg(F.sum(F.length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-chars // PART_CHARS))
    built = kept.write(build_shards(docs, text, lang, depth, folder, none, parts, salt))
    words = kept.write(built.where("part is null").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = kept.write(words.groupBy("lang").agg(F.sum("f").alias("n")))
    named = words.withColumn("gram", F.xxhash64(F.lit(salt), "lang", "word"))
    if named.groupBy("gram").count().where("count > 1").limit(1).count():  # two words with one id: again, with other ids
        kept.drop_all()
        Files(folder).remove()
        return phrase_counts(docs, text, lang, least, depth, none, f"{salt}+")
    empty = F.array().cast("array<bigint>")
    level = kept.write(named.where(F.col("f") >= least).select("gram", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.lit(None).cast("bigint").alias("prefix"), F.lit(None).cast("bigint").alias("suffix"), empty.alias("firsts"), empty.alias("lasts")))
    found = kept.write(summed_level(first_level(often(built.where("part is not null"), least), folder, parts), least))
    kept.drop(built)
    levels = [level]
    for m in range(2, depth + 1):
        first = level.select(F.col("gram").alias("prefix"), "lang", "phrase", F.array_append("firsts", F.col("f")).alias("firsts"))
        rest = level.select(F.col("gram").alias("suffix"), F.col("last"), F.array_append("lasts", F.col("f")).alias("lasts"))
        joined = found.where("shard is null").select("gram", "prefix", "suffix", "f").join(first, "prefix").join(rest, "suffix")
        level = kept.write(joined.select("gram", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "prefix", "suffix", "firsts", "lasts"))
        levels.append(level)
        if m < depth:
            before = found
            found = kept.write(summed_level(next_level(before.where("shard is not null").select("shard", "block"), folder, parts), least))
            kept.drop(before)
    kept.drop(found)
    Files(folder).remove()
    return totals, levels


def candidates(totals: DataFrame, levels: list[DataFrame], cover: int = 100) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of the phrases of two words and more, those left out that a longer phrase holds.

    A phrase goes if a phrase of one word more around it occurs at least ``cover`` % as often; around it there is then none of
    still more words that would make another go. Arithmetic is in decimals of 38 digits, exact up to 10**12 words.
    """
    out = None
    for m, level in enumerate(levels[1:], 2):
        longer_ = None
        for side in ("prefix", "suffix") if m < len(levels) else ():
            one = levels[m].select(F.col(side).alias("gram"), F.col("f").alias("most"))
            longer_ = one if longer_ is None else longer_.unionByName(one)
        alone = level
        if longer_ is not None:
            around = longer_.groupBy("gram").agg(F.max("most").alias("most"))
            alone = level.join(around, "gram", "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f")))
        exact = lambda c: c.cast("decimal(18,0)")
        over = exact(F.col("f")) * exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)")
        scored = alone.join(totals, "lang").withColumn("over", over.cast("decimal(38,0)"))
        cuts = []
        for k in range(1, m):
            l, r = F.element_at("firsts", k), F.element_at("lasts", m - k)
            scored = scored.withColumn(f"under{k}", (exact(l) * exact(r)).cast("decimal(38,0)"))
            cuts.append(F.struct(F.expr(f"over div under{k}").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        best = F.array_min(F.array(*cuts))
        scored = scored.select("lang", "phrase", F.col("f").alias("a"), best.alias("cut"), "n").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        out = scored if out is None else out.unionByName(scored)
    return out


def top_ranked(rows: DataFrame, by: str, order: list, most: int, name: str = "rank", room: int = 200_000) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank, first found in salted parts, so that no task sees a whole ``by``."""
    salts = rows.count() // room
    while salts > 1:
        part = Window.partitionBy(by, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn(name, F.row_number().over(part)).where(F.col(name) <= most).drop(name)
        salts = salts * most // room
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, depth: int = 5, most: int = 2000, cover: int = 100) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best collocations of each language.

    Phrases of 2 to ``depth`` words inside pieces (texts are split at ``.,;:!?`` and line ends) that occur ``a`` >= ``least`` times.
    Cut after k words, the first part occurs l and the rest r times; the cut with the least floor(1000 a n / (l r)) counts, the
    earliest of equals. An empty table gives no rows; extra columns are not read.
    """
    totals, levels = phrase_counts(docs, text, lang, least, depth)
    kept = Kept(docs.sparkSession)
    found = kept.write(candidates(totals, levels, cover))
    return top_ranked(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
