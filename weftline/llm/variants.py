"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced letter makes one of the other. The shorter word (either, if they are as
long) contributes two disjoint chunks, its halves; the other contributes its grams of those sizes at every place where a half can
lie, which is its own place or one further. One edit leaves one of the two chunks whole: the first where it was, or the last
moved by the difference of lengths. So near words meet at a chunk, and every pair that meets is verified.

Words made of few syllables share halves by the thousand. So a half is never a key alone: the other half, which then holds the
edit, is cut into two chunks again, one of which is whole for the same reason. A key is thus three quarters of a word (which
quarters, their letters, and both lengths), and what meets at one differs in the last quarter only. A pair is kept at the first of
its keys that both share, so that no pair is counted twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import Kept

#: Fixed value: the letters of words.
LETTER = "[A-Za-zÀ-ÿ]"
#: Different words that a task counts before it sends them on, and the bytes of text that are searched at once.
HELD, SLICE = 200_000, 1 << 20
#: Quarters that each of the four keys of a word is made of: a half, and a quarter of the other half.
KEYS = ((0, 1, 2), (0, 1, 3), (2, 3, 0), (2, 3, 1))


def runs_of(text: str, least: int) -> Iterator[str]:
    """Runs of at least so many letters, A-Z lower-cased, of a long text slice by slice (cut where no run is)."""
    find, letter = re.compile(f"{LETTER}{{{least},}}").findall, re.compile(LETTER)
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and letter.match(text[end]):
            end += 1
        yield from find(text[at:end].encode().lower().decode())
        at = end


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, every: int = 31) -> DataFrame:
    """``(word, n)``: runs of letters and how often they occur over all texts, those of at least ``least_length`` letters.

    A run whose crc32 of ``<key>:<run>`` is divisible by ``every`` loses the letter at crc32 % length, as if mistyped (0: none is).
    A null text has no runs; a null key counts as an empty text.
    """

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Counter(runs_of(body.as_py() or "", least_length))
                begin = zlib.crc32(f"{'' if k is None else k}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), begin)
                    if every and h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    counted = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def quarters(length: Column) -> list[Column]:
    """Where the four quarters of a word of that length begin, and its end: halves first, then the halves of each."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def _keys(length: Column, shift: int, part) -> list[Column]:
    """A text for each of KEYS from its quarters; ``part`` gives a quarter's letters, told also which quarter holds the edit."""
    left_out = [6 - sum(k) for k in KEYS]
    return [F.concat_ws("\u0001", F.lit(str(i)), length.cast("string"), F.lit(str(shift)), *[part(q, edit) for q in sorted(k)]) for i, (k, edit) in enumerate(zip(KEYS, left_out, strict=True))]


def chunk_keys(word: Column, length: Column, shift: int) -> list[Column]:
    """The keys of a word's own chunks, by which it is met by words of ``shift`` letters more."""
    at = quarters(length)
    return _keys(length, shift, lambda q, _: F.substring(word, (at[q] + 1).cast("int"), (at[q + 1] - at[q]).cast("int")))


def gram_keys(word: Column, length: Column, shift: int) -> list[Column]:
    """The keys by which ``word``, of ``length + shift`` letters, meets words of ``length``: its grams behind the edit are read
    ``shift`` further."""
    at = quarters(length)
    return _keys(length, shift, lambda q, edit: F.substring(word, (at[q] + (shift if q > edit else 0) + 1).cast("int"), (at[q + 1] - at[q]).cast("int")))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: near words of ``(word, n)``, each pair both ways; words are unique and not null."""
    sized = words.select("word", "n", F.length("word").alias("len"))
    rows = lambda keys: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(k).alias("key")) for i, k in enumerate(keys)])).alias("k")
    found = None
    for shift in (0, 1):
        chunks = sized.select("word", "n", rows(chunk_keys(F.col("word"), F.col("len"), shift))).select("word", "n", "k.i", "k.key")
        grams = sized.select(F.col("word").alias("near"), F.col("n").alias("near_n"), rows(gram_keys(F.col("word"), F.col("len") - shift, shift))).select("near", "near_n", F.col("k.i").alias("j"), "k.key")
        pairs = chunks.join(grams, "key").where((F.col("i") == F.col("j")) & (F.levenshtein("word", "near", 1) == 1))
        if shift == 0:
            pairs = pairs.where("word < near")
        first = F.lit(len(KEYS))
        for i, (a, b) in reversed(list(enumerate(zip(chunk_keys(F.col("word"), F.length("word"), shift), gram_keys(F.col("near"), F.length("word"), shift), strict=True)))):
            first = F.when(a == b, F.lit(i)).otherwise(first)
        pairs = pairs.where(F.col("i") == first).select("word", "n", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame, kept: Kept) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last word that forms lead to. Every round doubles the steps that are known."""
    star = kept.write(forms.select("word", F.col("form").alias("root")))
    while True:
        on = star.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = kept.write(star.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not longer.where("moved").limit(1).count():
            return star
        kept.drop(star)
        star = longer.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each of ``(word, n)``.

    form: the near word of largest n (the smallest in code-point order, if several), if that is at least ``ratio`` times the word's;
    root: where forms lead in the end, the word itself if it has none. An empty table gives no rows.
    """
    kept = Kept(words.sparkSession)
    words = kept.write(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    named = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    named = kept.write(named.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")))
    kept.drop(words)
    star = roots(named.where("form is not null").select("word", "form"), kept)
    return named.join(star, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_digest(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of at least seven letters that occur twice or more, one run in 31 mistyped on purpose."""
    return spelling_variants(word_counts(docs).where("n >= 2"))
