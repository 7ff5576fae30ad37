"""Rule tables over documents: counts, spans with priorities, and text statistics.

Rules are rows (rule_id, category, pattern, priority, scope). For counts the rules of a category are one alternation, so a
document is read once a category. Many rules are a table of their own: three letters that every match of a rule must hold are its
anchor, a document's pieces of three letters meet the anchors in one intersection of sets, and only the rules so found run. Spans are
found rule by rule, as priority decides between them.
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.arrays import let, sums_before
from weftline.functions.text import LINE_BREAKS, sentence_units

_SPANS = "array<struct<start:int,stop:int,priority:int,rule:string,hit:string>>"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    pattern: str
    priority: int = 0
    scope: str = "any"  # or "first", "last": the text's first or last sentence unit


#: Rules from which on anchors are looked for first.
MANY = 32
#: What ends or begins a run of plain letters in a pattern.
_SPECIAL = set("\\[](){}*+?^$|.")


def literal_runs(pattern: str) -> list[str]:
    """Runs of plain letters that every match of the pattern holds; none where that isn't sure (alternatives, flags)."""
    if "|" in re.sub(r"\\.|\[[^]]*\]|\([^()]*\)", "", pattern) or "(?i" in pattern or pattern.count("(") != pattern.count(")"):
        return []
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c, known = pattern[i], 1
        if c == "\\":
            known, letter = 2, pattern[i + 1 : i + 2]
            if letter in "xuc0NQ":
                return []
            c = letter if letter and not letter.isalnum() else ""
        elif c == "[":
            known, c = len(pattern) - i if "]" not in pattern[i + 2 :] else pattern.index("]", i + 2) - i + 1, ""
        elif c == "{":
            known, c = pattern.find("}", i) - i + 1, ""
        elif c in _SPECIAL:
            depth += (c == "(") - (c == ")")
            c = ""
        after = pattern[i + known : i + known + 1]
        if not c or depth or after in ("*", "?", "{"):
            runs.append(run)
            run = ""
        else:
            run += c
            if after == "+":
                runs.append(run)
                run = ""
        i += known
    return [r for r in [*runs, run] if r]


def anchor_of(pattern: str, common: Mapping[str, int] | None = None) -> str | None:
    """Three letters that every match holds, the rarest by ``common`` if counts are given; None if there are no such."""
    pieces = [r[i : i + 3] for r in literal_runs(pattern) for i in range(len(r) - 2)]
    return min(pieces, key=lambda p: (common or {}).get(p, 0), default=None)


def _places(text: Column) -> Column:
    """The text and its first and last sentence unit."""
    return let(sentence_units(text), lambda u: F.struct(F.try_element_at(u, F.lit(1)).alias("first"), F.try_element_at(u, F.lit(-1)).alias("last")))


def rule_hits(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text", common: Mapping[str, int] | None = None) -> DataFrame:
    """``(key, rule_id, category, hits)`` for rules that a document meets at least once. A text's sentence units are made once.

    common: how often pieces of three letters occur, so that rare ones become anchors; without it a pattern's first piece does.
    """
    scoped = any(r.scope != "any" for r in rules)
    rows = docs.select(key, F.col(text).alias("__any"), *([_places(F.col(text)).alias("__p")] if scoped else []))
    place = lambda scope: {"any": F.col("__any"), "first": F.col("__p.first"), "last": F.col("__p.last")}[scope]
    if len(rules) < MANY:
        count = lambda r: F.coalesce(F.regexp_count(place(r.scope), F.lit(r.pattern)), F.lit(0)).cast("long")
        each = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), count(r).alias("hits")) for r in rules])
        return rows.select(key, F.explode(each).alias("r")).select(key, "r.rule_id", "r.category", "r.hits").where("hits > 0")
    anchors: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        anchors.setdefault(anchor_of(r.pattern, common) or "", []).append(i)
    always = anchors.pop("", [])
    table = F.from_json(F.lit(json.dumps([dataclasses.asdict(r) for r in rules])), "array<struct<rule_id:string,category:string,pattern:string,scope:string>>")
    by_anchor = F.from_json(F.lit(json.dumps(anchors)), "map<string,array<int>>")
    pieces = F.regexp_extract_all("__any", F.lit("(?s)(?=(...))"), F.lit(1))
    met = F.array_intersect(pieces, F.from_json(F.lit(json.dumps(list(anchors))), "array<string>"))
    found = F.concat(F.flatten(F.transform(met, lambda a: by_anchor[a])), F.from_json(F.lit(json.dumps(always)), "array<int>"))
    candidates = rows.where(F.col("__any").isNotNull()).withColumn("__rule", F.explode(found)).withColumn("__rule", F.get(table, F.col("__rule")))
    body = F.when(F.col("__rule.scope") == "any", place("any"))
    for scope in ("first", "last") if scoped else ():
        body = body.when(F.col("__rule.scope") == scope, place(scope))
    hits = F.coalesce(F.regexp_count(body, F.col("__rule.pattern")), F.lit(0)).cast("long")
    return candidates.select(key, "__rule.rule_id", "__rule.category", hits.alias("hits")).where("hits > 0")


def category_counts(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, category, hits)``, hits of the categories' phrases, for those above 0. Phrases must not overlap within a category."""
    names = sorted({r.category for r in rules})
    joint = [Rule(c, c, "|".join(f"(?:{r.pattern})" for r in rules if r.category == c)) for c in names]
    return rule_hits(docs, joint, key, text).select(key, "category", "hits")


def spans(text: Column, rule: Rule) -> Column:
    """All matches of a rule as (start, stop, priority, rule, hit), positions from 0. For patterns without look-around and anchors."""
    none = F.expr(f"cast(array() as {_SPANS})")

    def placed(pairs: Column) -> Column:
        before = sums_before(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint")))
        span = lambda p, at: F.struct((at + F.length(p["gap"])).cast("int").alias("start"), (at + F.length(p["gap"]) + F.length(p["hit"])).cast("int").alias("stop"), F.lit(rule.priority).alias("priority"), F.lit(rule.rule_id).alias("rule"), p["hit"].alias("hit"))
        return F.zip_with(pairs, before, span)

    hits, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    pairs = let(hits, lambda h: F.zip_with(h, F.slice(gaps, F.lit(1), F.size(h)), lambda x, g: F.struct(x.alias("hit"), g.alias("gap"))))
    return F.when(text.rlike(rule.pattern), let(pairs, placed)).otherwise(none)


def lint(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line, column, rule, match)``, from 1. In a line, rules go by priority; a match that overlaps an accepted one is dropped.

    Matches are rows. For each rule in turn a sweep over a line's matches, by where they begin, carries the end of the last accepted
    one forward and the beginning of the next one back, so the work grows with the matches.
    """
    order = sorted(rules, key=lambda r: r.priority)
    lines = docs.where(reduce(Column.__or__, [F.col(text).rlike(r.pattern) for r in rules])).select(F.col(key), F.posexplode(F.split(F.col(text), LINE_BREAKS)).alias("line", "body"))

    def in_turn(turn: int, rule: Rule) -> Column:
        return F.transform(spans(F.col("body"), rule), lambda s: F.struct(F.lit(turn).alias("turn"), s["start"].alias("start"), s["stop"].alias("stop"), s["rule"].alias("rule"), s["hit"].alias("hit")))

    found = F.concat(*[in_turn(i, r) for i, r in enumerate(order)])
    hits = lines.select(key, "line", F.explode(found).alias("s")).select(key, "line", "s.*").withColumn("ok", F.col("turn") == 0)
    order_by = ["start", "stop", "turn"]
    before = Window.partitionBy(key, "line").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    # the same from behind: a frame that ends at the last row would be summed anew for each row
    behind = Window.partitionBy(key, "line").orderBy(*map(F.desc, order_by)).rowsBetween(Window.unboundedPreceding, -1)
    kept = lambda c: F.when(F.col("ok"), F.col(c))
    for i in range(1, len(order)):
        last, following = F.max(kept("stop")).over(before), F.min(kept("start")).over(behind)
        free = (F.coalesce("__last", F.lit(-1)) <= F.col("start")) & (F.coalesce("__next", F.lit(2**31 - 1)) >= F.col("stop"))
        hits = hits.withColumns({"__last": last, "__next": following}).withColumn("ok", F.when(F.col("turn") == i, free).otherwise(F.col("ok"))).drop("__last", "__next")
    return hits.where("ok").select(key, (F.col("line") + 1).alias("line"), (F.col("start") + 1).alias("column"), "rule", F.col("hit").alias("match"))


def template_score(docs: DataFrame, signals: Sequence[Rule], least: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its number of different signals and whether they are enough to look like a template."""
    score = sum((F.when(F.regexp_like(F.col(text), F.lit(s.pattern)), 1).otherwise(0) for s in signals), F.lit(0)).cast("long")
    return docs.select(key, score.alias("n_signals")).withColumn("template_like", F.col("n_signals") >= least)


def word_density(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits of the words, per 1,000 characters and per sentence unit."""
    hits, units = F.regexp_count(F.col(text), F.lit(pattern)), F.size(sentence_units(F.col(text)))
    return docs.select(key, hits.cast("long").alias("hits"), F.round(F.try_divide(hits * 1000.0, F.length(text)), 6).alias("per_thousand"), F.round(F.try_divide(hits * 1.0, units), 6).alias("per_unit"))


def severity(hits: DataFrame, scenario: str, table: Mapping[tuple[str, str], str], default: str = "medium") -> DataFrame:
    """``hits`` with the severity that their category has in the scenario."""
    own = [F.lit(x) for (category, s), level in table.items() if s == scenario for x in (category, level)]
    return hits.withColumn("severity", F.coalesce(F.element_at(F.create_map(*own), F.col("category")) if own else F.lit(None), F.lit(default)))


def pattern_cap(docs: DataFrame, pattern: str, most: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with more matches than ``most``, or with matches in two sentence units in a row."""
    flags = F.transform(sentence_units(F.col(text)), lambda u: F.regexp_like(u, F.lit(pattern)))
    pairs = F.zip_with(flags, F.slice(flags, F.lit(2), F.greatest(F.size(flags) - 1, F.lit(0))), lambda a, b: a & F.coalesce(b, F.lit(False)))
    rows = docs.select(key, F.regexp_count(F.col(text), F.lit(pattern)).cast("long").alias("hits"), F.exists(pairs, lambda x: x).alias("consecutive"))
    return rows.where((F.col("hits") > most) | F.col("consecutive"))


#: Ranges of emoji.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def emoji_stats(docs: DataFrame, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of emoji, whether two stand together, and whether both are within bounds."""
    rows = docs.select(key, F.regexp_count(F.col(text), F.lit(EMOJI)).cast("long").alias("n_emoji"), F.regexp_like(F.col(text), F.lit(EMOJI + r"[\x{FE0F}\x{200D}]*" + EMOJI)).alias("adjacent"))
    return rows.withColumn("ok", (F.col("n_emoji") <= most) & ~F.col("adjacent"))


def style_fingerprint(docs: DataFrame, author: str, top: int = 5, text: str = "text", least_chars: int = 150, connectors: str = "(?!)", words: str = r"\p{L}+") -> DataFrame:
    """Each author's habits: sentence units (number, mean and deviation of lengths), connectors in a unit on average, the most frequent
    words, the words that most often open a unit and the marks that most often end it, and whether the sample is enough.

    words: what a word is; unspaced scripts have words of :func:`word_candidates` instead, as an alternation. Ties go by text.
    """
    units = docs.select(author, F.explode(sentence_units(F.col(text))).alias("u"))
    lengths = units.groupBy(author).agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.length("u")), 4).alias("mean_length"), F.round(F.stddev_samp(F.length("u")), 4).alias("dev_length"), F.round(F.avg(F.regexp_count("u", F.lit(connectors))), 4).alias("connectors"))
    chars = docs.groupBy(author).agg((F.sum(F.length(text)) >= least_chars).alias("confident"))
    out = lengths.join(chars, author)
    found = F.regexp_extract_all(F.lower(text), F.lit(words), F.lit(0))
    opening = F.regexp_extract(F.lower("u"), words, 0)
    for name, rows in (("top_words", docs.select(author, F.explode(found).alias("w"))), ("openings", units.select(author, opening.alias("w")).where("w <> ''")), ("endings", units.select(author, F.substring("u", -1, 1).alias("w")))):
        out = out.join(_most_frequent(rows, author, top).withColumnRenamed("top", name), author, "left")
    return out


def _most_frequent(rows: DataFrame, author: str, top: int) -> DataFrame:
    """``(author, top)``: the most frequent ``w`` of each author, joined by blanks."""
    counted = rows.groupBy(author, "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(author).orderBy(F.desc("n"), "w"))).where(F.col("rank") <= top)
    return ranked.groupBy(author).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), " ").alias("top"))


def word_candidates(docs: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 5.0, freedom: float = 1.0, letters: str = r"\p{IsHan}") -> DataFrame:
    """``(word, n, cohesion, freedom)``: words of a script that puts no blanks between them.

    A run of 2 to ``longest`` letters is a word if it occurs ``least`` times, its parts go together (``cohesion``: by how much its
    probability exceeds that of its two parts by chance, for the cut where that is least) and it stands in many surroundings
    (``freedom``: the smaller entropy, in bits, of its left and right neighbours; the end of a run is a neighbour of its own).
    Counts are partial sums; no text leaves its task.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{letters}+"), F.lit(0))).alias("run")).withColumn("size", F.length("run"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.struct(F.substring(F.col("run"), i, F.lit(n)).alias("w"), F.when(i > 1, F.substring(F.col("run"), i - 1, F.lit(1))).otherwise(F.lit("")).alias("l"), F.substring(F.col("run"), i + n, F.lit(1)).alias("r")))
    none = F.expr("cast(array() as array<struct<w:string,l:string,r:string>>)")
    rows = runs.select(F.explode(F.concat(*[F.when(F.col("size") >= n, gram(n)).otherwise(none) for n in range(1, longest + 1)])).alias("g")).select("g.*")
    pairs = rows.groupBy("w", "l", "r").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.where(F.length("w") == 1).agg(F.sum("n").cast("double").alias("total"))

    def entropy(side: str) -> DataFrame:
        sided = pairs.groupBy("w", side).agg(F.sum("n").alias("n"))
        bits = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")
        return sided.groupBy("w").agg(bits.alias(f"{side}_bits"))

    several = counts.where((F.length("w") > 1) & (F.col("n") >= least))
    cuts = several.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k")).select("w", "n", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    part = lambda side: counts.select(F.col("w").alias(side), F.col("n").alias(f"{side}_n"))
    held = cuts.join(part("a"), "a").join(part("b"), "b").withColumn("total", total.scalar()).groupBy("w").agg(F.first("n").alias("n"), F.min(F.col("n") * F.col("total") / (F.col("a_n") * F.col("b_n"))).alias("cohesion"))
    out = held.where(F.col("cohesion") >= cohesion).join(entropy("l"), "w").join(entropy("r"), "w").withColumn("freedom", F.least("l_bits", "r_bits"))
    return out.where(F.col("freedom") >= freedom).select(F.col("w").alias("word"), "n", F.round("cohesion", 4).alias("cohesion"), F.round("freedom", 4).alias("freedom"))


def drift(pairs: DataFrame, pattern: str, before: str, after: str, key: str) -> DataFrame:
    """Pairs of texts of which one has a token the other lacks: ``lost`` and ``added``, sorted."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)))
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), " ")
    return pairs.select(key, text(found(before), found(after)).alias("lost"), text(found(after), found(before)).alias("added")).where("lost <> '' or added <> ''")
