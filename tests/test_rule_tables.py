"""Many rules by anchors, linear lint, segments by numbers, style habits and words of unspaced scripts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, text as T
from weftline.operators import phrases as P, rules as R


def test_sums_before(spark):
    rows = [(i, [random.Random(i).randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 255, 256, 257, 1000])]
    got = spark.createDataFrame(rows, "i int, a array<bigint>").select("i", arrays.sums_before(F.col("a")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(rows[r.i][1][:k]) for k in range(len(rows[r.i][1]))]


def plain_packed(units, most):
    out, cur = [], ""
    for u in units:
        if cur and len(re.sub(r"\s+", "", cur + u)) > most:
            out.append(cur)
            cur = u
        else:
            cur += u
    return out + [cur] if cur else out


@pytest.mark.parametrize("most", [1, 7, 40])
def test_packed(spark, most):
    rng = random.Random(most)
    rows = [(i, ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 20))).strip() or "x" for _ in range(n)]) for i, n in enumerate([0, 1, 2, 30, 255, 256, 600])]
    got = spark.createDataFrame(rows, "i int, u array<string>").select("i", T.packed(F.col("u"), most).alias("p")).collect()
    for r in got:
        assert r.p == plain_packed(rows[r.i][1], most)


@pytest.mark.parametrize(
    "pattern, runs",
    [("abc", ["abc"]), ("ab*cde?f", ["a", "cd", "f"]), ("(?:x|y)hello(?:z)?", ["hello"]), ("a|bcd", []), (r"1\.5\d+abc", ["1.5", "abc"]), ("[a|b]cde+f", ["cde", "f"]), ("(?i)abc", []), (r"\x41bcd", []), (r"\p{L}abc{2,}d", ["ab", "d"]), ("ab{2}cde", ["a", "cde"]), ("x(?:abc|d)yz.w", ["x", "yz", "w"])],
)
def test_runs_that_every_match_holds(pattern, runs):
    assert R.literal_runs(pattern) == runs


def test_anchors_are_in_every_match():
    for rule in [*P.phrase_rules(), *P.SOURCE_TALK, *P.template_rules()]:
        anchor = R.anchor_of(rule.pattern)
        match = rule.pattern.replace(P.GAP, "甲")
        if anchor and not re.search(r"[\\(\[?]", match):
            assert re.search(rule.pattern, match) and anchor in match


def test_a_thousand_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rules = [R.Rule(f"r{i}", "c", word() + rng.choice(["", "[0-9]+", f" ?{word()}", "|zz"]), scope=rng.choice(["any", "any", "first", "last"])) for i in range(1000)]
    docs = [(i, ". ".join(" ".join(word() + rng.choice(["", "", "7"]) for _ in range(30)) for _ in range(4)) + "!") for i in range(40)] + [(98, None), (99, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.doc_id, r.rule_id): r.hits for r in R.rule_hits(df, rules).collect()}
    units = {r.doc_id: r.u for r in df.select("doc_id", T.sentence_units(F.col("text")).alias("u")).collect()}
    expected = {}
    for i, t in docs:
        for r in rules:
            place = t if r.scope == "any" else (units[i] or [""])[0 if r.scope == "first" else -1]
            if n := len(re.findall(r.pattern, place or "")):
                expected[i, r.rule_id] = n
    assert got == expected
    common = {r["p"]: r["count"] for r in df.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(?=(...))"), F.lit(1))).alias("p")).groupBy("p").count().collect()}
    assert {(r.doc_id, r.rule_id): r.hits for r in R.rule_hits(df, rules, common=common).collect()} == expected
    candidates = R.rule_hits(df, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in candidates


def plain_lint(text, rules):
    out = []
    for k, line in enumerate(re.split(T.LINE_BREAKS, text), 1):
        taken = []
        for r in sorted(rules, key=lambda r: r.priority):
            for m in re.finditer(r.pattern, line):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append((m.start(), m.end()))
                    out.append((k, m.start() + 1, r.rule_id, m.group()))
    return sorted(out)


def test_lint_against_plain(spark):
    rng = random.Random(8)
    rules = [R.Rule("long", "l", "abca+", 1), R.Rule("b", "l", "b+", 3), R.Rule("ca", "l", "ca", 2), R.Rule("tail", "l", "[ab]{2}c", 4)]
    docs = [(i, "".join(rng.choice("aabbcc\n ") for _ in range(rng.randrange(200)))) for i in range(30)]
    got = {}
    for r in R.lint(spark.createDataFrame(docs, "doc_id int, text string"), rules).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.column, r.rule, r["match"]))
    for i, t in docs:
        assert sorted(got.get(i, [])) == plain_lint(t, rules)


def test_lint_grows_with_hits(spark):
    rules = [R.Rule("a", "l", "ab", 1), R.Rule("b", "l", "b ", 2)]
    seconds = []
    for n in (200, 20_000, 80_000):
        df = spark.createDataFrame([(1, "ab cd b " * n)], "doc_id int, text string")
        began = time.time()
        assert R.lint(df, rules).count() == 2 * n
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 10


def test_style_keeps_letters_with_marks(spark):
    df = spark.createDataFrame([("x", "für Größe für naïve. Größe und für! 我们今天")], "who string, text string")
    got = R.style_fingerprint(df, "who", top=3, connectors=r"\bund\b").first()
    assert (got.top_words, got.openings, got.n_units, got.connectors) == ("für größe naïve", "für größe 我们今天", 3, 0.3333) and set(got.endings.split()) == {".", "!", "天"}


def test_chinese_words(spark):
    rng = random.Random(1)
    words = ["我们", "今天", "数据", "人工智能", "学习"]
    text = "。".join("".join(rng.choice([*words, "的", "很", "不", "在"]) for _ in range(12)) for _ in range(150))
    df = spark.createDataFrame([(text,), (None,), ("no letters of that kind",)], "text string")
    got = {r.word: r for r in R.word_candidates(df, least=10, cohesion=5.0, freedom=1.5).collect()}
    assert set(words) <= set(got) and "们今" not in got and "工智" not in got and "的很" not in got
    assert all(r.n == text.count(r.word) for r in got.values())
    style = R.style_fingerprint(df.where("text like '%。%'").withColumn("who", F.lit(1)), "who", words="|".join(sorted(got, key=len, reverse=True))).first()
    assert set(style.top_words.split()) <= set(got)
