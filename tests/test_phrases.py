"""Rule tables for Chinese copy."""

from weftline.operators import phrases as P, rules as R


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_source_talk(spark):
    lines = docs(spark, "开头\n根据用户提供的素材，素材中提到结果。", "从这份素材中可以看出变化\n检索结果表明，原始素材给出的数字", "素材中显示", "门店的数据在三月上升。", None, "")
    found = sorted((r.doc_id, r.line, r.column, r.rule, r["match"]) for r in R.lint(lines, P.SOURCE_TALK).collect())
    assert found == [
        (0, 2, 1, "provided-material", "根据用户提供的素材"), (0, 2, 11, "material-says", "素材中提到"),
        (1, 1, 1, "material-shows", "从这份素材中可以看出"), (1, 2, 1, "research-shows", "检索结果表明"), (1, 2, 8, "generic-material-attribution", "原始素材给出的"),
        (2, 1, 1, "material-says", "素材中显示"),
    ]


def test_every_phrase_counts_once(spark):
    each = [(c, p) for c, phrases in P.PHRASES.items() for p in phrases]
    rows = docs(spark, *[p.replace("…", "甲") for _, p in each])
    got = {(r.doc_id, r.category): r.hits for r in R.category_counts(rows, P.phrase_rules()).collect()}
    assert all(got[i, c] == 1 for i, (c, _) in enumerate(each)) and len(each) == 43
    long = docs(spark, "众所周知。众所周知，赋能闭环。", "不仅快。更好", "清楚的事实")
    assert {(r.doc_id, r.category, r.hits) for r in R.category_counts(long, P.phrase_rules()).collect()} == {(0, "opener", 2), (0, "vague-value", 2)}
    assert {r.hits for r in R.category_counts(docs(spark, "推进闭环"), P.office_rules()).collect()} == {2}


def test_template(spark):
    rows = docs(spark, "看完这本书，我最大的感受是慢。我整理了 4 个判断。普通人最该学的是取舍。", "不是快，而是稳。", "我整理了房间。", "真正拉开差距的，可能不是天赋，而是耐心。")
    got = {r.doc_id: (r.n_signals, r.template_like) for r in R.template_score(rows, P.template_rules()).collect()}
    assert got == {0: (3, True), 1: (1, False), 2: (0, False), 3: (2, False)}
