"""Text functions on inline rows, Chinese ones among them, against plain Python."""

import re

import pytest
from pyspark.sql import Row, functions as F

from weftline.functions import text as T
from weftline.operators import rules as R


def value(spark, column, **cells):
    return spark.createDataFrame([Row(**cells)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, expected", [
    ("  a \t b \r\n\r\n\r\n  c　\n", "a b\n\nc"), ("", ""), ("\n\n", ""), ("　全角　\n", "全角"), ("a\x0bb", "a\nb"), ("x\u2028y", "x\ny"),
])
def test_normalize(spark, text, expected):
    assert value(spark, T.normalize_text(F.col("t")), t=text) == expected


def test_bounded(spark):
    got = value(spark, T.bounded_text(F.col("t"), 4), t="ab  cd")
    assert (got.text, got.truncated) == ("ab c", True)
    got = value(spark, T.bounded_text(F.col("t"), 3), t="ab cd")
    assert (got.text, got.truncated) == ("ab", True)


def test_speech_length_counts_no_wide_space(spark):
    assert value(spark, T.speech_length(F.col("t")), t="你　好 a\n") == 3


@pytest.mark.parametrize("text, units", [("今天。明天！后天？好；", ["今天。", "明天！", "后天？", "好；"]), ("one!? two\r\nthree. four", ["one!", "?", "two", "three. four"]), (" ", [])])
def test_sentence_units(spark, text, units):
    assert value(spark, T.sentence_units(F.col("t")), t=text) == units


def python_segments(text, target, most):
    def n(x):
        return len(re.sub(r"\s+", "", x))

    def pack(parts, limit):
        out, cur = [], ""
        for p in parts:
            if cur and n(cur + p) > limit:
                out.append(cur)
                cur = p
            else:
                cur += p
        return out + [cur] * bool(cur)

    units = []
    for u in (x.strip() for x in re.split(r"\n+", re.sub(r"([。！？!?；;])\s*", r"\1\n", re.sub(r"\r\n?", "\n", text)))):
        if not u:
            continue
        if n(u) <= most:
            units.append(u)
            continue
        for p in pack([c.strip() for c in re.sub(r"([，,、：:])\s*", "\\1\0", u).split("\0") if c.strip()], most):
            bare = re.sub(r"\s+", "", p)
            units += [p] if n(p) <= most else [bare[i : i + most] for i in range(0, len(bare), most)]
    return pack(units, target)


@pytest.mark.parametrize("target, most", [(10, 15), (3, 4), (120, 180)])
def test_segments(spark, target, most):
    for text in ["今天天气很好，我们去公园。明天，后天，大后天都下雨！" * 3, "a b c d e f g h i j k l m n o p q r s t u v", "one, two, three: four; five! six", ""]:
        assert value(spark, T.plan_segments(F.col("t"), target, most), t=text) == python_segments(text, target, most)


def test_html(spark):
    page = "<html><head><style>p{color:red}</style><script>var t='</p>';</script></head><body><h1>A &amp; B</h1><p title='>'>one <b>two</b></p><!-- no --><div>three</div></body></html>"
    assert value(spark, T.html_visible_text(F.col("t")), t=page) == "A & B\none two\n\nthree" or value(spark, T.html_visible_text(F.col("t")), t=page).split() == "A & B one two three".split()


@pytest.mark.parametrize("path, flag", [("a/report_final.pdf", True), ("old/report.pdf", True), ("a/finally.pdf", False), ("a/新版.pdf", True), ("a/rev12 x.pdf", True), ("a/b.pdf", False)])
def test_variant(spark, path, flag):
    assert value(spark, T.variant_flag(F.col("p")), p=path) is flag


def test_natural_order(spark):
    names = ["p10", "P3", "p2", "2a", "a", "p2b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a", "p2", "p2b", "P3", "p10", "2a"]


def test_bytes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (20).to_bytes(2, "little") + b"\0" * 20
    for content, ext, mime, size in ((png, ".png", "image/png", (640, 480)), (gif, ".gif", "image/gif", (300, 20)), (b"PK\3\4....", ".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None), (b"plain", ".md", "text/markdown", None), (b"?", ".zzz", "application/octet-stream", None), (b"RIFF\0\0\0\0WEBPVP8 ", ".webp", "image/webp", None)):
        df = spark.createDataFrame([(bytearray(content), ext)], "c binary, e string").select(T.sniff_mime(F.col("c"), F.col("e")).alias("m"), "c")
        row = df.select("m", T.image_dims(F.col("c"), F.col("m")).alias("d")).first()
        assert row.m == mime
        assert (row.d and tuple(row.d)) == size


def test_xml(spark):
    xml = '<w:p xmlns:w="urn:w"><w:r><w:t>Hello</w:t></w:r><w:r><w:t> world</w:t></w:r></w:p>'
    assert value(spark, T.xml_leaf_text(F.col("x")), x=xml) == "Hello world"


def test_blank_and_redaction(spark):
    assert value(spark, T.is_blank(F.col("t")), t="　\t ") is True
    assert value(spark, T.redact(F.col("t"), "wx_[A-Za-z0-9]+"), t="key wx_abc123.") == "key [REDACTED]."
    assert value(spark, T.sensitive_keys(F.col("t")), t='{"API-Key": 1}') is True


def test_lint_overlap_and_priority(spark):
    rules = [R.Rule("long", "l", "素材中的原始说法", 1), R.Rule("short", "l", "素材", 2)]
    docs = spark.createDataFrame([(1, "前言\n素材中的原始说法，以及素材"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.line, r.column, r.rule) for r in R.lint(docs, rules).orderBy("column").collect()]
    assert got == [(2, 1, "long"), (2, 12, "short")]


def test_scopes_and_caps(spark):
    docs = spark.createDataFrame([(1, "众所周知，今天很好。明天也好。让我们共同期待"), (2, "今天，众所周知。")], "doc_id long, text string")
    rules = [R.Rule("open", "opener", "众所周知", scope="first"), R.Rule("end", "ending", "让我们共同期待", scope="last")]
    assert {(r.doc_id, r.rule_id) for r in R.rule_hits(docs, rules).collect()} == {(1, "open"), (1, "end"), (2, "open")}
    capped = spark.createDataFrame([(1, "这不是终点，是起点。"), (2, "不是甲，是乙。不是丙，是丁。"), (3, "")], "doc_id long, text string")
    assert [r.doc_id for r in R.pattern_cap(capped, "不是[^，。]*，是").collect()] == [2]


def test_emoji(spark):
    docs = spark.createDataFrame([(1, "好😀"), (2, "好😀😀"), (3, "😀a😀b😀"), (4, "无")], "doc_id long, text string")
    got = {r.doc_id: (r.n_emoji, r.adjacent, r.ok) for r in R.emoji_stats(docs).collect()}
    assert got == {1: (1, False, True), 2: (2, True, False), 3: (3, False, False), 4: (0, False, True)}


def test_paragraphs(spark):
    xml = '<w:body><w:p><w:r><w:t>one</w:t><w:t xml:space="preserve"> &amp; &#x4e8c;</w:t></w:r></w:p><w:p/><w:p w:id="1"><w:tab/><w:t a="b"/></w:p><w:p><w:t>two</w:t></w:p></w:body>'
    assert value(spark, T.xml_leaf_text(F.col("x")), x=xml) == "one & 二\ntwo"
    assert value(spark, F.size(T.xml_paragraphs(F.col("x"))), x=xml) == 2


def test_references(spark):
    import html

    for text in ("caf&eacute; &#233; &#x41; &mdash;", "&amp;lt; a&b &; &nosuch; &copy 2", "&#128; &#x99; &#0; &#xD800; &#x110000; &#1114111;", "&#128512;", "no", "", "&&amp;&"):
        assert value(spark, T.unescaped(F.col("t")), t=text) == html.unescape(text), text
    assert spark.sql("select cast(null as string) as t").select(T.unescaped(F.col("t")).alias("o")).first().o is None
