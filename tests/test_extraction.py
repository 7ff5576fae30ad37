"""Trees of mixed files to extraction records, the decode chain, and limits and failures as data."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions.decoding import decode_text
from weftline.operators import checks, extraction
from weftline.sources.files import manifest, manifest_summary, scan_files
from weftline.sources.trees import list_tree


def plain_decode(raw):
    for encoding in ("utf-8-sig", "gb18030", "utf-16"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue


RAW = [
    b"", "plain ünï 中文".encode(), b"\xef\xbb\xbfmarked", "中文和 ascii €".encode("gb18030"), "四字节: ㆗ 😀 ".encode("gb18030"), "ÿ".encode("utf-16"), "😀 wide ÿ".encode("utf-16-le"), b"\xfe\xff" + "big 中".encode("utf-16-be"),
    b"\xff\xfe" + "low 😀".encode("utf-16-le"), b"\xff", b"\xff\xff\xff", b"\x00\xd8\x41\x00", b"\xff\xfe\x00\xd8", b"\xfe\xff\xdc\x00", b"\x81", b"\xd6\xd0\xff", b"\x80abc", b"\x84\x31\xa5\x30ab", b"\xe3\x32\x9a\x36", b"\xe3\x32\x9a\x35", b"\x90\x30\x81\x30", "汉字".encode("gb18030") * 30_000, b"\xc3\x28",
]


def test_decode_chain_without_settings(spark):
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(RAW)], "i int, c binary")
    got = {r.i: r.t for r in df.select("i", decode_text(F.col("c")).alias("t")).collect()}
    for i, raw in enumerate(RAW):
        assert got[i] == plain_decode(raw), raw[:20]
    assert spark.createDataFrame([(None,)], "c binary").select(decode_text(F.col("c")).alias("t")).first().t is None


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


WORD = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:t> line</w:t></w:r></w:p><w:p/><w:p><w:t>Second &amp; last</w:t></w:p></w:body></w:document>'
SLIDE = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:t>Title {n}</a:t></a:p><a:p><a:t>  body</a:t></a:p></p:sld>'
TREE = {
    "notes.txt": "one  \n\n\n two".encode(), "cn.md": "中文".encode("gb18030"), "bad.txt": b"\xff\xff\xff", "page.html": b"<p>Hi <b>there</b><script>x</script></p>", "blank.htm": b"<p> </p>", "big.txt": b"x" * 5000,
    "report.docx": archive({"word/document.xml": WORD}), "empty.docx": archive({"other.xml": "<a/>"}), "broken.docx": b"PK no", "wrong.docx": archive({"word/document.xml": "<w:p>"}),
    "deck.pptx": archive({"ppt/slides/slide10.xml": SLIDE.format(n=10), "ppt/slides/slide2.xml": SLIDE.format(n=2), "ppt/slides/slide3.xml": "<a/>"}), "large.pptx": archive({"ppt/slides/slide1.xml": SLIDE.format(n="x" * 3000)}),
    "scan.pdf": b"%PDF-1.4", "song.mp3": b"ID3", "film.mp4": b"?", "pic.gif": bytes.fromhex("474946383961") + b"\x05\x00\x07\x00", "photo.jpg": b"\xff\xd8\xff", "odd.xyz": b"??", "copy.txt": "one  \n\n\n two".encode(), ".hidden.txt": b"hidden", "_under/_x.md": b"under",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "notes.txt", root / "link.txt")
    os.symlink(root / "_under", root / "linked")
    return root


def test_tree(spark, tree):
    seen = {r.relative_path: r for r in list_tree(spark, [str(tree)]).collect()}
    assert set(seen) == set(TREE)
    assert seen["big.txt"].bytes == 5000 and seen["_under/_x.md"].depth == 1
    uri = {r.relative_path for r in list_tree(spark, [f"file://{tree}"], exclude=[f"{tree}/_under", f"file://{tree}/big.txt"]).collect()}
    assert uri == set(TREE) - {"_under/_x.md", "big.txt"}
    assert {r.relative_path for r in list_tree(spark, [str(tree)], max_depth=0).collect()} == {n for n in TREE if "/" not in n}
    assert [(r.root_index, r.relative_path, r.bytes) for r in list_tree(spark, [f"{tree}/_under", f"{tree}/big.txt"]).orderBy("root_index").collect()] == [(0, "_x.md", 5), (1, "big.txt", 5000)]
    with pytest.raises(ValueError, match="more than 10 files"):
        list_tree(spark, [str(tree)], max_items=10)
    with pytest.raises(FileNotFoundError):
        list_tree(spark, [f"{tree}/none"])


def test_long_digit_runs(spark, tmp_path):
    names = ["a" + "1" * 45 + ".txt", "a2.txt", "a" + "0" * 50 + "3.txt", "a10.txt", "a.txt"]
    for n in names:
        (tmp_path / n).write_bytes(b"same")
    first = [r.relative_path for r in manifest(scan_files(spark, [str(tmp_path)])).where("not exact_duplicate").collect()]
    assert first == ["a2.txt"]  # a text before a longer one that begins with it, then by the number


def test_records(spark, tree):
    files = scan_files(spark, [str(tree)], max_bytes=1 << 20)
    items = manifest(files)
    summary = manifest_summary(items).first()
    assert (summary.total, summary.supported, summary.unsupported, summary.exact_duplicate_groups) == (len(TREE), len(TREE) - 1, 1, 1)
    assert summary.categories["document"] == 7 and sum(summary.categories.values()) == len(TREE)
    whole = items.join(files.select("root_index", "relative_path", "content"), ["root_index", "relative_path"])
    wanted = extraction.eligible(whole)
    probes = wanted.where("extension = '.mp3'").select("id", F.lit(json.dumps({"format": {"duration": "3.5", "format_name": "mp3"}, "streams": [{"codec_type": "audio"}]})).alias("probe"))
    out = extraction.extract(wanted, probes, most_entry=2000, most_total=2500)
    good, bad = checks.split_quarantine(out)
    rows = {r.relative_path: r for r in good.collect()}
    errors = {r.relative_path: r.error for r in bad.collect()}
    assert set(errors) == {"bad.txt", "big.txt", "empty.docx", "broken.docx", "wrong.docx", "large.pptx", "film.mp4"}
    assert errors["big.txt"].startswith("source is larger") and errors["large.pptx"].startswith("all slides") and "no XML" in errors["wrong.docx"]
    assert set(rows) | set(errors) == set(TREE) - {"odd.xyz", "notes.txt"}  # copy.txt comes first
    text = {n: r.text for n, r in rows.items() if r.text}
    assert text == {"copy.txt": "one\n\ntwo", "cn.md": "中文", "page.html": "Hi there", "report.docx": "First line\nSecond & last", "deck.pptx": "[Slide 2]\nTitle 2 body\n\n[Slide 10]\nTitle 10 body", ".hidden.txt": "hidden", "_under/_x.md": "under"}
    told = {n: (r.status, r.extraction_method, r.review_requirements, r.metadata) for n, r in rows.items() if n not in text or r.metadata}
    assert told == {
        "blank.htm": ("manual-review-required", "html-visible-text", ["visual-inspection-or-ocr"], {}),
        "report.docx": ("extracted", "docx-xml", [], {"paragraphCount": "2"}),
        "deck.pptx": ("extracted", "pptx-xml", [], {"slideCount": "3"}),
        "scan.pdf": ("manual-review-required", "unavailable", ["visual-inspection-or-pdf-extractor"], {}),
        "song.mp3": ("manual-review-required", "ffprobe", ["transcription-or-listening-review"], {"durationSeconds": "3.5", "formatName": "mp3", "streams": '[{"codec_type":"audio"}]'}),
        "pic.gif": ("manual-review-required", "image-metadata", ["visual-inspection"], {"width": "5", "height": "7"}),
        "photo.jpg": ("manual-review-required", "image-metadata", ["visual-inspection"], {}),
    }
    cut = extraction.extract(wanted.where("relative_path = 'copy.txt'"), most_chars=5).first()
    assert (cut.text, cut.truncated, cut.text_characters) == ("one", True, 3)
    counts = {r.status: r.n for r in extraction.extraction_summary(out).collect()}
    assert counts == {"error": 7, "extracted": 7, "manual-review-required": 5}


def test_selection(spark):
    items = spark.createDataFrame([("a", "text", False), ("b", "text", True), ("c", "unsupported", False), ("d", "text", None)], "id string, category string, exact_duplicate boolean")
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("a",)], "id string")
    assert sorted(r.id for r in extraction.eligible(items).collect()) == ["a", "d"]
    assert [r.id for r in extraction.eligible(items, ids).collect()] == ["a"]
    assert [r.id for r in extraction.unknown_selected(items, ids).collect()] == ["x"]
