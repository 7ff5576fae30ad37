"""Text functions as Spark columns. Lengths count code points; white space is Unicode's where the name says strip."""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column, functions as F

from weftline.functions.arrays import blocks, let

#: Characters that end a line.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Unicode's white space, as ``(?U)\\s`` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Sentence and clause marks.
SENTENCE_END, CLAUSE_END = "。！？!?；;", "，,、：:"
#: HTML elements whose text is hidden, and those that break lines when they open and when they close.
HIDDEN = ("script", "style", "noscript", "template")
BREAK_OPEN, BREAK_CLOSE = "p|div|li|br|h1|h2|h3|h4|h5|h6", "p|div|li"
#: Commonest entities, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: Words that mark a variant of a file, alone between separators or anywhere.
VARIANT = r"(?i)(^|[\s._-])(final|old|new|draft|rev\d*|x)([\s._-]|$)|改|新版|旧版|终稿|定稿"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white texts."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def normalize_text(c: Column) -> Column:
    """Lines stripped, runs of blanks one space, runs of empty lines one, none at the ends."""
    lines = F.regexp_replace(F.regexp_replace(c, LINE_BREAKS, "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"(?U)[^\S\n]*\n[^\S\n]*", "\n"), "\n{3,}", "\n\n"))


def bounded_text(c: Column, most: int | None = 250_000) -> Column:
    """Struct of the normalised text's first ``most`` code points (None: all), right-stripped, and whether it was cut."""
    if most is None:
        return F.struct(normalize_text(c).alias("text"), F.lit(False).alias("truncated"))

    def bounded(whole: Column) -> Column:
        cut = F.length(whole) > most
        return F.struct(F.when(cut, F.rtrim(F.substring(whole, 1, most), F.lit(WHITE))).otherwise(whole).alias("text"), cut.alias("truncated"))

    return let(normalize_text(c), bounded)


def unescaped(c: Column) -> Column:
    """Named and numeric character references decoded once, by HTML's rules: older names need no semicolon, numbers 128 to 159 are
    Windows-1252, impossible code points are U+FFFD, control characters and non-characters nothing, and unknown names stay. A name that runs on into other letters without a
    semicolon stays, too."""
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    low = F.from_json(F.lit(json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160)})), "map<string,string>")

    def decoded(token: Column) -> Column:
        digits = F.regexp_extract(token, "^&#([0-9]{1,9});?$", 1)
        hexes = F.regexp_extract(token, "(?i)^&#x0*([0-9a-f]{1,7});?$", 1)
        number = F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999")).cast("long"), F.conv(F.nullif(hexes, F.lit("")), 16, 10).cast("long"))
        wrong = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        none = (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE) | number.between(0xFDD0, 0xFDEF)
        numeric = F.when(wrong, F.lit("\ufffd")).when(none, F.lit("")).otherwise(F.coalesce(F.try_element_at(low, number.cast("string")), point))
        return F.when(number.isNotNull(), numeric).otherwise(F.coalesce(F.try_element_at(names, F.substring(token, 2, 64)), token))

    tokens = F.regexp_extract_all(c, F.lit(r"(?s)&(?:#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"), F.lit(0))
    parts = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("&")) & (F.length(t) > 1), decoded(t)).otherwise(t))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def with_entities(c: Column, entities: dict[str, str]) -> Column:
    """These references, as they are written and no others, replaced in turn; the ampersand's comes last, so that none is decoded twice."""
    for entity, text in entities.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def html_visible_text(c: Column, entities: dict[str, str] | None = None) -> Column:
    """Text that a reader of the page sees: no scripts, styles or comments; block elements break lines; other tags part words.

    References are decoded by HTML's rules (:func:`unescaped`), or only those of ``entities``, if given.
    """
    attributes = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""  # possessive, so that long tags need no stack; no shorter run could end at a >
    out = c
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b{attributes}>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|(?i)<!doctype[^>]*>", " ")
    out = F.regexp_replace(out, rf"(?i)<(?:{BREAK_OPEN})\b{attributes}>|</(?:{BREAK_CLOSE})\s*>", " \n ")
    out = F.regexp_replace(out, rf"</?[A-Za-z]{attributes}>", " ")
    return normalize_text(unescaped(out) if entities is None else with_entities(out, entities))


def speech_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentence_units(c: Column) -> Column:
    """Array of sentences: a unit ends after a sentence mark or at a line's end."""
    marked = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), rf"([{SENTENCE_END}])(?U)\s*", "$1\n")
    return _stripped(F.split(marked, "\n+"))


def packed(units: Column, most: int) -> Column:
    """Units joined, in order and without separator, as long as a run's speech length stays within ``most``.

    Every unit is measured once; what is folded is numbers, in blocks: the length of the open run, and where runs begin.
    """
    none = F.array().cast("array<int>")

    def step(acc: Column, n: Column) -> Column:
        over = (acc["size"] > 0) & (acc["size"] + n > most)
        return F.struct(F.when(over, n).otherwise(acc["size"] + n).alias("size"), (acc["at"] + 1).alias("at"), F.when(over, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    def block(acc: Column, lengths: Column) -> Column:
        inner = F.aggregate(lengths, F.struct(acc["size"].alias("size"), acc["at"].alias("at"), none.alias("cuts")), step)
        return let(inner, lambda i: F.struct(i["size"].alias("size"), i["at"].alias("at"), F.concat(acc["cuts"], F.array(i["cuts"])).alias("cuts")))

    def joined(units: Column) -> Column:
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("cuts"))
        cuts = F.aggregate(blocks(F.transform(units, speech_length)), start, block, lambda acc: F.flatten(acc["cuts"]))
        ends = lambda c: F.zip_with(F.concat(F.array(F.lit(0)), c), F.concat(c, F.array(F.size(units))), lambda i, j: F.array_join(F.slice(units, i + 1, j - i), ""))
        return F.when(F.size(units) == 0, F.array().cast("array<string>")).otherwise(let(cuts, ends))

    return let(units, joined)


def split_oversized(units: Column, most: int) -> Column:
    """Units longer than ``most`` cut at clause marks and packed again; a clause still too long is chopped without its white space."""

    fits = lambda x: (F.length(x) <= most) | (speech_length(x) <= most)  # noqa: E731  most texts are short with their white space, too

    def chopped(part: Column) -> Column:
        bare = F.regexp_replace(part, r"(?U)\s+", "")
        return let(bare, lambda b: F.transform(F.sequence(F.lit(1), F.length(b), F.lit(most)), lambda i: F.substring(b, i, F.lit(most))))

    def one(unit: Column) -> Column:
        clauses = _stripped(F.split(F.regexp_replace(unit, rf"([{CLAUSE_END}])(?U)\s*", "$1\u0000"), "\u0000"))
        cut = F.flatten(F.transform(packed(clauses, most), lambda p: F.when(fits(p), F.array(p)).otherwise(chopped(p))))
        return F.when(fits(unit), F.array(unit)).otherwise(cut)

    return F.flatten(F.transform(units, one))


def plan_segments(c: Column, target: int, most: int) -> Column:
    """Segments of at most ``target`` speech characters where units allow it; a unit between target and most stands alone."""
    return packed(split_oversized(sentence_units(c), most), target)


def variant_flag(path: Column) -> Column:
    """Whether a path under its root looks like a variant: its stem, or any part of it, has a variant mark."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?s)(.)\.[^.]*$", "$1")
    return stem.rlike(VARIANT) | F.exists(F.split(path, "/"), lambda p: p.rlike(VARIANT))


def redact(c: Column, pattern: str, mark: str = "[REDACTED]") -> Column:
    return F.regexp_replace(c, pattern, mark)


def sensitive_keys(json_text: Column) -> Column:
    """Whether a JSON object's key names an access key, authorisation, token or secret; null where the text is no object."""
    return F.exists(F.json_object_keys(json_text), lambda k: k.rlike("(?i)api.?key|authorization|token|secret"))


def natural_key(c: Column) -> Column:
    """Sort key: digit runs compare as numbers, however long, and after texts; texts in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: p.rlike("^[0-9]")
    number = lambda p: F.regexp_replace(p, "^0+", "")  # noqa: E731  by its length, then by its digits
    return F.transform(parts, lambda p: F.struct(digits(p).cast("int").alias("is_number"), F.when(digits(p), F.length(number(p))).otherwise(0).alias("size"), F.when(digits(p), number(p)).otherwise(p).alias("text")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def material_id(digest: Column, root: Column, path: Column, size: Column | None = None, modified_at: Column | None = None) -> Column:
    """``m-`` with 16 digits of the content's hash and 8 of the hash of where it lies. Where there is no hash, ``u-`` with 24 digits
    of the hash of where it lies, its size and its time in nanoseconds (as exact as the file system's time), as far as given."""
    where = F.concat_ws(":", root.cast("string"), path.cast("string"))
    facts = [where] + ([size.cast("string")] if size is not None else []) + ([(F.unix_micros(modified_at) * 1000).cast("string")] if modified_at is not None else [])
    place = F.substring(F.sha2(where, 256), 1, 8)
    return F.when(digest.isNull(), F.concat(F.lit("u-"), F.substring(F.sha2(F.concat_ws(":", *facts), 256), 1, 24))).otherwise(F.concat(F.lit("m-"), F.substring(digest, 1, 16), F.lit("-"), place))


def category_of(extension: Column) -> Column:
    """Kind of a file by its extension, ``unsupported`` by default."""
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(extension)), F.lit("unsupported"))


#: Kinds of files.
CATEGORIES = {
    ".pdf": "document", ".docx": "document", ".pptx": "document", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".gif": "image",
    ".txt": "text", ".md": "text", ".html": "text", ".htm": "text", ".wav": "audio", ".mp3": "audio", ".m4a": "audio", ".mp4": "video", ".mov": "video", ".webm": "video",
}


#: First bytes (hexadecimal), bytes at the ninth place if they matter, extension if it matters, type.
MAGIC = [
    ("89504E470D0A1A0A", "", "", "image/png"), ("FFD8FF", "", "", "image/jpeg"), ("474946383761", "", "", "image/gif"), ("474946383961", "", "", "image/gif"),
    ("52494646", "57454250", "", "image/webp"), ("52494646", "57415645", "", "audio/wav"), ("255044462D", "", "", "application/pdf"), ("494433", "", "", "audio/mpeg"),
    ("FFFB", "", "", "audio/mpeg"), ("FFF3", "", "", "audio/mpeg"), ("FFF2", "", "", "audio/mpeg"),
    ("504B0304", "", ".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("504B0304", "", ".pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
]
#: Types by extension, for contents that no first bytes tell.
TYPES = {".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".mp4": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}


def sniff_mime(head: Column, extension: Column) -> Column:
    """Type by the first bytes, or else by the extension."""
    raw = lambda digits: F.unhex(F.lit(digits))
    guesses = [F.when(F.startswith(head, raw(first)) & (F.substring(head, 9, 4) == raw(ninth) if ninth else F.lit(True)) & (F.lower(extension) == ext if ext else F.lit(True)), kind) for first, ninth, ext, kind in MAGIC]
    return F.coalesce(*guesses, F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.lower(extension)), F.lit("application/octet-stream"))


def image_dims(content: Column, mime: Column) -> Column:
    """Width and height of PNG (big-endian) and GIF (little-endian) from their fixed headers; null for other types."""
    number = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    byte = lambda i: F.substring(content, i, 1)
    png = F.struct(number(F.substring(content, 17, 4)).alias("width"), number(F.substring(content, 21, 4)).alias("height"))
    gif = F.struct(number(F.concat(byte(8), byte(7))).alias("width"), number(F.concat(byte(10), byte(9))).alias("height"))
    return F.when((mime == "image/png") & (F.length(content) >= 24), png).when((mime == "image/gif") & (F.length(content) >= 10), gif)


def xml_paragraphs(xml: Column, paragraph: str = "p", leaf: str = "t") -> Column:
    """Array of the texts of an XML part's paragraphs, by whatever namespace prefix they have: each one's ``leaf`` elements joined and
    stripped, empty ones left out. The XML isn't validated; a paragraph inside another ends the outer one's text."""
    tag = r"<(?:[\w.-]+:)?"
    ends = F.regexp_replace(xml, rf"{tag}{paragraph}(?:\s[^>]*)?>|</(?:[\w.-]+:)?{paragraph}\s*>", "\u0000")
    leaves = lambda part: F.regexp_extract_all(part, F.lit(rf"{tag}{leaf}(?:\s(?:[^>]*[^>/])?)?>([^<]*)</"), F.lit(1))
    return _stripped(F.transform(F.split(ends, "\u0000"), lambda part: unescaped(F.array_join(leaves(part), ""))))


def xml_leaf_text(xml: Column, paragraph: str = "p", leaf: str = "t") -> Column:
    """The paragraphs of an XML part, one a line; the size of :func:`xml_paragraphs` counts them."""
    return F.array_join(xml_paragraphs(xml, paragraph, leaf), "\n")
