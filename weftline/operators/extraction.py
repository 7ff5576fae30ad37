"""From materials to extraction records: text where it can be had, what a person must still look at, and failures as data.

Every material is routed by its extension. Plain texts and pages are decoded, and the text of pages is what a reader sees. Word and
slide files are archives: a task opens each and hands on the XML parts that hold text, within limits, and their paragraphs are found
by expressions. PDF files, media and pictures have no text here; media have what a probe said of them, if it is given.
"""

from __future__ import annotations

import io
import re
import xml.parsers.expat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as T
from weftline.functions.arrays import worked_out
from weftline.functions.decoding import decode_text

#: Extensions by how they are read.
TEXTS, PAGES, MEDIA = (".txt", ".md"), (".html", ".htm"), (".wav", ".mp3", ".m4a", ".mp4", ".mov", ".webm")
#: The parts of archives that hold text.
WORD_PART, SLIDE_PART = "word/document.xml", r"ppt/slides/slide([0-9]+)\.xml"
_PARTS = "array<struct<number:int,xml:string>>"
#: Columns of a record besides the error.
RECORD = ("id", "relative_path", "category", "sha256", "status", "extraction_method", "text", "text_characters", "truncated", "metadata", "review_requirements")


class _Refused(Exception):
    pass


def _xml(archive: zipfile.ZipFile, name: str, most: int | None) -> str:
    if most is not None and archive.getinfo(name).file_size > most:
        raise _Refused(f"{name} is larger than the read limit")
    with archive.open(name) as f:
        raw = f.read(None if most is None else most + 1)
    if most is not None and len(raw) > most:
        raise _Refused(f"{name} is larger than the read limit")
    try:
        xml.parsers.expat.ParserCreate().Parse(raw, True)
    except xml.parsers.expat.ExpatError as e:
        raise _Refused(f"{name} is no XML: {e}") from e
    return raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")


def _parts_of(content: bytes | None, extension: str, most: int | None, most_total: int) -> tuple[list[dict], str | None]:
    """The numbered XML parts of an archive, or why there are none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            if extension == ".docx":
                return [{"number": 0, "xml": _xml(archive, WORD_PART, most)}], None
            slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(SLIDE_PART, n)))
            if sum(archive.getinfo(n).file_size for _, n in slides) > most_total:
                raise _Refused("all slides together are larger than the read limit")
            return [{"number": k, "xml": _xml(archive, n, most)} for k, n in slides], None
    except _Refused as e:
        return [], str(e)
    except (KeyError, zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError) as e:
        return [], f"no {extension[1:]} archive: {e}"


def archive_parts(items: DataFrame, most: int | None = 32 << 20, most_total: int = 128 << 20) -> DataFrame:
    """``items`` (with ``extension`` and ``content``) with ``parts`` and ``error`` in place of ``content``."""
    columns = [c for c in items.columns if c not in ("content", "parts", "error")]
    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in columns)
    kind = pa.list_(pa.struct([("number", pa.int32()), ("xml", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one archive's parts at a time
                row = b.slice(i, 1)
                parts, error = _parts_of(row.column(len(columns))[0].as_py(), row.column(columns.index("extension"))[0].as_py(), most, most_total)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([parts], kind), pa.array([error], pa.string())], names=[*columns, "parts", "error"])

    return items.select(*[f"`{c}`" for c in columns], "content").mapInArrow(run, f"{schema}, parts {_PARTS}, error string")


def _records(rows: DataFrame, method: Column, text: Column, metadata: Column, review: Column, error: Column, most_chars: int | None, unsupported: Column | None = None) -> DataFrame:
    """Records from a row's text (null: none is read), what was learnt of it and what is left to people."""
    rows = rows.withColumns({"__error": error, "__raw": text, "__review": review})
    rows = worked_out(rows, __b=F.when(F.col("__raw").isNotNull(), T.bounded_text(F.col("__raw"), most_chars)))
    has, none = F.col("__b").isNotNull(), F.array().cast("array<string>")
    empty = has & (F.col("__b.text") == "")
    review = F.concat(F.coalesce("__review", none), F.when(empty, F.array(F.lit("visual-inspection-or-ocr"))).otherwise(none))
    not_done = F.lit(False) if unsupported is None else unsupported
    status = F.when(not_done, "unsupported").when(has & ~empty, "extracted").when(has | (F.size(review) > 0), "manual-review-required").otherwise("metadata-only")
    return rows.select(
        "id", "relative_path", "category", "sha256", status.alias("status"), method.alias("extraction_method"), F.nullif(F.col("__b.text"), F.lit("")).alias("text"), F.coalesce(F.length("__b.text"), F.lit(0)).cast("bigint").alias("text_characters"),
        F.coalesce("__b.truncated", F.lit(False)).alias("truncated"), F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("metadata"), review.alias("review_requirements"), F.col("__error").alias("error"),
    )


def eligible(items: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Materials to extract: of a supported category, no exact duplicates, and among the ``selected`` ids (column ``id``), if given."""
    rows = items.where((F.col("category") != "unsupported") & ~F.coalesce(F.col("exact_duplicate"), F.lit(False)))
    return rows if selected is None else rows.join(selected.select("id").distinct(), "id", "left_semi")


def unknown_selected(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids that no material has."""
    return selected.select("id").distinct().join(items.select("id"), "id", "left_anti")


def extract(items: DataFrame, probes: DataFrame | None = None, most_chars: int | None = 250_000, most_entry: int | None = 32 << 20, most_total: int = 128 << 20, entities: dict[str, str] | None = None) -> DataFrame:
    """A record for each material ``(id, relative_path, extension, category, sha256, bytes, content, dimensions)``, with ``error``.

    A row with an error could not be read: its other fields say nothing, and ``checks.split_quarantine`` puts it aside. probes:
    ``(id, probe)``, the JSON that a media probe wrote; media without one are an error. most_chars, most_entry: characters of a text that are
    kept, and bytes of a source above which it is an error, None for no limit. entities: the references that are decoded in pages, by
    default all of HTML's.
    """
    ext = F.lower("extension")
    plain = items.where(ext.isin(*TEXTS, *PAGES))
    large, page = F.lit(False) if most_entry is None else F.col("bytes") > most_entry, ext.isin(*PAGES)
    plain = worked_out(plain, __t=F.when(~large, decode_text(F.col("content"))))
    failed = F.when(large, "source is larger than the read limit").when(F.col("content").isNull(), "content was not read").when(F.col("__t").isNull(), "text encoding is not known")
    none = F.lit(None)
    out = _records(plain, F.when(page, "html-visible-text").otherwise("plain-text"), F.when(page, T.html_visible_text(F.col("__t"), entities)).otherwise(F.col("__t")), none, none, failed, most_chars)

    archives = archive_parts(items.where(ext.isin(".docx", ".pptx")).select("id", "relative_path", "category", "sha256", ext.alias("extension"), "content"), most_entry, most_total)
    word = F.col("extension") == ".docx"
    paragraphs = T.xml_paragraphs(F.get("parts", F.lit(0))["xml"])
    slide = lambda p: T.normalize_text(F.array_join(F.regexp_extract_all(p["xml"], F.lit(r"<(?:[\w.-]+:)?t(?:\s(?:[^>]*[^>/])?)?>([^<]*)</"), F.lit(1)), " "))
    slides = F.transform("parts", lambda p: F.struct(p["number"].alias("n"), T.unescaped(slide(p)).alias("t")))
    shown = F.array_join(F.transform(F.filter(slides, lambda s: s["t"] != ""), lambda s: F.concat(F.lit("[Slide "), s["n"].cast("string"), F.lit("]\n"), s["t"])), "\n\n")
    counted = F.when(word, F.create_map(F.lit("paragraphCount"), F.size(paragraphs).cast("string"))).otherwise(F.create_map(F.lit("slideCount"), F.size("parts").cast("string")))
    body = F.when(F.col("error").isNull(), F.when(word, F.array_join(paragraphs, "\n")).otherwise(shown))
    out = out.unionByName(_records(archives, F.when(word, "docx-xml").otherwise("pptx-xml"), body, F.when(F.col("error").isNull(), counted), none, F.col("error"), most_chars))

    media = items.where(ext.isin(*MEDIA)).drop("content")
    media = media.withColumn("probe", none.cast("string")) if probes is None else media.join(probes.select("id", "probe"), "id", "left")
    facts = F.map_filter(F.create_map(F.lit("durationSeconds"), F.get_json_object("probe", "$.format.duration"), F.lit("formatName"), F.get_json_object("probe", "$.format.format_name"), F.lit("streams"), F.get_json_object("probe", "$.streams")), lambda _, v: v.isNotNull())
    missing = F.when(F.col("probe").isNull(), "media was not probed").when(F.json_object_keys("probe").isNull(), "the probe is no JSON object")
    out = out.unionByName(_records(media, F.lit("ffprobe"), none.cast("string"), facts, F.array(F.lit("transcription-or-listening-review")), missing, most_chars))

    pdf = items.where(ext == ".pdf")
    out = out.unionByName(_records(pdf, F.lit("unavailable"), none.cast("string"), none, F.array(F.lit("visual-inspection-or-pdf-extractor")), none.cast("string"), most_chars))
    rest = items.where(~F.coalesce(ext, F.lit("")).isin(*TEXTS, *PAGES, *MEDIA, ".docx", ".pptx", ".pdf"))
    image = F.coalesce(F.col("category") == "image", F.lit(False))
    size = F.map_filter(F.create_map(F.lit("width"), F.col("dimensions.width").cast("string"), F.lit("height"), F.col("dimensions.height").cast("string")), lambda _, v: v.isNotNull())
    review = F.array(F.when(image, "visual-inspection").otherwise("supported-extractor"))
    return out.unionByName(_records(rest, F.when(image, "image-metadata"), none.cast("string"), F.when(image, size), review, none.cast("string"), most_chars, ~image))


def extraction_summary(records: DataFrame) -> DataFrame:
    """``(status, n)``: records by status, and those with an error as ``error``."""
    return records.groupBy(F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
