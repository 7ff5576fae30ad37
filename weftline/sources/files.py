"""File trees as manifests of materials."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions import text as T
from weftline.operators.duplicates import mark_duplicates
from weftline.sources.trees import list_tree, with_contents

#: Names that are never materials.
IGNORED = (".ds_store", "thumbs.db", "desktop.ini")


def discovery_order(path: Column) -> Column:
    """Sort key of a path under its root: a folder's files before its folders, each in natural order."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).cast("int").alias("folder"), T.natural_key(p).alias("name"), p.alias("exact")))


def scan_files(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), max_depth: int = 12, max_bytes: int = 1 << 30, max_items: int | None = None) -> DataFrame:
    """All files under the roots: root_index, relative_path, name, extension, depth, bytes, modified_at, content.

    Files too large have null content and are never read; ignored names, excluded folders and files, links, and files deeper than
    ``max_depth`` folders are left out. More files than ``max_items`` raise ValueError before contents are read. Roots and exclusions
    are absolute paths or URIs; a root may be a file, which lies at the top. The order of materials is by root and then
    :func:`discovery_order`.
    """
    for place in (*roots, *exclude):
        if not (place.startswith("/") or re.match("[A-Za-z][A-Za-z0-9+.-]*:/", place)):
            raise ValueError(f"not an absolute path or URI: {place}")
    rows = list_tree(spark, roots, exclude, max_depth, max_items).where(~F.lower("name").isin(*IGNORED))
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("name", r".(\.[^.]+)$", 1)))
    return with_contents(rows, max_bytes).drop("uri")


def manifest(files: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Scanned files as materials: id, category, mime, sha256, dimensions, warnings and exact-duplicate mark, without contents."""
    large = F.col("bytes") > max_bytes
    digest = T.content_hash(F.col("content"))
    facts = files.withColumns({"sha256": digest, "mime": T.sniff_mime(F.coalesce(F.substring("content", 1, 32), F.lit(b"")), F.col("extension")), "category": F.when(large, "unsupported").otherwise(T.category_of(F.col("extension")))})
    warnings = F.array_compact(F.array(F.when(large, "file is too large"), F.when(T.variant_flag(F.col("relative_path")), "possible version variant")))
    rows = facts.select(T.material_id(F.col("sha256"), F.col("root_index"), F.col("relative_path"), F.col("bytes"), F.col("modified_at")).alias("id"), "root_index", "relative_path", "name", "extension", "category", "mime", "bytes", "sha256", "modified_at", warnings.alias("warnings"),
                        F.when(F.col("category") == "image", T.image_dims(F.col("content"), F.col("mime"))).alias("dimensions"))
    place = F.struct(F.col("root_index").alias("r"), discovery_order(F.col("relative_path")).alias("n"))
    return mark_duplicates(rows.withColumn("__place", place), "sha256", "__place", "id").drop("__place")


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row about a manifest: total, supported, unsupported, exact_duplicate_groups, and the number of each category as a map."""
    groups = rows.where("sha256 is not null").groupBy("sha256").count().where("count > 1").agg(F.count(F.lit(1)).alias("exact_duplicate_groups"))
    each = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    is_ = F.col("category") == "unsupported"
    counts = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~is_, F.col("n"))), F.lit(0)).alias("supported"), F.coalesce(F.sum(F.when(is_, F.col("n"))), F.lit(0)).alias("unsupported"),
                      F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    return counts.withColumn("exact_duplicate_groups", groups.scalar())
