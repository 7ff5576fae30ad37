"""Trees of files as rows. Folders are a frontier that tasks list level by level; contents are read by tasks, only where asked for.

Unlike Spark's own readers this sees names that begin with a dot or an underscore and follows no links. Local paths are listed by the
machine they are mounted on; other stores through pyarrow's file systems.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import Kept

ENTRY = "root_index int, uri string, relative_path string, name string, kind string, depth int, bytes bigint, modified_us bigint"
#: Bytes of contents that are handed on at once, and folders that one task lists.
BATCH, FOLDERS = 32 << 20, 64


def local_path(uri: str) -> str | None:
    """The path of a local file or folder, or null for another store."""
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri if not parts.scheme else None


def _entries(uri: str, itself: bool) -> Iterator[tuple[str, str, int, int]]:
    """Name, kind (file, folder, missing), size and time of what lies in a folder; ``itself``: a file is its own entry. No links."""
    path = local_path(uri)
    if path is not None:
        if itself and not os.path.isdir(path):
            if not os.path.isfile(path):
                yield "", "missing", 0, 0
                return
            own = os.stat(path)
            yield os.path.basename(path), "file", own.st_size, own.st_mtime_ns // 1000
            return
        with os.scandir(path) as found:
            for e in found:
                own = e.stat(follow_symlinks=False)
                if stat.S_ISREG(own.st_mode) or stat.S_ISDIR(own.st_mode):
                    yield e.name, "folder" if stat.S_ISDIR(own.st_mode) else "file", own.st_size, own.st_mtime_ns // 1000
        return
    fs, inside = pyarrow.fs.FileSystem.from_uri(uri)
    kinds = {pyarrow.fs.FileType.File: "file", pyarrow.fs.FileType.Directory: "folder"}
    here = fs.get_file_info(inside)
    if itself and here.type != pyarrow.fs.FileType.Directory:
        infos = [here]
    else:
        infos = fs.get_file_info(pyarrow.fs.FileSelector(inside))
    for info in infos:
        yield info.base_name, kinds.get(info.type, "missing"), info.size or 0, (info.mtime_ns or 0) // 1000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["root_index", "uri", "relative_path", "name", "kind", "depth", "bytes", "modified_us"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    for b in batches:
        for root, uri, relative, depth in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            rows = []
            for name, kind, size, time in _entries(uri, depth == 0 and relative == ""):
                alone = uri.rstrip("/").endswith(f"/{name}") and kind == "file" and relative == "" and not _is_folder(uri)
                rows.append((root, uri if alone or kind == "missing" else f"{uri.rstrip('/')}/{name}", f"{relative}/{name}" if relative else name, name, kind, depth, size, time))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _is_folder(uri: str) -> bool:
    path = local_path(uri)
    if path is not None:
        return os.path.isdir(path)
    fs, inside = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.get_file_info(inside).type == pyarrow.fs.FileType.Directory


def _outside(excluded: Sequence[str]):
    """Whether a row's place is none of the excluded ones, nor in one of them."""
    at = F.regexp_replace("uri", "^file:(//)?", "")
    out = F.lit(True)
    for gone in excluded:
        place = (local_path(gone) or gone).rstrip("/")
        out = out & (at != place) & ~F.startswith(at, F.lit(f"{place}/"))
    return out


def list_tree(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), max_depth: int = 12, max_items: int | None = None) -> DataFrame:
    """``(root_index, uri, relative_path, name, depth, bytes, modified_at)`` of all files under the roots, down to ``max_depth`` folders.

    A root may be a file, which lies at the top; one that doesn't exist raises FileNotFoundError. ValueError is raised as soon as
    there are more files than ``max_items``, before any content is read. Excluded folders are never listed.
    """
    kept = Kept(spark)
    levels, total = [], 0
    frontier = spark.createDataFrame([(i, r.rstrip("/") or "/", "", 0) for i, r in enumerate(roots)], "root_index int, uri string, relative_path string, depth int").where(_outside(exclude))
    folders = len(roots)
    for depth in range(max_depth + 1):
        tasks = max(1, -(-folders // FOLDERS))
        found = kept.write(frontier.repartition(tasks).mapInArrow(_listed, ENTRY).where(_outside(exclude)))
        if depth == 0:
            gone = [r.uri for r in found.where("kind = 'missing'").collect()]
            if gone:
                raise FileNotFoundError(", ".join(gone))
        counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
        levels.append(found.where("kind = 'file'"))
        total, folders = total + counts.get("file", 0), counts.get("folder", 0)
        if max_items is not None and total > max_items:
            raise ValueError(f"more than {max_items} files")
        if not folders:
            break
        frontier = found.where("kind = 'folder'").select("root_index", "uri", "relative_path", (F.col("depth") + 1).alias("depth"))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows.select("root_index", "uri", "relative_path", "name", "depth", "bytes", F.timestamp_micros("modified_us").alias("modified_at"))


def _read(uri: str) -> bytes:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    fs, inside = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(inside) as f:
        return f.read()


def with_contents(files: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """``files`` with ``content``; null for files of more than ``max_bytes``, which are not read."""
    large = files.where(F.col("bytes") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    small = files.where(F.col("bytes") <= max_bytes)
    at = small.columns.index("uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, contents = 0, 0, []
            for i, uri in enumerate(b.column(at).to_pylist()):
                contents.append(_read(uri))
                held += len(contents[-1])
                if held >= BATCH or i == b.num_rows - 1:
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    begin, held, contents = i + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)
    return small.mapInArrow(run, f"{schema}, content binary").unionByName(large)


