"""Attachments: which pages refer to which files, rewriting image links to them, writing them out."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import MARKER, asset_markers, asset_pattern, attachment_files, data_uri, filename_problem
from ..markup.assets import name_problem, safe_path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as the frame has columns so called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def page_files(pages: DataFrame, body: str = "xhtml") -> DataFrame:
    """(page_id, ord, filename) of the files that each page's storage text refers to."""
    return pages.select("page_id", F.posexplode(attachment_files(body)).alias("ord", "filename"))


def resolve_assets(
    pages: DataFrame,
    assets: DataFrame,
    *,
    mode: str = "sidecar",
    asset_dir: str = "assets",
    page_dir: str = "",
    strict: bool = True,
    marker: str = MARKER,
) -> DataFrame:
    """Pages (page_id, markdown, ...) with the link before each asset marker pointing to the file's bytes or its copy.

    assets: (page_id, filename, bytes); of several rows for a file the one with the least bytes counts, rows without
    bytes are none. Markers stay, so the step can be repeated. Files that are missing leave their link alone; with
    strict, names that are unsafe to write to fail the page: `asset_error` says why, null if there is no such name.
    Every row of pages stays, with all its columns, also if page_id is repeated or null.
    The files that a page asks for become one map of the page, which meets the text in one join; the text is cut at
    its markers and put together again within its row.
    """
    if mode not in ("sidecar", "inline"):
        raise ValueError("mode is sidecar or inline")
    pattern = asset_pattern(marker)
    key, src, held, target, targets = fresh(pages, "asset_page", "src", "bytes", "target", "asset_targets")
    wanted = pages.select(F.col("page_id").alias(key), F.explode(F.array_distinct(asset_markers("markdown", marker))).alias(src)).distinct()
    if strict:
        wanted = wanted.filter(filename_problem(src).isNull())
    files = assets.filter("bytes IS NOT NULL").groupBy(F.col("page_id").alias(key), F.col("filename").alias(src)).agg(F.min("bytes").alias(held))
    base = posixpath.relpath(asset_dir, page_dir) if page_dir else asset_dir
    new = data_uri(src, held) if mode == "inline" else F.concat(F.lit(f"{base}/"), F.col(src))
    found = wanted.join(files, [key, src]).select(key, src, new.alias(target))
    found = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(src, target))).alias(targets))
    rows = pages.join(found, F.col("page_id") == F.col(key), "left")
    # only an image link that stands right before the marker is rewritten
    link = r'(?s)(!\[(?:[^\]\\]++|\\.)*+\]\()([^)\s]*+)((?:\s++"(?:[^"\\]++|\\.)*+")?+\)[ \t]*)\z'
    markers, names = F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0)), asset_markers("markdown", marker)
    pieces = F.arrays_zip(F.slice(F.split("markdown", pattern, -1), 1, F.size(markers)).alias("piece"), markers.alias("marker"), names.alias("name"))

    def rewritten(p):
        to = F.try_element_at(F.col(targets), p["name"])
        quoted = F.replace(F.replace(to, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.concat(F.when(to.isNotNull(), F.regexp_replace(p["piece"], F.lit(link), F.concat(F.lit("$1"), quoted, F.lit("$3")))).otherwise(p["piece"]), p["marker"])

    whole = F.concat(F.array_join(F.transform(pieces, rewritten), ""), F.element_at(F.split("markdown", pattern, -1), -1))
    text = F.when(F.col(targets).isNull(), F.col("markdown")).otherwise(whole).alias("markdown")
    columns = [text if c == "markdown" else F.col(f"`{c}`") for c in pages.columns]
    if strict:
        columns.append(F.array_max(F.transform(names, filename_problem)).alias("asset_error"))
    return rows.select(*columns)


def write_assets(assets: DataFrame, folder: str, *, strict: bool = True) -> None:
    """Writes (page_id, filename, bytes) below a folder that all executors share, one folder for each page.

    Unsafe names fail the job if strict, else they are logged and skipped. A repeated task writes the same files again.
    """

    def save(rows) -> None:
        for r in rows:
            path = safe_path(Path(folder) / str(r["page_id"]), r["filename"], strict=strict)
            if path is None:
                continue
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_name(f".{uuid.uuid4().hex}")  # seen by nobody until it is whole
            part.write_bytes(r["bytes"])
            part.replace(path)

    assets.select("page_id", "filename", "bytes").foreachPartition(save)


# --- files by content ---------------------------------------------------------------------------------------

MANIFEST = "page_id string, filename string, sha256 string, size long, error string"


def store_assets(assets: DataFrame, folder: str) -> DataFrame:
    """Keeps the files (page_id, filename, bytes) below a folder, each content once, and gives the new manifest.

    Contents are `objects/ab/abcd...` by their SHA-256. A file is written under another name and then moved, so that a lost
    task leaves no torn object, and a repeated one finds it there; equal bytes need no shuffle to be stored once. The manifest
    (page_id, filename, sha256, size, error) is written by Spark as `manifests/<id>` after all objects and lists what counts;
    names that are unsafe to write to and files without bytes have an error there and no object. folder: any address that Arrow can
    open and that all executors share.
    """
    spark = assets.sparkSession
    place = f"{folder.rstrip('/')}/manifests/{uuid.uuid4().hex}"

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, home = fs.FileSystem.from_uri(folder)
        home = home.rstrip("/")
        for b in batches:
            out = []
            for page, name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                problem = "no name" if name is None else "no bytes" if data is None else name_problem(name)
                if problem:
                    out.append((page, name, None, None, problem))
                    continue
                sha = hashlib.sha256(data).hexdigest()
                path = f"{home}/objects/{sha[:2]}/{sha}"
                if files.get_file_info(path).type == fs.FileType.NotFound:
                    files.create_dir(f"{home}/objects/{sha[:2]}", recursive=True)
                    part = f"{home}/objects/{sha[:2]}/.{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as f:
                        f.write(data)
                    files.move(part, path)
                out.append((page, name, sha, len(data), None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "filename", "sha256", "size", "error"])

    rows = assets.select(F.col("page_id").cast("string").alias("page_id"), "filename", "bytes")
    rows.mapInArrow(save, MANIFEST).write.parquet(place)
    return spark.read.schema(MANIFEST).parquet(place)


def stored_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, size, bytes) of the objects of a store; the empty one is none, as Spark reads no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/objects")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("sha256"), F.col("length").alias("size"), F.col("content").alias("bytes"))


def read_stored(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, filename, bytes) of a manifest's files, by hash; bytes are null if the object is gone."""
    named = manifest.filter("sha256 IS NOT NULL").join(stored_objects(spark, folder).select("sha256", "bytes"), "sha256", "left")
    return named.select("page_id", "filename", F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("bytes")).alias("bytes"))
