"""Folders of media as a data source that reads only the bytes which the asked columns need.

``read_media`` lists a folder, deals its files to partitions by the bytes that they will cost, and each task reads
ranges: box headers of a movie by seeking from one to the next, the first part of an image, the beginning of
a text, and digests in pieces of 1 MiB. No file is held whole, however large it is. Any store that pyarrow opens by
its address will do (file, hdfs, s3, gs).

Columns: path, name, size, modified, and of ``FACTS`` those that are asked for; ``touched`` counts the bytes read.

Defined results: hidden files and folders (a dot or $ in front) and system files are left out, of paths that differ in case
alone the smallest counts; facts of files of another kind are null, as are those of damaged files; a file that is gone when its task
comes to it has no row; an empty folder has no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.constants import DOCUMENT_EXTENSIONS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from strata.functions.text import kind_of
from strata.sources.media_files import IMAGE_FIELDS, SKIPPED_NAMES, TEXT_LIMIT, Ranges, created, decode_text, docx_text, image_header, movie_part

PIECE, HEAD, HEADERS = 1 << 20, 1 << 18, 1 << 12  # bytes of a digest's step, of an image's first part, of a movie's headers as planned
BYTES_A_TASK, FILES_A_TASK = 128 << 20, 10_000

FACTS = {"created": T.LongType(), "moov": T.BinaryType(), "exif": T.StructType([T.StructField(n, T.ArrayType(T.DoubleType()) if n in ("lat", "lon") else T.StringType()) for n in IMAGE_FIELDS]), "text": T.StringType(), "sha256": T.StringType()}


def moov(source: Ranges) -> bytes | None:
    part = movie_part(source)
    return source.read(part[0], part[1] - part[0]) if part else None


def digest(source: Ranges) -> str:
    out = hashlib.sha256()
    for at in range(0, source.size, PIECE):
        out.update(source.read(at, PIECE))
    return out.hexdigest()


class _Document:
    """What zipfile needs of a file, counted by its Ranges."""

    def __init__(self, source: Ranges):
        self.source, self.at = source, 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.source.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        found = self.source.read(self.at, self.source.size if n is None or n < 0 else n)
        self.at += len(found)
        return found


def text(source: Ranges, name: str) -> str | None:
    """The beginning of a document's text; of DOCX the main part alone is unpacked; None for PDF."""
    low = name.lower()
    if low.endswith(".pdf"):
        return None
    return docx_text(_Document(source)) if low.endswith(".docx") else decode_text(source.read(0, 4 * TEXT_LIMIT + 1))


def _cost(name: str, size: int, asked: tuple[str, ...]) -> int:
    """About how many bytes a file's row takes."""
    return size if "sha256" in asked else min(size, HEADERS + HEAD * ("exif" in asked) + 4 * TEXT_LIMIT * ("text" in asked) + (1 << 20) * ("moov" in asked and _kind(name) == "video"))


def _kind(name: str) -> str:
    stem, _, ending = name.lower().rpartition(".")
    ending = ending if stem else ""  # a leading dot starts no extension
    return next((k for k, own in (("image", IMAGE_EXTENSIONS), ("video", VIDEO_EXTENSIONS), ("document", DOCUMENT_EXTENSIONS)) if ending in own), "other")


class Some(InputPartition):
    """The files of a task: (path, name, size, modified)."""

    def __init__(self, root: str, files: list[tuple[str, str, int, datetime | None]]):
        self.root, self.files = root, files


class MediaReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.root, self.asked = options["path"], tuple(f.name for f in schema if f.name in FACTS)
        self.bytes, self.files = int(options.get("bytesATask", BYTES_A_TASK)), int(options.get("filesATask", FILES_A_TASK))

    def partitions(self) -> list[Some]:
        store, root = fs.FileSystem.from_uri(self.root)
        found: dict[str, tuple] = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            below = f.path[len(root.rstrip("/")) :].strip("/").split("/")
            if f.type == fs.FileType.File and not any(x[:1] in (".", "$") for x in below) and f.base_name.lower() not in SKIPPED_NAMES:
                row = (f.path, f.base_name, f.size, f.mtime)
                found[f.path.lower()] = min(row, found.get(f.path.lower(), row))
        out, held, cost = [], [], 0
        for row in sorted(found.values()):
            more = _cost(row[1], row[2], self.asked)
            if held and (cost + more > self.bytes or len(held) >= self.files):
                out.append(Some(self.root, held))
                held, cost = [], 0
            held.append(row)
            cost += more
        return [*out, Some(self.root, held)]

    def read(self, partition: Some) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(partition.root)
        of_kind = {"created": ("video",), "moov": ("video",), "exif": ("image",), "text": ("document",), "sha256": ("image", "video", "document", "other")}
        for path, name, size, modified in partition.files:
            try:
                with store.open_input_file(path) as f:
                    source = Ranges(f)
                    how = {"created": lambda s: created(s, movie_part(s)), "moov": moov, "exif": lambda s: tuple(image_header(s.read(0, HEAD)).values()), "text": lambda s: text(s, name), "sha256": digest}  # noqa: B023
                    facts = [how[a](source) if _kind(name) in of_kind[a] else None for a in self.asked]
                    yield (path, name, source.size, modified.astimezone(timezone.utc) if modified else None, *facts, source.touched)
            except FileNotFoundError:
                continue


class MediaSource(DataSource):
    """format("strata_media"), options path and columns (names of FACTS with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "strata_media"

    def schema(self) -> T.StructType:
        asked = [c for c in self.options.get("columns", "").split(",") if c]
        if unknown := [c for c in asked if c not in FACTS]:
            raise ValueError(f"no such facts of files: {unknown}")
        own = T.StructType().add("path", "string").add("name", "string").add("size", "long").add("modified", "timestamp")
        for c in asked:
            own = own.add(c, FACTS[c])
        return own.add("touched", "long")

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(schema, dict(self.options))


def address(path: str) -> str:
    """A path as pyarrow wants it: local ones as file:///."""
    return re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}"


def read_media(spark: SparkSession, root: str, *facts: str) -> DataFrame:
    """path, name, size, modified, kind, the facts asked for, touched."""
    spark.dataSource.register(MediaSource)
    own = spark.read.format("strata_media").option("path", address(root)).option("columns", ",".join(facts)).load()
    return own.withColumn("kind", kind_of(F.col("name")))


def write_files(rows: DataFrame, folder: str) -> str:
    """Writes rows (name, content) as files of a new folder, each by the task that holds it, and returns the folder; names are distinct. Goes when the driver ends."""
    place = address(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{name}") as f:  # a task that runs again writes the same
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    atexit.register(_delete, place)
    return folder


def _delete(place: str) -> None:
    store, root = fs.FileSystem.from_uri(place)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
