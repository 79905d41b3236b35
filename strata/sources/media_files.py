"""Folders of media as DataFrames, and what file headers say: capture dates and places of videos, texts of documents."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.media import degrees
from strata.functions.text import kind_of

SKIPPED_NAMES = ("desktop.ini", "thumbs.db")
MOOV_LIMIT = 64 << 20
TEXT_LIMIT = 6_000  # characters of a document's text that are indexed


def scan(spark: SparkSession, root: str, content: bool = False, most: int | None = None) -> DataFrame:
    """(path, name, size, modified, kind[, content, sha256]) of the files below a folder; hidden ones and system files are left out,
    paths that differ in case alone count once (the smallest). More than ``most`` files are an error."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + "(?=" + _quoted(root.rstrip("/").rsplit("/", 1)[-1]) + "/)", "")
    name = F.element_at(F.split("path", "/"), -1)
    out = own.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), kind_of(name).alias("kind"), *(["content"] if content else []), rel.alias("__rel"))
    out = out.where(~F.col("__rel").rlike(r"/[.$]") & ~F.lower("name").isin(*SKIPPED_NAMES)).drop("__rel")
    once = out.select("path", "name", "size", "modified", "kind").groupBy(F.lower("path").alias("__l")).agg(F.min(F.struct("path", "name", "size", "modified", "kind")).alias("f")).select("f.*")
    if most is not None and once.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files below {root}")
    if not content:
        return once
    return out.join(once.select("path"), "path", "left_semi").withColumn("sha256", F.sha2("content", 256))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def decode_text(content: bytes | None, limit: int = TEXT_LIMIT) -> str:
    """Text of unknown encoding: UTF-8, UTF-16, then code pages of Traditional Chinese; at most ``limit`` characters."""
    raw = (content or b"")[: limit * 4]
    cut = len(raw) < len(content or b"")  # perhaps within a character
    for encoding in ("utf-8", "utf-16", "cp950", "big5"):
        try:
            return codecs.getincrementaldecoder(encoding)().decode(raw, final=not cut).strip()[:limit]
        except UnicodeError:
            continue
    return raw.decode("utf-8", "ignore").strip()[:limit]


class Ranges:
    """A file, or bytes, read by ranges; ``touched`` counts what has been read."""

    def __init__(self, source: pa.NativeFile | bytes):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        self.size, self.touched = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        found = self.file.read(max(0, min(n, self.size - at)))
        self.touched += len(found)
        return found


def boxes(source: Ranges, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first, end) of an MP4 file's boxes between two places, by reading their headers alone; ends where one is damaged."""
    end = source.size if end is None else end
    while start + 8 <= end:
        head = source.read(start, 16)
        size, kind, first = int.from_bytes(head[:4], "big"), head[4:8], start + 8
        if size == 1 and len(head) == 16:
            size, first = int.from_bytes(head[8:], "big"), start + 16
        after = end if size == 0 else start + size
        if not first <= after <= end:
            return
        yield kind, first, after
        start = after


def movie_part(source: Ranges) -> tuple[int, int] | None:
    """Where the moov box's content lies, unless it is damaged or larger than 64 MiB."""
    found = next(((a, b) for kind, a, b in boxes(source) if kind == b"moov"), None)
    return found if found and found[1] - found[0] <= MOOV_LIMIT else None


def created(source: Ranges, part: tuple[int, int] | None) -> int | None:
    """Seconds since 1904 from the mvhd box in that part; what lies around it isn't read."""
    for kind, first, end in boxes(source, *part) if part else ():
        if kind == b"mvhd" and end - first >= 12:
            head = source.read(first, 12)
            return int.from_bytes(head[4:12] if head[0] == 1 else head[4:8], "big")
    return None


def movie_header(data: bytes | None) -> bytes | None:
    """The moov box, unless it is damaged or larger than 64 MiB."""
    part = movie_part(Ranges(data or b""))
    return data[slice(*part)] if part else None


def creation_seconds(moov: bytes | None) -> int | None:
    """Seconds since 1904 from the mvhd box."""
    return created(Ranges(moov or b""), (0, len(moov or b"")))


@F.pandas_udf(T.StructType([T.StructField("moov", T.BinaryType()), T.StructField("created", T.LongType())]))
def video_facts(content: pd.Series) -> pd.DataFrame:
    """The header of each video and its creation time."""
    moov = [movie_header(c) for c in content]
    return pd.DataFrame({"moov": moov, "created": pd.array([creation_seconds(m) for m in moov], "Int64")})


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
XML_LIMIT = 64 << 20  # bytes of a document's main part


def docx_text(content: bytes | BinaryIO | None, limit: int = TEXT_LIMIT) -> str | None:
    """Paragraphs of a DOCX file, one a line; None if it can't be read as one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"") if isinstance(content, bytes | None) else content) as z:
            if z.getinfo("word/document.xml").file_size > XML_LIMIT:
                return None
            raw = z.read("word/document.xml")
        if b"<!DOCTYPE" in raw[:1024]:  # entities have no place there
            return None
        body = ElementTree.fromstring(raw)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError):
        return None
    parts = {f"{WORD}t": lambda x: x.text or "", f"{WORD}tab": lambda x: "\t", f"{WORD}br": lambda x: "\n"}
    return "\n".join("".join(parts[x.tag](x) for x in p.iter() if x.tag in parts) for p in body.iter(f"{WORD}p")).strip()[:limit]


def document_text(name: str, content: bytes | None, limit: int = TEXT_LIMIT) -> str | None:
    """Text of a document by its extension; None for PDF, which needs a library that isn't here."""
    low = name.lower()
    if low.endswith(".pdf"):
        return None
    return docx_text(content, limit) if low.endswith(".docx") else decode_text(content, limit)


@F.pandas_udf(T.StringType())
def document_texts(name: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([document_text(n, c) for n, c in zip(name, content)], dtype=object)


# Tags of the Exif standard.
MAKE, MODEL, CHANGED, TAKEN, EXIF_PART, GPS_PART = 0x010F, 0x0110, 0x0132, 0x9003, 0x8769, 0x8825
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of a TIFF directory: texts, numbers, or lists of fractions as numbers (None over 0)."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, entry)
        size = SIZES.get(kind, 0) * n
        place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        if not size or place + size > len(data):
            continue
        if kind == 2:
            out[tag] = data[place : place + n].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            pairs = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data, place)
            out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2])]
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, place)[0]
    return out


def exif_block(content: bytes) -> bytes | None:
    """The TIFF part of a JPEG's Exif segment, or of a TIFF file."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        if kind == 0xDA or size < 2:
            return None
        at += 2 + size
    return None


def image_header(content: bytes | None) -> dict:
    """taken, make, model, and position as degrees, minutes, seconds and reference; None where the header hasn't got them.

    The time is that of the original, in the Exif part or beside it, else of the last change.
    """
    none = dict.fromkeys(IMAGE_FIELDS)
    data = exif_block(content or b"")
    if not data or len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return none
    order = "<" if data[:2] == b"II" else ">"
    main = _directory(data, struct.unpack_from(f"{order}I", data, 4)[0], order)
    part = lambda tag: _directory(data, main[tag], order) if isinstance(main.get(tag), int) else {}
    exif, gps = part(EXIF_PART), part(GPS_PART)
    out = none | {"taken": main.get(TAKEN) or exif.get(TAKEN) or main.get(CHANGED), "make": main.get(MAKE), "model": main.get(MODEL)}
    for name, tag, ref in (("lat", LAT, LAT_REF), ("lon", LON, LON_REF)):
        if isinstance(gps.get(tag), list) and len(gps[tag]) >= 3 and gps.get(ref):
            out |= {name: [x or 0.0 for x in gps[tag][:3]], f"{name}_ref": gps[ref]}
    return out


IMAGE_FIELDS = ("taken", "make", "model", "lat", "lat_ref", "lon", "lon_ref")


_FACTS = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType()) if n in ("lat", "lon") else T.StringType()) for n in IMAGE_FIELDS])


@F.pandas_udf(_FACTS)
def image_facts(content: pd.Series) -> pd.DataFrame:
    """What the headers of images say."""
    return pd.DataFrame([image_header(c) for c in content], columns=list(IMAGE_FIELDS))


def position(facts: Column) -> tuple[Column, Column]:
    """(lat, lon) from image_facts; nulls if there is none, it is out of bounds, or it is the origin."""
    lat, lon = (degrees(*(facts[n][k] for k in range(3)), facts[f"{n}_ref"]) for n in ("lat", "lon"))
    known = facts["lat"].isNotNull() & facts["lon"].isNotNull()
    fine = known & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ((F.abs(lat) >= 1e-6) | (F.abs(lon) >= 1e-6))
    return F.when(fine, lat), F.when(fine, lon)
