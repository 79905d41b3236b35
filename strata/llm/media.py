"""Media columns: interleaved document sequences.

HTML is read into one ordered array of structs per document, text and media
references in page order, each reference with its digest and caption. Payloads
lie in a media table under their digests; references find what is known of them by
a join on the digest, so positions and captions stay with the document, and only
small rows are shuffled.

Media are 8-bit greyscale PNG images, 192 samples a row, losslessly compressed.

Defined results: null is an empty text or a sequence without elements; rows with
equal texts share a digest; a reference without a known payload keeps null there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import Renamed, Scratch, as_bytes, slices
from strata.llm.html_tree import BLOCK, Node, parse, squeeze, unescape

WIDTH = 192
SKIP = frozenset("script style noscript template iframe head title".split())
MEDIA = frozenset("img audio video source embed object".split())
ELEMENTS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption"))]))


def payload_of(text: bytes) -> bytes:
    """The text's bytes with spaces appended up to a positive multiple of the width."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Greyscale samples as a PNG image; every row has filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made; checks every chunk."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if int.from_bytes(media[at + 8 + n : at + 12 + n], "big") != zlib.crc32(kind + body) or at + 12 + n > len(media):
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if not size or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image of the width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a row has a filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Of the samples: size, mean, deviation, entropy, and how they fall on 16 equal ranges (per mille)."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    coarse = (1000 * n.reshape(16, 16).sum(1)) // len(x)
    mean = float((n * np.arange(256)).sum() / len(x))
    spread = float(np.sqrt(max(0.0, (n * np.arange(256) ** 2).sum() / len(x) - mean * mean)))
    return f"{WIDTH}x{len(x) // WIDTH};mean={mean:.3f};dev={spread:.3f};entropy={float(-(p * np.log2(p)).sum()):.4f};hist={'.'.join(map(str, coarse))}"


def sequence_of(html: str) -> list[dict]:
    """Text blocks and media references in page order; a figure's caption, else the alternative text, goes with its reference."""
    out: list[dict] = []
    parts: list[str] = []

    def flush() -> None:
        s = squeeze(unescape("".join(parts)))
        parts.clear()
        if s:
            out.append({"pos": len(out), "kind": "text", "text": s, "digest": None, "caption": None})

    stack: list = [parse(html)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in SKIP or x.tag == "figcaption" and _figure(x):
            continue
        elif x.tag in MEDIA:
            flush()
            source = x.attrs.get("src") or x.attrs.get("data") or ""
            if source:
                out.append({"pos": len(out), "kind": "media", "text": None, "digest": source.removeprefix("digest:"), "caption": _caption(x)})
            stack += reversed([c for c in x.items if isinstance(c, Node) and c.tag in MEDIA])
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def _figure(x: Node) -> Node | None:
    while x.parent is not None:
        x = x.parent
        if x.tag == "figure":
            return x
    return None


def _caption(x: Node) -> str | None:
    figure = _figure(x)
    parts, stack = [], [(c, False) for c in reversed(figure.items)] if figure else []
    while stack:
        c, inside = stack.pop()
        if isinstance(c, str):
            parts += [c] * inside
        else:
            stack += [(k, inside or c.tag == "figcaption") for k in reversed(c.items)]
    return squeeze(unescape("".join(parts))) or squeeze(x.attrs.get("alt", "")) or None


def interleave(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and ``elements``, the ordered sequence of each page; a kept column of that name gives way."""
    named = Renamed(pages.select(*(F.col(f"`{c}`") for c in keep if c != "elements")))
    own = pages.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(named.names)), F.col(html).alias("html"))
    schema = named.df.schema.add("elements", ELEMENTS)
    kind = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [sequence_of(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=schema.names)

    return own.mapInArrow(run, schema).select(*named.back(), "elements")


SALTS = 64


def resolve(sequences: DataFrame, media: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per media reference: ``keep``, pos, caption, digest and the media table's columns (null where unknown).

    The media table has one row per digest. What is known of a digest that many references
    share is copied to SALTS keys, and its references are dealt among these; ``keep`` has
    none of the names digest, salt, pos and caption.
    """
    own = sequences.select(*keep, F.explode("elements").alias("e")).where("e.kind = 'media'").select(*keep, "e.pos", "e.caption", "e.digest")
    scratch = Scratch(sequences.sparkSession, "references")
    own = scratch.put(own.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))  # written, so that a task that runs again finds the same
    often = scratch.put(own.groupBy("digest").count().where(F.col("count") > SALTS).select("digest"))
    held = media.join(often.withColumn("often", F.lit(True)), "digest", "left").withColumn("salt", F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("often")
    asked = own.join(often.withColumn("often", F.lit(True)), "digest", "left").withColumn("salt", F.when(F.col("often"), F.col("salt")).otherwise(F.lit(0))).drop("often")
    return asked.join(held, ["digest", "salt"], "left").drop("salt")


def store_texts(docs: DataFrame, text: str, id_column: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sequences as HTML, media table): each text as an image, and a document that refers to it by digest."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = as_bytes(batch.column(1))
            media = [to_png(payload_of(t)) for t in texts]
            digest = [hashlib.sha256(m).hexdigest() for m in media]
            html = [f'<figure><img src="digest:{d}"><figcaption>{escape(str(i))}</figcaption></figure>' for d, i in zip(digest, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html), pa.array([len(t) for t in texts], pa.int64()), pa.array(digest), pa.array(media, pa.binary())], names=["doc_id", "html", "n_bytes", "digest", "media"])

    written = scratch.put(docs.select(F.col(id_column).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, html string, n_bytes long, digest string, media binary"))
    return written.select("doc_id", "html", "n_bytes"), written.select("digest", "media")


def examine(media: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of the stored bytes, one row per digest."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            stored = as_bytes(batch.column(1))
            back = [from_png(m) for m in stored]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()), pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([feature_of(p) for p in back])],
                names=names,
            )

    found = media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*(F.min(n).alias(n) for n in names[1:]))


def media_columns(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, caption) per document."""
    scratch = Scratch(docs.sparkSession, "media")
    pages, media = store_texts(docs, text, id_column, scratch)
    found = resolve(interleave(pages, "html", ("doc_id", "n_bytes")), examine(media), ("doc_id", "n_bytes"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
