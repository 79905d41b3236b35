"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes are bucketed by a q-gram: bucket identifiers of 8-grams are read off the
bytes, and the identifier of depth 2k at a position is made from the identifier
of depth k there and the one k further on, each update used again at once, up to
depth q. Identifiers are content hashes in place of array ranks, so they hold
across executors and nothing is sorted globally. Only the buckets' smallest
identifier in every stretch of ``length`` bytes (an anchor) is followed: equal
stretches have equal anchors at equal offsets, so no repeat is lost.

Buckets are then refined in rounds over the stretches around the anchor, dealt by
offset: 192 at once, 48, 12, 3, then 1. A node (a run of offsets) whose core,
the bytes common to all its stretches, is alone in its bucket holds no repeat; a
node whose union, all bytes its stretches touch, has a partner holds nothing but
repeats; any other is split, and its parts inherit the bucket identifier, refined
by identifiers at their own offsets.

Where a text repeats itself at a distance below SPAN, anchors would stand at every period: such runs are settled at once
(see periodic).

Defined results: a null text is empty; texts shorter than ``length`` keep all
bytes; repeated rows are repeats of each other; matches never cross documents. Rows are
told apart by a 64-bit hash of id and text; of different rows with one hash each would lose the other's bytes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, as_bytes, slices

Q, SPAN, WIDTHS = 208, 192, (192, 48, 12, 3, 1)  # q; offsets an anchor answers for; offsets of a node by round
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def bucket_ids(data: np.ndarray) -> np.ndarray:
    """The bucket identifier of the Q-gram at each position."""
    ids = data.astype(np.uint64)
    for depth in (1, 2, 4):  # exact up to 8 bytes
        ids = ids[:-depth] | (ids[depth:] << np.uint64(8 * depth))
    ids = _mix(ids * np.uint64(0x9E3779B97F4A7C15))
    depth = 8
    while depth < Q:
        step = min(depth, Q - depth)
        ids = _mix(ids[:-step] * np.uint64(0x9E3779B97F4A7C15) + ids[step:])
        depth += step
    return ids


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each full window, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every position that is the smallest of some stretch of ``length`` bytes within a document."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = bucket_ids(data)
    ids = np.maximum((full >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 marks no stretch
    least = sliding(ids, SPAN, np.minimum)[: len(data) - length + 1]
    valid = np.zeros(len(least) + 1, np.int32)
    long_ = ends - starts >= length
    np.add.at(valid, starts[long_], 1)
    np.add.at(valid, np.minimum(ends[long_] - length + 1, len(least)), -1)
    least = np.where(np.cumsum(valid[:-1]) > 0, least, np.uint32(0))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint32), least, np.zeros(SPAN - 1, np.uint32)])
    most = sliding(padded, SPAN, np.maximum)[: len(ids)]
    at = np.flatnonzero((most == ids[: len(most)]) & (most > 0))
    return at, full[at]


def periodic(at: np.ndarray, bucket: np.ndarray, data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which anchors are needed, runs): anchors with one bucket at equal distances d mark a run (first, end) of period d.

    In a run of ``length`` + d bytes or more every stretch is also found d bytes before or after, so all of it goes. As
    partners of other texts' stretches the first d of its stretches are enough: anchors that answer for later ones alone are left out.
    """
    needed, runs = np.ones(len(at), bool), []
    step = np.diff(at)
    linked = (bucket[1:] == bucket[:-1]) & (step < SPAN) & (np.searchsorted(ends, at[1:], "right") == np.searchsorted(ends, at[:-1], "right"))
    change = np.flatnonzero(np.diff(np.where(linked, step, 0), prepend=0, append=0))
    for i, j in zip(change, change[1:]):  # links i to j - 1 are alike
        if not linked[i] or at[j] + Q - at[i] < length + step[i]:
            continue
        first, end, d = int(at[i]), int(at[j]) + Q, int(step[i])
        if not np.array_equal(data[first : end - d], data[first + d : end]):  # buckets are hashes
            continue
        runs.append((first, end))
        own = slice(i, j + 1)
        needed[own] &= (at[own] - (SPAN - 1) < first + d) | (at[own] > end - length)
    return needed, np.array(runs, np.int64).reshape(-1, 2)


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in pieces of bounded size: (row of each stretch of text, its first byte's place in the text, data, starts, ends).

    A long text is cut into pieces that overlap so far that every stretch of
    ``length`` bytes, and the stretches that share its anchor, lie in one whole.
    """
    rows, firsts, parts, size = [], [], [], 0
    for r, t in enumerate(texts):
        if len(t) < length:
            continue
        for k in range(0, len(t) - length + 1, PIECE):
            part = t[k : k + PIECE + length - 1]
            rows.append(r)
            firsts.append(k)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield _joined(rows, firsts, parts)
                rows, firsts, parts, size = [], [], [], 0
    if parts:
        yield _joined(rows, firsts, parts)


def _joined(rows: list[int], firsts: list[int], parts: list[bytes]):
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return rows, np.array(firsts, np.int64), np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends


def text_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the text, bucket) of all anchors, each once, and (row, first, end) of periodic runs."""
    found, runs = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)], [np.zeros((0, 3), np.int64)]
    for rows, firsts, data, starts, ends in _blocks(texts, length):
        at, bucket = anchors(data, starts, ends, length)
        needed, own = periodic(at, bucket, data, ends, length)
        row = np.array(rows, np.int64)
        if len(own):
            k = np.searchsorted(ends, own[:, 0], side="right")
            runs.append(np.column_stack([row[k], own + (firsts - starts)[k][:, None]]))
        at, bucket = at[needed], bucket[needed]
        k = np.searchsorted(ends, at, side="right")
        found.append((row[k], at - starts[k] + firsts[k], bucket))
    row, place, bucket = map(np.concatenate, zip(*found))
    if any(len(t) > PIECE for t in texts):  # the pieces of a long text overlap
        _, first = np.unique(np.column_stack([row, place]), axis=0, return_index=True)
        row, place, bucket = row[first], place[first], bucket[first]
    return row, place, bucket, np.concatenate(runs)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (first, end) of the union; spans that touch become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.column_stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]])


def cut(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs, what is left)."""
    spans = merged(spans)
    kept, at = [], 0
    for s, e in spans.tolist():
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join(kept)


def _found(batch: pa.RecordBatch, texts: list[bytes], spans: list[np.ndarray], keep_text: bool) -> list[pa.Array]:
    done = [cut(t, s) for t, s in zip(texts, spans)]
    out = [pa.array([len(t) for t in texts], pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
    return [*out, pa.array([d[2] for d in done], pa.binary())] if keep_text else out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 400, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) per row: every byte that a string of ``length``
    bytes covers which starts elsewhere too is removed."""
    if length < Q + SPAN:
        raise ValueError(f"length must be at least {Q + SPAN}")
    scratch = Scratch(docs.sparkSession, "substrings")
    kind = docs.schema[id_column].dataType.simpleString()
    reach = SPAN - 1
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, keys = as_bytes(batch.column("text")), batch.column("key").to_numpy()
            row, place, bucket, runs = text_anchors(texts, length)
            union = np.empty(len(row), np.uint64)
            for i, (r, p) in enumerate(zip(row.tolist(), place.tolist())):
                t = texts[r]
                lo, hi = max(0, p - reach), p + length
                union[i] = xxhash.xxh3_64_intdigest(t[lo:hi], seed=(p - lo) * 1024 + min(hi, len(t)) - p)
            for k in range(0, len(row), 1 << 17):
                s = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[s]]), pa.array(place[s]), pa.array(bucket[s].view(np.int64)), pa.array(union[s].view(np.int64)), pa.nulls(len(row[s]), pa.int64())], names=["key", "place", "core", "union", "until"])
            none = pa.nulls(len(runs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[runs[:, 0]]), pa.array(runs[:, 1]), none, none, pa.array(runs[:, 2])], names=["key", "place", "core", "union", "until"])

    # Round 1: whole stretches around each anchor.
    nodes = scratch.put(base.select("key", "text").mapInArrow(find, "key long, place long, core long, union long, until long"))
    shared = scratch.put(_shared(nodes.where("until is null")))
    settled = nodes.where("until is not null").select("key", "place", "core", F.lit(True).alias("all"), "union", "until")
    row_nodes = nodes.join(shared, "core").select("key", "place", "core", (F.col("least") == F.col("most")).alias("all"), "union", "until").unionByName(settled)
    row_nodes = row_nodes.groupBy("key").agg(F.collect_set(F.struct("place", "core", "all", "union", "until")).alias("anchors"))  # bounded by the text's own anchors
    schema = f"doc_id {kind}, key long, {RESULT}, kept binary, text binary, spans binary, open array<struct<place:long,core:long,union:long>>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without an open node are finished here; the others go on."""
        names = [x.name for x in out_fields]
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            spans, open_, finished = [], [], []
            for t, own in zip(texts, batch.column("anchors").to_pylist()):
                known = [(a["place"], a["until"]) if a["until"] else (max(0, a["place"] - reach), min(len(t), a["place"] + length)) for a in own or () if a["all"]]
                rest = [{"place": a["place"], "core": a["core"], "union": a["union"]} for a in own or () if not a["all"]]
                spans.append(np.array(known, np.int64).reshape(-1, 2))
                open_.append(rest or None)
                finished.append(not rest)
            done = _found(batch, [t if f else b"" for t, f in zip(texts, finished)], [s if f else s[:0] for s, f in zip(spans, finished)], True)
            columns = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": done[1], "n_spans": done[2], "kept_sha256": done[3]}
            columns["kept"] = done[4] if keep_text else pa.nulls(len(texts), pa.binary())
            columns["text"] = pa.array([None if f else t for t, f in zip(texts, finished)], pa.binary())
            columns["spans"] = pa.array([merged(s).tobytes() for s in spans], pa.binary())
            columns["open"] = pa.array(open_, out_fields[names.index("open")].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    out_fields = [pa.field("doc_id", pa.null()), *(pa.field(n, pa.null()) for n in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", "spans")), pa.field("open", pa.list_(pa.struct([("place", pa.int64()), ("core", pa.int64()), ("union", pa.int64())])))]
    state = scratch.put(base.join(row_nodes, "key", "left").select("doc_id", "key", "text", "anchors").mapInArrow(settle, schema))
    scratch.drop(nodes, shared)

    # Rounds 2 and 3: parts of the stretches of open anchors. A node that is settled beside others stays as their
    # partner; one of those with the same union is enough.
    begin = F.greatest(F.lit(0).cast("long"), F.col("o.place") - reach)
    near = F.expr(f"substring(text, cast(greatest(0, o.place - {reach}) as int) + 1, {reach + length})")
    open_nodes = state.where(F.col("open").isNotNull()).select("key", F.length("text").cast("long").alias("size"), "text", F.explode("open").alias("o"))
    open_nodes = scratch.put(open_nodes.select(F.monotonically_increasing_id().alias("tag"), "key", "size", "o.*", begin.alias("begin"), near.alias("near")))
    twins = scratch.put(_twins(open_nodes))
    marked = open_nodes.select("tag", "key", "size", "place", "core", "union").join(twins, ["core", "union"], "left")
    whole = [F.greatest(F.lit(0).cast("long"), F.col("place") - reach).alias("first"), F.least(F.col("size"), F.col("place") + length).alias("end")]
    spans = scratch.put(marked.where("one is not null").select("key", *whole))
    now = scratch.put(marked.where("one is null or one = tag").select("tag", "core", F.lit(0).alias("low")))
    around = open_nodes.select("tag", "key", "size", "place", "begin", "near")
    scratch.sweep()
    for wide, width in zip(WIDTHS, WIDTHS[1:]):
        parts = now.join(around, "tag").withColumn("low", F.explode(F.sequence("low", F.col("low") + wide - width, F.lit(width)))).withColumn("high", F.col("low") + width - 1)
        # some stretch lies in the text; all of them do
        parts = parts.where((F.col("low") <= F.col("place")) & (F.col("place") - F.col("high") + length <= F.col("size")))
        inside = (F.col("high") <= F.col("place")) & (F.col("place") - F.col("low") + length <= F.col("size"))
        parts = parts.withColumn("core", _bytes_id(F.col("place") - F.col("low") - F.col("begin"), length - (width - 1)))
        union = _bytes_id(F.col("place") - F.col("high") - F.col("begin"), length + width - 1)
        parts = parts.withColumn("union", F.when(inside, union) if width > 1 else F.col("core"))  # null: not all of its stretches lie in the text
        bounds = [F.greatest(F.lit(0).cast("long"), F.col("place") - F.col("high")).alias("first"), F.least(F.col("size"), F.col("place") - F.col("low") + length).alias("end")]
        parts = scratch.put(parts.select("tag", "key", "low", "core", "union", *bounds))
        shared = scratch.put(_shared(parts))
        cand = parts.join(shared, "core")
        if width == 1:
            spans = scratch.put(spans.unionByName(cand.select("key", "first", "end")))
            break
        cand = scratch.put(cand.select("tag", "key", "low", "core", "union", "first", "end", F.expr("least = most and members = n").alias("same"), F.monotonically_increasing_id().alias("node")))
        twins = scratch.put(_twins(cand.where("not same and union is not null"), "node"))
        marked = cand.where("not same").join(twins, ["core", "union"], "left")
        spans = scratch.put(spans.unionByName(cand.where("same").select("key", "first", "end")).unionByName(marked.where("one is not null").select("key", "first", "end")))
        now = scratch.put(marked.where("one is null or one = node").select("tag", "core", "low"))
        scratch.drop(parts, shared, cand, twins)
        scratch.sweep()
    per_row = spans.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("more"))  # bounded by the text's own anchors
    finished = state.where(F.col("open").isNull()).select("doc_id", *(x.split()[0] for x in RESULT.split(", ")), *(["kept"] if keep_text else []))
    rest = state.where(F.col("open").isNotNull()).select("doc_id", "key", "text", "spans").join(per_row, "key", "left").select("doc_id", "text", "spans", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, spans = as_bytes(batch.column("text")), []
            for known, more in zip(as_bytes(batch.column("spans")), batch.column("more").to_pylist()):
                extra = np.array([(x["first"], x["end"]) for x in more or ()], np.int64).reshape(-1, 2)
                spans.append(np.concatenate([np.frombuffer(known, np.int64).reshape(-1, 2), extra]))
            names = ["doc_id", *(x.split()[0] for x in RESULT.split(", ")), *(["kept"] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_found(batch, texts, spans, keep_text)], names=names)

    return finished.unionByName(rest.mapInArrow(finish, f"doc_id {kind}, {RESULT}" + ", kept binary" * keep_text))


def _shared(nodes: DataFrame) -> DataFrame:
    """(core, least, most, n, members): buckets of more than one node, their smallest and largest union identifier, and how many have one."""
    return nodes.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.count("union").alias("members"), F.min("union").alias("least"), F.max("union").alias("most")).where("n > 1")


def _twins(nodes: DataFrame, tag: str = "tag") -> DataFrame:
    """(core, union, one): unions of several nodes in a bucket, and the smallest tag among them."""
    return nodes.groupBy("core", "union").agg(F.count(F.lit(1)).alias("n"), F.min(tag).alias("one")).where("n > 1").select("core", "union", "one")


def _bytes_id(first, size: int):
    """The bucket identifier refined by the bytes at an offset into column near, counted from 0."""
    return F.xxhash64("core", "low", F.substring(F.col("near"), first.cast("int") + 1, F.lit(size)))


#: The same in DuckDB: bytes as pairs of hex digits, every window by its MD5, runs as islands. For small tables.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
x AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) m ON m.k = w.k),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM x),
s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g),
v AS (SELECT r, n, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY r, n),
l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY n), 0) AS prev FROM v),
c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY n) AS head FROM l JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c USING (r)
"""
