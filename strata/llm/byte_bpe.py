"""Exact byte-level BPE: the last token of every prefix, by dynamic programming.

An encoding by ranked merges has the property that what it makes of a prefix ends in one token, and that
the tokens before are what it makes of the prefix without that token. So for every prefix the only token is kept that ends
there and may stand behind the last token of the prefix before it; the ids follow by going back
from the end. Tokens that end at a byte are found by a suffix automaton over the vocabulary, which reads the text
once; whether two tokens may stand side by side is tested by undoing their merges, latest
first, and asking whether an earlier merge would have joined what then meets at their border.

Texts are cut at the file's special tokens and before white space, where pre-tokens never span; each distinct
stretch is encoded once in a worker, as long as its bounded cache holds it, and the new ones of a batch
go through the automaton side by side.

Defined results: null is an empty text, which has no ids; repeated rows are encoded each; texts of any length are encoded
whole; a special token's string becomes its id, and its id becomes the string again; columns beside the id
and the text are passed over, whatever their names. Bytes that are no UTF-8 count and come back as U+FFFD. A file whose
merges don't make each token in one way is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import as_bytes, slices, worker_cache

CACHE_PIECES, LONGEST_HELD = 800_000, 48
STRETCHES_AT_ONCE, PAIRS_AT_ONCE, WINDOW = 20_000, 10_000, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters by which such vocabulary files write bytes: printable ones themselves, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SuffixAutomaton:
    """All substrings of the given byte strings; after each byte read, the strings that end there, longest first.

    Built along the trie of the strings, shorter ones first. ``word[v]``: the string that
    state v's longest member is, or -1; ``above[v]``: the nearest state with one on its suffix path, itself included, or 0.
    """

    def __init__(self, words: dict[bytes, int]):
        self.go: dict[int, int] = {}  # (state, byte) as one number: state
        self.link, self.length, edges = [-1], [0], [[]]
        self._edges = edges
        at: dict[bytes, int] = {b"": 0}
        for w in sorted({w[:k] for w in words for k in range(1, len(w) + 1)}, key=lambda w: (len(w), w)):
            at[w] = self._extend(at[w[:-1]], w[-1])
        del self._edges
        self.word = array("i", [-1]) * len(self.link)
        for w, i in words.items():
            self.word[at[w]] = i
        self.above = array("i", [0]) * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[v] = v if self.word[v] >= 0 else self.above[self.link[v]]

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._edges.append([])
        return len(self.link) - 1

    def _set(self, v: int, c: int, to: int) -> None:
        if v << 8 | c not in self.go:
            self._edges[v].append(c)
        self.go[v << 8 | c] = to

    def _clone(self, p: int, c: int, q: int) -> int:
        """The part of q that is read over p, as a state of its own."""
        new = self._state(self.length[p] + 1, self.link[q])
        for d in self._edges[q]:
            self._set(new, d, self.go[q << 8 | d])
        self.link[q] = new
        while p >= 0 and self.go.get(p << 8 | c) == q:
            self.go[p << 8 | c] = new
            p = self.link[p]
        return new

    def _extend(self, p: int, c: int) -> int:
        q = self.go.get(p << 8 | c)
        if q is not None:  # the string is a substring of an earlier one
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        new = self._state(self.length[p] + 1, 0)
        while p >= 0 and p << 8 | c not in self.go:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.go[p << 8 | c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new


class BytePairs:
    """A byte-level BPE file (vocabulary, ranked merges, special tokens, pre-tokens by pattern)."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before, added = told["model"], told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any((told.get("normalizer"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("ignore_merges")))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a plain byte-level BPE file")
        letters, ids = byte_letters(), model["vocab"]
        self.as_byte = {ord(c): chr(b) for c, b in letters.items()}
        special = {t["content"]: t["id"] for t in added}
        self.splits: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes the token; bytes have none
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made, left, right = ids[a + b], ids[a], ids[b]
            if made in self.splits:
                raise ValueError("two merges make one token")
            self.splits[made], self.pairs[left, right], self.rank[made] = (left, right), k, k
        self.bytes = {i: self._bytes(w) for w, i in ids.items() if w not in special}
        table = self.bytes | {i: w.encode() for w, i in special.items()}
        self.special, self.letters = special, np.frombuffer(b"".join(table.get(i, b"") for i in range(max(table) + 1)), np.uint8)
        self.sizes = np.array([len(table.get(i, b"")) for i in range(max(table) + 1)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        whole = {i for i, w in self.bytes.items() if len(w) == 1}
        if len(whole) != 256:
            raise ValueError("the vocabulary lacks a byte")
        for i, (a, b) in self.splits.items():  # by rank; a token whose own bytes are merged otherwise never comes up
            if a in whole and b in whole and self.compatible(a, b, self.rank[i]):
                whole.add(i)
        auto = self.automaton = SuffixAutomaton({self.bytes[i]: i for i in whole})
        self.size = array("i", [len(self.bytes.get(i, b"")) for i in range(max(ids.values()) + 1)])
        self.columns = {c: np.array(getattr(auto, c), np.int64) for c in ("link", "length", "above", "word")} | {"size": np.array(self.size, np.int64)}
        self.columns["key"] = np.array(sorted(auto.go), np.int64)
        self.columns["to"] = np.array([auto.go[k] for k in self.columns["key"].tolist()], np.int64)
        self.fits: dict[int, bool] = {}
        self.pair, self.pair_fine = np.array([-1]), np.array([False])
        self.words: dict[str, bytes] = {}  # by text behind a space
        self.pieces: dict[str, bytes] = {}  # by pre-token, in the file's letters
        self.pre_tokens = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.cut = re.compile("(" + "|".join(re.escape(w) for w in sorted(special, key=len, reverse=True)) + ")") if special else None

    def _bytes(self, letters: str) -> bytes:
        return letters.translate(self.as_byte).encode("latin-1")

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether a text of exactly these tokens keeps the border between them: no merge across it ranks before those that made them.

        Going back through the merges on either side, latest first, the tokens that meet at the border
        at each stage must not have a merge that would have come first; of equal ranks the left one does.
        """
        limit = (len(self.rank) if below is None else below, 0)
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and (joined, 0) < limit:
                return False
            at_a, at_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                limit, a = (at_a, 0), self.splits[a][1]  # the merge left of the border came before one across it
            else:
                limit, b = (at_b, 1), self.splits[b][0]  # and that right of it after

    def _fine(self, key: int) -> bool:
        """compatible() of two ids in one number, remembered."""
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self.compatible(key >> 32, key & 0xFFFFFFFF)
        return found

    def encode_long(self, data: bytes) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        auto, size, fine = self.automaton, self.size, self._fine
        go, link, length, above, word = auto.go, auto.link, auto.length, auto.above, auto.word
        last = array("i", [-1]) * (len(data) + 1)
        state = n = 0  # and n: the longest substring of a token that ends what is read, and its length
        for end, c in enumerate(data, 1):
            to = go.get(state << 8 | c)
            while to is None:
                state = link[state]
                n, to = length[state], go.get(state << 8 | c)
            state, n = to, n + 1
            v = above[state if n == length[state] else link[state]]
            while True:  # some token fits: a byte at least
                t = word[v]
                begin = end - size[t]
                if not begin or fine(last[begin] << 32 | t):
                    break
                v = above[link[v]]
            last[end] = t
        ids, end = array("I"), len(data)
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """The same of many pre-tokens, byte by byte of all at once."""
        auto, size = self.columns, self.columns["size"]
        link, length, above, word = (auto[c] for c in ("link", "length", "above", "word"))
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))  # those that go on are the first ones
        lens = np.array([len(pieces[i]) for i in order])
        width = int(lens[0])
        text = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(-1, width)
        last = np.full((len(order), width + 1), -1, np.int64)
        state, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for end in range(1, width + 1):
            m = int(np.searchsorted(-lens, -end, "right"))
            c, st, nn = text[:m, end - 1], state[:m], n[:m]
            to = self._go(st, c)
            miss = np.flatnonzero(to < 0)
            while len(miss):
                st[miss] = link[st[miss]]
                nn[miss] = length[st[miss]]
                to[miss] = self._go(st[miss], c[miss])
                miss = miss[to[miss] < 0]
            st[:], rows = to, np.arange(m)
            nn += 1
            v = above[np.where(nn == length[to], to, link[to])]
            while len(rows):
                t = word[v]
                begin = end - size[t]
                asked = np.flatnonzero(begin)
                fits = np.ones(len(rows), bool)
                fits[asked] = self._fits(last[rows[asked], begin[asked]] << 32 | t[asked])
                last[rows[fits], end] = t[fits]
                rows, v = rows[~fits], above[link[v[~fits]]]
        steps, rows, end = [], np.arange(len(order)), lens
        while len(rows):  # back from the end: the k-th last ids of all
            t = last[rows, end]
            steps.append((rows, t))
            end = end - size[t]
            rows, end = rows[end > 0], end[end > 0]
        count = np.zeros(len(order), np.int64)
        for rows, _ in steps:
            count[rows] += 1
        stop = np.cumsum(count)
        ids = np.empty(int(stop[-1]), "<u4")
        for k, (rows, t) in enumerate(steps, 1):
            ids[stop[rows] - k] = t
        whole, out, stop = ids.tobytes(), [b""] * len(order), (4 * stop).tolist()
        for i, x, y in zip(order, [0, *stop], stop):
            out[i] = whole[x:y]
        return out

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """_fine() of many: found among those remembered in order, which take in the new ones some thousand at a time."""
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        out, miss = self.pair_fine[at], np.flatnonzero(self.pair[at] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = np.fromiter(map(self._fine, new.tolist()), bool, len(new))[back]
            if len(self.fits) > PAIRS_AT_ONCE:
                held = len(self.pair) < CACHE_PIECES
                pair = np.concatenate([self.pair[: len(self.pair) if held else 1], np.fromiter(self.fits.keys(), np.int64)])
                fine = np.concatenate([self.pair_fine[: len(self.pair) if held else 1], np.fromiter(self.fits.values(), bool)])
                self.pair, first = np.unique(pair, return_index=True)
                self.pair_fine = fine[first]
                self.fits.clear()
        return out

    def _go(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.columns["key"], key), len(self.columns["key"]) - 1)
        return np.where(self.columns["key"][at] == key, self.columns["to"][at], -1)

    def _pre(self, text: str) -> Iterator[tuple[str, int]]:
        """Pre-tokens in the file's letters, each with where it ends; long texts are read in windows, whose last pre-token is read again."""
        begin, window = 0, WINDOW
        while begin < len(text):
            found, at_end = self.pre_tokens(text[begin : begin + window]), begin + window >= len(text)
            done = found if at_end else found[:-1]
            for piece, (_, end) in done:
                yield piece, begin + end
            window = WINDOW if done else 2 * window
            begin = len(text) if at_end else begin + (done[-1][1][1] if done else 0)

    def _learn(self, text: str, ends: list[int]) -> list[bytes]:
        """The ids of the stretches of a text that end there."""
        pieces = list(self._pre(text))
        new = {p: self._bytes(p) for p in {p for p, _ in pieces}.difference(self.pieces)}
        own = {p: self.encode_long(x) for p, x in new.items() if len(x) > LONGEST_HELD}
        short = [p for p in new if p not in own]
        if short:
            self.pieces.update(zip(short, self.encode_short([new[p] for p in short])))
        out, k, parts, known = [], 0, [], self.pieces
        for p, end in pieces:
            parts.append(known[p] if p in known else own[p])
            if end == ends[k]:
                out.append(b"".join(parts))
                parts.clear()
                k += 1
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known = self.words
        for held in (known, self.pieces, self.fits):
            if len(held) > CACHE_PIECES:
                held.clear()
        known.update((w, struct.pack("<I", i)) for w, i in self.special.items())
        plans = [[w for k, x in enumerate(self.cut.split(t) if self.cut else [t]) for w in ((x,) if k % 2 else STRETCH.findall(x))] for t in texts]
        new = set().union(*plans).difference(known)
        more = {}  # what isn't held: long stretches
        easy = [w for w in new if w[0].isspace() and not "\x1c" <= w[0] <= "\x1f" and not w[-1].isspace() and len(w) <= LONGEST_HELD]
        bare = [w for w in new if (not w[0].isspace() or "\x1c" <= w[0] <= "\x1f") and not w[-1].isspace() and len(w) <= LONGEST_HELD]
        for own, before in ((easy, ""), (bare, "\n")):  # a line end before a text's first stretch is one byte's id
            for k in range(0, len(own), STRETCHES_AT_ONCE):
                some = own[k : k + STRETCHES_AT_ONCE]
                found = self._learn("".join([before + w for w in some]), list(accumulate(len(before) + len(w) for w in some)))
                known.update(zip(some, [x[4 * len(before) :] for x in found]))
        for w in new.difference(easy, bare):
            (known if len(w) <= LONGEST_HELD else more)[w] = self._learn(w, [len(w)])[0]
        return [b"".join([more[w] if w in more else known[w] for w in plan] if more else map(known.__getitem__, plan)) for plan in plans]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; an IndexError where one is unknown."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise IndexError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        stop = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - stop + sizes, sizes)
        return self.letters[at + np.arange(len(at))].tobytes().decode("utf-8", "replace")


#: White space and what follows up to the next, or white space that ends a text. No pre-token spans two stretches, as only
#: a space ever goes with what follows it; \x1c to \x1f are white space for Python alone.
STRETCH = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def coder(path: str) -> BytePairs:
    cache = worker_cache("byte pairs")
    if path not in cache:
        cache[path] = BytePairs(path)
    return cache[path]


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in slices(batches, 1):
            found = [np.frombuffer(x, "<u4") for x in bpe.encode_batch([t.decode("utf-8", "replace") for t in as_bytes(batch.column(1))])]
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text) of arrays of ids; null has no ids, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_column).alias("doc_id"), F.col(ids)).mapInArrow(run, f"doc_id {rows.schema[id_column].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, tokenizer: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode_texts and decode_ids give, in one pass."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in slices(batches, 1):
            count, ids, decoded = [], [], []
            for found in bpe.encode_batch([t.decode("utf-8", "replace") for t in as_bytes(batch.column(1))]):
                count.append(len(found) // 4)
                ids.append(hashlib.sha256(found).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(found, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
