"""Ops on documents against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strata.llm import line_dedup, packing, similar, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, core string, key string"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(120) for _ in range(4)]
    texts = [prose(r.randint(1, 300)) for _ in range(n)]
    for _ in range(n):
        a, b = r.choice(shared), r.randint(0, 200)
        texts.append(prose(r.randint(0, 60)) + a[b : b + r.randint(300, 520)] + prose(r.randint(0, 60)))
    texts += [texts[3], texts[3], texts[n + 1], texts[n + 2][40:], texts[n + 3][:-30], "z" * 1500, "z" * 420, "xy" * 500, None, None, "", " ", "\n\n"]
    texts.append(texts[n + 5] + " | " + texts[n + 5])
    return texts


def brute_repeats(texts, length=400):
    where = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = corpus(seed)
    got = substring_dedup.remove_repeats(table(spark, texts)).collect()
    want = brute_repeats(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 5000


def test_repeats_repeated_rows_null_ids_and_empty(spark):
    t = "".join(chr(97 + (i * i // 7) % 23) for i in range(900))
    rows = [(None, t), (None, t), (None, t), (5, "short"), (6, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (5, 0, 0), (900, 900, 1), (900, 900, 1), (900, 900, 1)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("piece", [1 << 20, 900])
def test_repeats_in_periodic_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    units = ["A", "abc", word(7), word(100), word(190), word(191), word(192), word(193)]
    texts = [word(300) + (u * 4000)[:n] + word(200) for u in units for n in (399, 401 + len(u), 790, 1700, 3100)]
    texts += ["A" * 399, "A" * 400, "x" + "A" * 400 + "y", ("abc" * 200)[1:401], ("abc" * 200)[:402] + "abd" * 300, (units[5] * 5)[50:450], (units[3] * 9)[37:437] + word(30)]
    texts += ["B" * 400, "C" * 401, ("-" * 1200 + word(3)) * 4, ("=" * 900 + "!") * 3, units[4] * 3 + word(50) + units[4] * 12, units[6] * 3]
    got = substring_dedup.remove_repeats(table(spark, texts)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == dict(enumerate(brute_repeats(texts)))


def test_few_anchors_in_periodic_texts():
    r = random.Random(2)
    prose = bytes(r.choice(b"abcdefgh ") for _ in range(300_000))
    usual = len(substring_dedup.text_anchors([prose], 400)[0])
    for unit in (b"A", b"abc", prose[:191]):
        row, place, _, runs = substring_dedup.text_anchors([b"x" * 3 + (unit * 300_000)[:300_000] + b"y" * 3], 400)
        assert len(row) < min(usual, 800) and len(runs) == 1 and runs[0, 2] - runs[0, 1] > 299_000


def test_repeats_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh") for _ in range(5000))
    texts = [a, "q" * 40 + a[1000:3100] + "r" * 500, a[4000:4500]]
    for t in texts:
        want = {(p, b) for p, b in zip(*(x.tolist() for x in substring_dedup.text_anchors([t.encode()], 400)[1:3]))}
        monkeypatch.setattr(substring_dedup, "PIECE", 1 << 20)
        assert want == {(p, b) for p, b in zip(*(x.tolist() for x in substring_dedup.text_anchors([t.encode()], 400)[1:3]))}
        monkeypatch.setattr(substring_dedup, "PIECE", 700)


def brute_lines(texts, least):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    docs = [(t or "").encode().split(b"\n") for t in texts]
    n = Counter(k for d in docs for k in {key(x) for x in d} if k)
    out = []
    for d in docs:
        kept = [x for x in d if n[key(x)] < least]
        out.append((len(d), len(d) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_lines(spark, bound, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "PROBES_PER_TASK", 20)  # several parts of a shard's probes
    monkeypatch.setattr(line_dedup, "PROBES_AT_ONCE", 7)
    r = random.Random(3)
    lines = [f"line {i} {'É' * (i % 3)}" for i in range(30)] + ["", "  ", "A", "\x0b\x1c"]
    texts = ["\n".join(r.choice([" ", "\t", ""]) + r.choice([str.upper, str])(r.choice(lines)) for _ in range(r.randint(1, 12))) for _ in range(80)] + [None, "", "a ", "solo"]
    got = line_dedup.dedup_lines(table(spark, texts), min_docs=10, broadcast_bytes=bound).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in got} == dict(enumerate(brute_lines(texts, 10)))
    rows = line_dedup.dedup_lines(table(spark, texts), min_docs=10, broadcast_bytes=bound, as_documents=True).collect()
    want = brute_lines(texts, 10)
    for x in rows:
        assert x.core == "x" and (x.text is None) == (texts[x.doc_id] is None)
        assert hashlib.sha256((x.text or "").encode()).hexdigest() == want[x.doc_id][2]
        assert x.text is None or x.n_chars == len(x.text)


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys)) == list(range(len(keys)))


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    s = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash(spark):
    texts = corpus(4, 40) + ["one", "ONE", "two words", "a b c d", "a  b\tc\nd"]
    base = " ".join(f"w{i}" for i in range(400))
    texts += [base, base + " tail", "head " + base, base.replace("w77 ", "x77 "), base.upper()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, brute_groups(fps)))}
    kept = simhash.keep_one(table(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_groups(fps)))


def test_simhash_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "a b c d e f"), (7, "q r s t"), (7, "q r s t"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got[7, 7] == 2 and got[8, 8] == 1 and got[9, 8] == 1
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert kept.count((7, "q r s t")) == 1 and kept.count((None, "a b c d e")) == 1 and (8, None) in kept and (9, "") not in kept
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def brute_shingles(text, k=5):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)} - {()}


def brute_similar(texts):
    """The first text of each group linked by a five-word Jaccard similarity of at least 0.8."""
    sets, label = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_similar_texts(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = corpus(4, 20) + ["one", "ONE", "two words", "a b c d", "a  b\tc\nd", "a b c d e", "a b c d e f"]
    for _ in range(60):  # copies with whole stretches changed: about 0.65 to 0.95, many bits apart
        base = [word() for _ in range(r.randint(60, 300))]
        for _ in range(2):
            own, at = list(base), r.randrange(len(base))
            own[at : at + int(len(base) * r.uniform(0.01, 0.18))] = [word() for _ in range(r.randint(0, 9))]
            texts.append(" ".join(own))
    base = [word() for _ in range(200)]
    for k in range(25):  # each near the next, the ends far apart
        base[7 * k : 7 * k + 7] = [word() for _ in range(7)]
        texts.append(" ".join(base))
    core = [word() for _ in range(160)]
    texts += [" ".join(core + [word() for _ in range(n)]) for n in (20, 30, 30, 30, 36, 40)] + [" ".join(core)]  # linked through the last alone
    nine = [word() for _ in range(12)]  # 8 shingles; 8 of 10 is just 0.8
    texts += [" ".join(nine), " ".join(nine + [word(), word()]), " ".join(nine[:9] + [word() for _ in range(3)])]
    label = brute_similar(texts)
    kept = similar.keep_one_similar(table(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(label))
    far = sum((brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[g])).bit_count() > 4 for i, g in enumerate(label))
    assert far > 20  # of these the fingerprints say nothing


def test_similar_texts_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "a b c d e f"), (7, "q r s t"), (7, "q r s t"), (8, None), (9, "")]
    kept = [(x.doc_id, x.text) for x in similar.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(kept) == Counter([(None, "a b c d e"), (None, "a b c d e f"), (7, "q r s t"), (8, None)])
    assert similar.keep_one_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [4, 9])
def test_balls_meet(block):
    r = np.random.default_rng(1)
    fps = np.unique(np.concatenate([x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False))) for x in r.integers(0, 1 << 63, 6).astype(np.uint64) for _ in [0] * 12]).reshape(-1) if False else np.array([int(x) ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 6)), replace=False)) for x in r.integers(0, 1 << 63, 6) for _ in range(12)], np.uint64))
    low = (1 << block) - 1
    shards = {(int(f) & low) ^ m for f in fps for m in simhash.flips(range(block), 2)}
    reach = lambda v: np.array([f for f in fps if ((int(f) & low) ^ v).bit_count() <= 2], np.uint64)
    label = {int(f): int(f) for f in fps}
    for v in shards:
        for a, b in simhash.shard_links(reach(v), v, block, 2).tolist():
            assert 0 < (a ^ b).bit_count() <= 4
            x, y = sorted((label[a], label[b]))
            label = {k: x if c == y else c for k, c in label.items()}
    groups = brute_groups([int(f) for f in fps])
    assert len(set(groups)) == len(set(label.values()))


def test_crowded_blocks_are_dealt_finer(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_PER_SHARD", 3000)  # balls of several fingerprints are too many
    r = random.Random(12)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(60)} | {r.getrandbits(64) for _ in range(20)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 1).collect()
    label = {f: f for f in fps}
    for x in found:
        a, b = x.a % (1 << 64), x.b % (1 << 64)
        assert 0 < (a ^ b).bit_count() <= 4
        low, high = sorted((label[a], label[b]))
        label = {k: low if c == high else c for k, c in label.items()}
    assert len(set(label.values())) == len(set(brute_groups(sorted(fps))))


@pytest.mark.parametrize("radius", [1, 3, 4, 5])
def test_links_reach_the_radius(spark, radius):
    r = random.Random(radius)
    fps = {0, (1 << radius) - 1, 1 << 40}  # just the radius, and one bit
    for _ in range(12):
        base = r.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius))) for _ in range(8)}
    fps = sorted(fps)
    own = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    label = list(range(len(fps)))
    for x in simhash.links(own, len(fps), radius).collect():
        i, j = (fps.index(v % (1 << 64)) for v in (x.a, x.b))
        assert (fps[i] ^ fps[j]).bit_count() <= radius
        a, b = sorted((label[i], label[j]))
        label = [a if k == b else k for k in label]
    for i in range(len(fps)):
        for j in range(i):
            assert (fps[i] ^ fps[j]).bit_count() > radius or label[i] == label[j]


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = corpus(6, 30) + ["It's 12 o'clock, DON'T stop... İstanbul ΑΣ <|endoftext|>a<|startoftext|> \x1c a\x1fb 日本語 3.14 µm ª", "word " * 5000, "a b́ Élan, ÑANDÚ."]
    rows = packing.pack_documents(table(spark, texts), path, shard_rows=40).collect()
    got, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seen[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted(got[i]) == want
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seen) <= total / 2048 + 6


def test_sum_of_squares_chooses_the_least_sum():
    r = np.random.default_rng(2)
    sizes, cap = r.integers(1, 30, 200), 40
    sequence, offset = packing.sum_of_squares(sizes, cap)
    gaps, fill = {}, defaultdict(int)
    for s, b, o in zip(sizes.tolist(), sequence.tolist(), offset.tolist()):
        fit = sorted({g for g in gaps.values() if g >= s})
        assert o == fill[b]
        if fit:
            count = Counter(g for g in gaps.values() if g)
            cost = {g: sum(v * v for v in (count - Counter([g]) + Counter([g - s] if g > s else [])).values()) for g in fit}
            assert cost[gaps[b]] == min(cost.values())
        else:
            assert b not in gaps
        gaps[b] = gaps.get(b, cap) - s
        fill[b] += s


def test_packing_empty(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect() == []
