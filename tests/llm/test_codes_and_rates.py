"""Target encoding, vector codes and byte-level BPE against brute force and the tokenizers library."""

import datetime
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strata.llm import byte_bpe, target_encoding, vector_codes
from strata.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"

# ---- time-ordered target encoding


def brute_rates(lines, sales, items, vendors, clients, folds=5):
    kind, nation, segment = (defaultdict(lambda: None, {k: v for k, v, *_ in t}) for t in (items, vendors, clients))
    rows = []
    for sale_id, item, vendor, flag in lines:
        for other, client, t in sales:
            if sale_id is not None and sale_id == other and t is not None:
                item_, client_ = -1 if item is None else item, -1 if client is None else client
                keys = {"g": 0, "kind": kind[item_], "nation": nation[vendor], "segment": segment[client_], "item": item_, "vendor": vendor, "client": client_}
                rows.append((zlib.crc32(str(sale_id).encode()) % folds, t, int(flag == "returned"), keys, (sale_id, item_, vendor, client_, t)))

    def history(row, key):
        own = [r for r in rows if r[0] != row[0] and r[1] < row[1] and r[3][key] == row[3][key]]
        return len(own), sum(r[2] for r in own)

    def rate(n, s, p):
        return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

    out = {}
    for row in rows:
        g = rate(*history(row, "g"), 500_000)
        found = []
        for key, above in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            n, s = history(row, key)
            found += [n, rate(n, s, rate(*history(row, above), g))]
        out[row[4]] = tuple(found)
    lines_of = Counter(r[4] for r in rows)
    hits_of = Counter()
    for r in rows:
        hits_of[r[4]] += r[2]
    return Counter((*k[:3], lines_of[k], hits_of[k], *v) for k, v in out.items())


SHOP = {
    "sale_lines": "sale_id long, item_id long, vendor_id long, flag string, fold string, n string",
    "sales": "sale_id long, client_id long, sold_at timestamp_ntz, t string",
    "items": "item_id long, kind string, known string",
    "vendors": "vendor_id long, nation_id int, hot string",
    "clients": "client_id long, segment string, since string",
}


def shop(spark, tables):
    return [spark.createDataFrame([(*r, *["x"] * (len(SHOP[n].split(", ")) - len(r))) for r in tables[n]], SHOP[n]) for n in SHOP]


@pytest.mark.parametrize("slice_rows", [4, 10_000])
def test_rates(spark, slice_rows):
    draw, start = random.Random(slice_rows), datetime.datetime(2024, 3, 31, 1, 59)
    times = [start + datetime.timedelta(seconds=draw.randint(0, 40), microseconds=draw.choice([0, 0, 1])) for _ in range(30)]
    tables = {
        "sales": [(i, draw.choice([None, 1, 1, 1, 2, 9]), draw.choice([None, *times])) for i in range(60)] + [(None, 1, times[0])],
        "sale_lines": [(draw.choice([0, 0, 0, *range(64), None]), draw.choice([None, 1, 1, 2, 3, 99]), draw.choice([None, 5, 5, 6]), draw.choice(["returned", "kept", None])) for _ in range(120)],
        "items": [(1, "a"), (2, None), (3, "b"), (None, "c")],
        "vendors": [(5, 1), (6, None)],
        "clients": [(1, "p"), (2, None)],
    }
    tables["sale_lines"] += tables["sale_lines"][:5]
    tables["sales"].append(tables["sales"][3])  # a repeated row
    got = target_encoding.sale_rates(*shop(spark, tables), slice_rows=slice_rows)
    names = ("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == brute_rates(**{("lines" if n == "sale_lines" else n): t for n, t in tables.items()})
    assert all(kind == "bigint" for _, kind in got.dtypes)


def test_rates_of_nothing(spark):
    assert target_encoding.sale_rates(*shop(spark, dict.fromkeys(SHOP, []))).collect() == []


def test_micros(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000001' AS a, timestamp_ntz'1969-12-31 23:59:59.5' AS b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 doesn't exist there
        assert tuple(rows.select(target_encoding.micros(rows.a), target_encoding.micros(rows.b)).first()) == (1711852200000001, -500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# ---- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]
        books, codes = [], []
        for a, b in cuts:
            vectors = [v[a:b] for _, v, _ in own]
            book = [list(v) for v in vectors[:entries]]
            distance = lambda v, e: sum((x - y) ** 2 for x, y in zip(v, e))
            nearest = lambda v: min(range(len(book)), key=lambda k: (distance(v, book[k]), k))  # noqa: E731, B023
            for _ in range(rounds):
                at = [nearest(v) for v in vectors]
                book = [[sum(c) // len(c) for c in zip(*(v for v, x in zip(vectors, at) if x == k))] if k in at else e for k, e in enumerate(book)]
            at = [nearest(v) for v in vectors]
            books.append(book)
            codes.append([(k, distance(v, book[k])) for v, k in zip(vectors, at)])
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        out += [(r[0], "".join(f"{c[j][0]:02x}" for c in codes), sum(c[j][1] for c in codes), r[2], sha) for j, r in enumerate(own)]
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return Counter((r[0], r[1], r[2], total[r[3]], r[4]) for r in out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, parts string, of string").repartition(3)


def codes(df):
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes(spark):
    draw = np.random.default_rng(5)
    vec = lambda n: [float(np.float32(x)) for x in draw.normal(size=n)]
    rows = [(int(i), vec(8), int(draw.integers(3))) for i in draw.permutation(60)] + [(70 + i, vec(6), None) for i in range(9)]
    rows += [(None, vec(8), None), (3, vec(8), 1), (80, rows[0][1], 1), (80, rows[0][1], 1), (81, [], 2), (82, [0.5], 2)]
    rows += [(90, None, 1), (91, [1.0, None] * 4, 1), (92, [float("nan")] * 8, 1), (93, [float("inf")] * 8, 1), (94, [-0.0] * 8, 0)]
    assert codes(vector_codes.compress(vectors(spark, rows), entries=16)) == brute_codes(rows, entries=16)
    assert codes(vector_codes.compress(vectors(spark, rows[:5]))) == brute_codes(rows[:5])  # fewer than entries
    assert codes(vector_codes.compress(vectors(spark, []))) == Counter()


def test_codes_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 4, 1)])).collect()


def test_filter_is_exact_and_filters():
    draw = np.random.default_rng(7)
    entries = draw.integers(-900, 900, (256, 16))
    entries[200:] = entries[:56]  # ties
    asked = np.concatenate([entries[::3] + draw.integers(-40, 40, (86, 16)), draw.integers(-900, 900, (200, 16)), entries[190:]])
    held = vector_codes.Filter(entries)
    apart = ((asked[:, None, :] - entries[None]) ** 2).sum(2)
    lower, upper = held.bounds(asked)
    assert (lower <= apart).all() and (apart <= upper).all()
    index, distance = held.nearest(asked)
    assert (index == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert held.compared < 0.2 * apart.size


# ---- byte-level BPE


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    return byte_bpe.BytePairs(path), Tokenizer.from_file(path)


def same(both, texts):
    own, library = both
    for text, got, want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == want.ids, text[:100]
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_documents(both):
    same(both, [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()])


def test_bpe_of_odd_texts(both):
    draw = random.Random(3)
    bits = ["a", "aa", "the", " ", "  ", "\n", " \n", "\t", " ", "　", "\x1c", "\x1f", "\x85", "​", "é", "ß", "日本", "😀", "'s", "'re", "--", "==", "1", "22", "<|endoftext|>", "<|endof", "text|>", "́", "Ab", "ing", "x", "."]
    same(both, ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(3000)])
    same(both, ["".join(chr(draw.choice([draw.randint(0, 127), draw.randint(0, 0x2FFF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(draw.randint(0, 60))) for _ in range(500)])
    same(both, [c * n for c in ("a", "-", " ", "ab", "aab", "\n", "0", "a.") for n in (1, 40, 33_333)])


def test_every_token_of_the_vocabulary(both):
    same(both, [w.decode() for w in both[0].bytes.values() if w.decode("utf-8", "ignore").encode() == w])


def test_windows(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 5)
    both[0].pieces.clear(), both[0].words.clear()
    same(both, ["abc.def,ghi123---jkl" * 9, "  \n\n word", "unbrokenwordthatislong" * 3 + "!"])


def test_bpe_in_spark(spark, both):
    rows = [(1, "Hello <|endoftext|>  world"), (2, None), (3, ""), (4, "x" * 50_000), (1, "Hello <|endoftext|>  world"), (None, "né")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, ids string")
    path = tokenizer_path("byte_bpe_50k.json")
    want = Counter()
    for i, t in rows:
        e = both[1].encode(t or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.token_digests(docs, path).collect()) == want
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path), path)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert byte_bpe.token_digests(docs.limit(0), path).collect() == []
